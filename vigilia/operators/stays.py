"""Stay reconstruction from a flat file.

A flat observation file has no patient id: a new stay starts on the first line
or wherever the hour counter falls. Both steps need the previous line in file
order, i.e. a keyless window; it runs on contiguous buckets of the line number
(``prefix``), never in one task. Equal hours do not start a stay (the rule is
"hour decreased"), so a one-row stay at hour 0 followed by another stay at hour
0 is merged, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import prefix


def rebuild_stays(raw: DataFrame, *, order: str = "line_no", hour: str = "hour_from_admission",
                  out: str = "patient_id", flag: str = "new_stay", n_parts: int | None = None,
                  dense_lines: bool = True) -> DataFrame:
    """``new_stay`` flag (first line, hour decreased, or no difference because an hour is missing);
    E2: ``patient_id`` = running count of starts.

    ``dense_lines``: line numbers are 1..N without gaps (as attached at ingest), so
    the line buckets are arithmetic.
    """
    return prefix.lag_scan_new_groups(raw, order, hour, flag, out, n_parts, dense=dense_lines)
