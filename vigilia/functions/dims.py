"""The normal-range table as a small DataFrame (fixed size, safe to broadcast); the other tables are literals in the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K


def normal_ranges(spark: SparkSession) -> DataFrame:
    """parameter, api_name, ord (request field order), low, high, unit, api_unit, range_text, api_range_text."""
    api_of = {p: K.API_NAME.get(p, p) for p in K.NORMAL_RANGES}
    rows = []
    for p, (lo, hi, unit) in K.NORMAL_RANGES.items():
        a = api_of[p]
        rows.append((p, a, K.API_PARAMETERS.index(a), float(lo), float(hi), unit, K.API_UNIT[a],
                     K.NORMAL_RANGE_TEXT[p], K.API_RANGE_TEXT[a]))
    schema = ("parameter string, api_name string, ord int, low double, high double, unit string, "
              "api_unit string, range_text string, api_range_text string")
    return F.broadcast(spark.createDataFrame(rows, schema))
