"""Python-compatible number formatting as Spark column expressions.

Report texts print numbers the way Python's ``'%.{d}f'`` / ``'{:.{d}%}'`` do:
the exact binary value of the double is rounded half-to-even. Java's
``format_string`` rounds the shortest decimal form half-up instead (0.125 ->
"0.13" where Python prints "0.12"; 0.165 -> Python "0.17"). Here the product
``x * 10^d`` is split exactly (Dekker's two-product: the rounded product plus
its exact error), so the distance to the nearest half is decided without
rounding error; the digits are then assembled from a long. JVM-side, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

import re

_SIMPLE = re.compile(r"^Column<'[A-Za-z_][A-Za-z0-9_.]*'>$")
_SPLIT = 134217729.0  # 2^27 + 1 (Veltkamp split of a double into two 26-bit halves)


def let(x: Column, fn) -> Column:
    """Evaluate ``x`` once and pass it to ``fn`` (avoids re-evaluating a large expression per use)."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def round_half_even_exact(x: Column, d: int) -> Column:
    """Integer ``round_half_even(x_exact * 10^d)`` as a long (Python's rounding of the exact double)."""
    b = float(10 ** d)
    p = x * F.lit(b)
    c = x * F.lit(_SPLIT)
    hi = c - (c - x)
    lo = x - hi
    err = (hi * F.lit(b) - p) + lo * F.lit(b)  # exact: p + err == x * 10^d
    n = F.floor(p)
    diff = (p - (n + F.lit(0.5))) + err
    up = F.when(diff > 0, F.lit(True)).when(diff < 0, F.lit(False)).otherwise(n % 2 != 0)
    return F.when(up, n + 1).otherwise(n).cast("long")


def fmt_fixed(x: Column, d: int, plus: bool = False) -> Column:
    """Python ``format(x, '.{d}f')`` (``'+.{d}f'`` when ``plus``); NULL stays NULL.

    Pass a column reference where possible; other expressions are bound once.
    """
    if isinstance(x, str):
        return _fmt_fixed(F.col(x), d, plus)
    if not _SIMPLE.match(str(x)):
        return let(x, lambda v: _fmt_fixed(v, d, plus))
    return _fmt_fixed(x, d, plus)


def _fmt_fixed(x: Column, d: int, plus: bool) -> Column:
    # R / 10^d is the double nearest to the decimal R * 10^-d, whose shortest form has exactly
    # those digits, so Java's formatter prints it without rounding again.
    r = round_half_even_exact(x, d)
    text = F.format_string(f"%{'+' if plus else ''}.{d}f", r.cast("double") / F.lit(float(10 ** d)))
    # Python keeps the sign of a negative value that rounds to zero ("-0.00")
    neg_zero = (r == 0) & ((x < 0) | ((x == 0) & x.cast("string").startswith("-")))
    zero = "0" if d == 0 else "0." + "0" * d
    return F.when(x.isNull(), F.lit(None).cast("string")).when(neg_zero, F.lit("-" + zero)).otherwise(text)


def fmt_pct(x: Column, d: int) -> Column:
    """Python ``format(x, '.{d}%')``: the double is multiplied by 100 first, then fixed-formatted."""
    return F.concat(fmt_fixed(x * F.lit(100.0), d), F.lit("%"))


def py_str(x: Column) -> Column:
    """``str(float)`` for ordinary magnitudes (Spark's double-to-string gives the same shortest form)."""
    return x.cast("string")
