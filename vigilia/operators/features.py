"""Feature engineering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import clinical as C
from ..functions import constants as K
from . import sequence as S


def trend_features(df: DataFrame, cols: Sequence[str] = K.TREND_VITALS, *, key: str = "patient_id",
                   hour: str = "hour_from_admission", hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """E5 + E6: ``{c}_change`` (diff, 0 at start / when missing) and ``{c}_rolling_mean`` (3 rows)."""

    def rows(x: DataFrame, parts: list) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(F.col(hour), F.col("obs_id"))
        w3 = w.rowsBetween(-2, 0)
        adds = {}
        for c in cols:
            adds[f"{c}_change"] = F.coalesce(F.col(c) - F.lag(c, 1).over(w), F.lit(0.0))
            adds[f"{c}_rolling_mean"] = F.avg(c).over(w3)
        return x.withColumns(adds)

    return S.sequence_windows(df, key, [hour, "obs_id"], chunk_basis=F.col(hour), rows_fn=rows,
                              rows_back=2, hot_rows=hot_rows)


def one_hot(df: DataFrame, levels: dict[str, list[str]] | None = None, drop_first: bool = False,
            keep_source: bool = False) -> DataFrame:
    """One column per level (sorted), 1/0; a missing category gives all zeros.

    Levels are a fixed domain (from the schema contract), so no pass over the data
    is needed to find them.
    """
    levels = levels or K.CATEGORY_LEVELS
    adds = {}
    drop = []
    for c, lv in levels.items():
        if c not in df.columns:
            continue
        lv = sorted(lv)
        for x in (lv[1:] if drop_first else lv):
            adds[f"{c}_{x}"] = C.flag(F.col(c) == x)
        drop.append(c)
    out = df.withColumns(adds)
    return out if keep_source else out.drop(*drop)


def clip_clinical(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Clip to clinical ranges, keeping NULL; absent columns are skipped."""
    ranges = ranges or K.CLIP_RANGES
    return df.withColumns({c: C.clip(c, lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns})


def coerce_numeric(df: DataFrame, cols: Sequence[str] = K.FLOAT_COLUMNS) -> DataFrame:
    """``try_cast`` to double (bad text -> NULL), skipping absent columns."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in present})


def drop_present(df: DataFrame, cols: Sequence[str] = K.LEAKAGE_DROP) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns of the schema (target excluded)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f, t in zip(df.schema.fields, df.dtypes) if t[1] == "string"]


def assemble(df: DataFrame, feature_names: Sequence[str], aliases: dict[str, str] | None = None,
             vector_col: str | None = None) -> DataFrame:
    """Features in a fixed order; alias map; absent or NULL -> 0.0."""
    aliases = aliases if aliases is not None else K.API_NAME
    cols = []
    for f in feature_names:
        if f in df.columns:
            src = F.col(f)
        elif f in aliases and aliases[f] in df.columns:
            src = F.col(aliases[f])
        else:
            src = F.lit(0.0)
        cols.append(F.coalesce(src.cast("double"), F.lit(0.0)).alias(f))
    out = df.select(*[c for c in df.columns if c not in feature_names], *cols)
    if vector_col:
        from pyspark.ml.feature import VectorAssembler
        out = VectorAssembler(inputCols=list(feature_names), outputCol=vector_col).transform(out)
    return out


def single_row_defaults(df: DataFrame, cols: Sequence[str] = K.TREND_VITALS) -> DataFrame:
    """No history -> change 0, rolling mean = current value."""
    return df.withColumns({**{f"{c}_change": F.lit(0.0) for c in cols},
                           **{f"{c}_rolling_mean": F.col(c).cast("double") for c in cols}})


def fill_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """``coalesce`` missing readings with fixed defaults (present columns only)."""
    defaults = defaults or K.REPORT_DEFAULTS
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns})


# ------------------------------------------------------------ documented only
def standard_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / stddev with statistics from ``fit`` (default: ``df``), one aggregate pass."""
    src = fit if fit is not None else df
    stats = src.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev(c).alias(f"s_{c}") for c in cols])
    return df.withColumns({c: (F.col(c) - stats.select(f"m_{c}").scalar()) / stats.select(f"s_{c}").scalar()
                           for c in cols})


def forward_fill(df: DataFrame, cols: Sequence[str], *, key: str = "patient_id",
                 hour: str = "hour_from_admission", hot_rows: int | None = S.HOT_ROWS,
                 hour_chunk: float = 168.0) -> DataFrame:
    """Last non-null value so far within the patient.

    Ordinary patients: one window over the patient. Hot patients: the fill runs
    per hour chunk, and a chunk's leading NULLs take the last non-null value of
    the earlier chunks from a carry table (one row per chunk: a small table).
    """
    order = [F.col(hour), F.col("obs_id")]
    tagged, any_hot = S.tag_hot(df, key, hot_rows)
    if not any_hot:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.repartition(key).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    d = tagged.withColumn("_fc", F.when(F.col("_hot"), F.floor(F.col(hour) / F.lit(hour_chunk))).otherwise(F.lit(0))
                          .cast("long"))
    w = Window.partitionBy(key, "_fc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    # last non-null per (key, chunk), then carried forward over the chunk table
    last = d.groupBy(key, "_fc").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))
                                       .alias(f"_l_{c}") for c in cols])
    wc = Window.partitionBy(key).orderBy("_fc").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(F.col(key).alias("_ck"), F.col("_fc").alias("_cc"), *[F.last(f"_l_{c}", ignorenulls=True).over(wc).alias(f"_c_{c}") for c in cols])
    out = local.join(carry, F.col(key).eqNullSafe(F.col("_ck")) & F.col("_fc").eqNullSafe(F.col("_cc")), "left")  # NULL is a patient, and an hour
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in cols}).drop(
        "_fc", "_hot", "_ck", "_cc", *[f"_c_{c}" for c in cols])


def interaction(df: DataFrame, a: str = "lactate", b: str = "wbc_count") -> DataFrame:
    """Z3: product term."""
    return df.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))


def hourly_rolling(df: DataFrame, col: str, hours: int, *, key: str = "patient_id",
                   hour: str = "hour_from_admission", hot_rows: int | None = S.HOT_ROWS) -> DataFrame:
    """Mean and slope over the last ``hours`` hours (RANGE frame on the hour)."""

    def rng(x: DataFrame, parts: list) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(F.col(hour)).rangeBetween(-(hours - 1), 0)
        return x.withColumns({f"{col}_mean_{hours}h": F.avg(col).over(w),
                              f"{col}_slope_{hours}h": F.regr_slope(F.col(col), F.col(hour).cast("double")).over(w)})

    return S.sequence_windows(df, key, [hour, "obs_id"], chunk_basis=F.col(hour), range_fn=rng,
                              range_back=hours - 1, hot_rows=hot_rows)
