"""Documented-only operators (Z5, Z6): distribution drift and the retrain gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix


def compare_splits(df: DataFrame, ref_cond: Column, new_cond: Column, cols: Sequence[str], ranges: dict, bins: int = 10,
                   eps: float = 1e-6) -> DataFrame:
    """Z5 for several features: (feature, psi, psi_deciles, ks) of the rows of ``new_cond`` against those of ``ref_cond``.

    ``psi``: population stability index over ``bins`` equal ranges of the feature's ``ranges`` (values outside go to the end
    bins); ``psi_deciles``: over the reference's quantiles (a value's bin follows from the share of reference rows below it);
    ``ks``: two-sample Kolmogorov-Smirnov statistic. Shares below ``eps`` count as ``eps``. NULL and NaN are left out.

    Both samples of all features are counted per (feature, value) in one aggregation; one running sum over these counts
    gives the places of all values, and every measure is a sum or a maximum over it.
    """
    long = df.select(F.coalesce(ref_cond, F.lit(False)).cast("long").alias("r"), F.coalesce(new_cond, F.lit(False)).cast("long").alias("n"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in cols])).alias("t"))
    long = long.filter("t.value IS NOT NULL AND r + n > 0")
    counts = long.groupBy("t.feature", "t.value").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    cur = prefix.group_running_sums(counts, ["feature"], ["value"], ["r", "n"])
    fixed = F.coalesce(*[F.when(F.col("feature") == c, (F.col("value") - lo) / (hi - lo) * bins) for c, (lo, hi) in ranges.items()])
    quantile = F.col("r_below") * bins / F.col("r_total")
    clipped = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(bins - 1)).cast("int")
    kinds = F.array(F.struct(F.lit("psi").alias("kind"), clipped(fixed).alias("bin")), F.struct(F.lit("psi_deciles").alias("kind"), clipped(quantile).alias("bin")))
    binned = cur.select("feature", "r", "n", "r_total", "n_total", F.explode(kinds).alias("k")).groupBy("feature", "k.kind", "k.bin").agg(
        *[F.greatest(F.sum(c) / F.first(f"{c}_total"), F.lit(eps)).alias(f"p{c}") for c in ("r", "n")])
    index = F.sum((F.col("pn") - F.col("pr")) * F.log(F.col("pn") / F.col("pr")))  # a bin empty on both sides adds nothing
    psi = binned.groupBy("feature").pivot("kind", ["psi", "psi_deciles"]).agg(F.round(index, 6))
    apart = F.abs((F.col("r_below") + F.col("r")) / F.col("r_total") - (F.col("n_below") + F.col("n")) / F.col("n_total"))
    return psi.join(cur.groupBy("feature").agg(F.round(F.max(apart), 6).alias("ks")), "feature")


def retrain_gate(new_rows: DataFrame, auc: DataFrame, min_rows: int = 1000, min_auc: float = 0.93) -> DataFrame:
    """Deploy a retrained model when more than ``min_rows`` new rows exist and its AUC exceeds ``min_auc``."""
    n = new_rows.agg(F.count(F.lit(1))).scalar()
    return auc.select("*", n.alias("n_new_rows"),
                      ((n > min_rows) & (F.col("roc_auc") > min_auc)).alias("deploy"))
