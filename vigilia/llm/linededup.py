"""Cross-site boilerplate lines by distinct-site spread.

Every line (trimmed, split at line feeds) is hashed; a HyperLogLog sketch of its sites is merged by aggregation per
line hash (map-side partial sketches, so a very common line is one row per task). Lines whose estimate is clear of the
threshold by the sketch's error are decided by it; the near-threshold lines, and only those, get an exact distinct
count of sites. A line seen on ``min_sites`` sites or more is boilerplate: it is removed from every document but the
one with the smallest id that holds it, so that no text is lost from the corpus altogether.

Removal is row-local: the flags of a document's lines are gathered in line order (a boolean per line) and zipped with
its lines, linear in the document's length.

Cases: a null site is a site of its own; null texts stay null, empty texts and blank lines are left alone; repeated
rows are edited alike (each keeps or loses the same lines); null ids come last when the keeping document is chosen;
an empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common

MIN_SITES = 10
LG_K = 12  # sketch of 4096 registers: standard error 1.04 / 64
SIGMAS = 3.0
FEW_LINES = 200_000  # near-threshold lines (16 bytes each) that are broadcast after their count; more are joined by a shuffle


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, site, pos, h1, h2) per non-blank line; the line is known by 128 hash bits."""
    out = rows.select("doc_id", "text_key", "site", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    return out.filter("line != ''").select("doc_id", "text_key", "site", "pos", F.xxhash64("line").alias("h1"),
                                           F.xxhash64(F.lit("line"), F.col("line")).alias("h2"))


def band(min_sites: int, lg_k: int = LG_K, sigmas: float = SIGMAS) -> tuple[int, int]:
    """Estimates from low to high (both included) are too near the threshold to be trusted."""
    err = sigmas * 1.04 / 2 ** (lg_k / 2)
    return int(min_sites * (1 - err)), int(min_sites * (1 + err)) + 1


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, sites, keeper): lines on ``min_sites`` sites or more and the row that keeps them."""
    low, high = band(min_sites, lg_k)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min(order).alias("keeper"))
    spread = common.write_cut(spread.filter(F.col("sites") >= low))  # the only lines that can reach the threshold
    near = spread.filter(F.col("sites") <= high).select("h1", "h2")
    seen = lines.select("h1", "h2", "site")
    if near.count() <= FEW_LINES:
        seen = seen.join(F.broadcast(near), ["h1", "h2"], "left_semi").distinct()
    else:  # one row per line and site before the join, so that no task gets all rows of a common line
        seen = seen.distinct().join(near, ["h1", "h2"], "left_semi")
    exact = seen.groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    known = spread.join(exact, ["h1", "h2"], "left").withColumn("sites", F.coalesce("exact", "sites"))
    return known.filter(F.col("sites") >= min_sites).select("h1", "h2", "sites", "keeper")


def _rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text"), common.text_key(text_col).alias("text_key"),
                       F.coalesce(F.concat(F.lit("s:"), F.col(site_col).cast("string")), F.lit("null")).alias("site"))


def line_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
               min_sites: int = MIN_SITES) -> DataFrame:
    """(key, gone): for each (id, text) with a boilerplate line to lose, the positions of its lost lines, ascending."""
    lines = _lines(_rows(docs, id_col, text_col, site_col))
    bad = common.write_cut(boilerplate(lines, min_sites))
    hit = lines.select("doc_id", "text_key", "pos", "h1", "h2").join(bad, ["h1", "h2"])
    lost = hit.filter(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_key") == F.col("keeper.text_key"))))
    # rows that repeat an (id, text) pair give each position several times: a set holds it once
    return lost.groupBy(common.row_key(F.col("doc_id"), F.col("text_key")).alias("key")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _kept(lines: str, gone: str) -> Column:
    """The lines (a column, so that the split runs once a row) without the positions ``gone``: each stretch between two
    lost lines is sliced once, so the work is linear in the number of lines."""
    before = F.concat(F.array(F.lit(-1)), F.col(gone))
    after = F.concat(F.col(gone), F.array(F.size(lines)))
    parts = F.filter(F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"] - p["a"] > 1)
    return F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(F.col(lines), p["a"] + 2, p["b"] - p["a"] - 1))), "\n")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, lost_col: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines cut out of the text; ``lost_col`` adds the number of lines lost."""
    key, gone, lines = (common.fresh(docs, c) for c in ("row_key", "lost_lines", "all_lines"))
    flags = line_flags(docs, id_col, text_col, site_col, min_sites).select(F.col("key").alias(key), F.col("gone").alias(gone))
    out = docs.withColumn(key, common.row_key(F.col(id_col), common.text_key(text_col))).join(flags, key, "left")
    out = out.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(F.col(text_col), "\n")))
    out = out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_kept(lines, gone)))
    if lost_col:
        out = out.withColumn(lost_col, F.coalesce(F.array_size(gone), F.lit(0)))
    return out.drop(key, gone, lines)
