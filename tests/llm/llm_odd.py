"""Odd rows that every operator must take: nulls, empty and very long texts, repeats, clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(c, T.StringType()) for c in ("row_key", "key", "fp", "site", "line", "spans", "score", "epoch_", "leaf", "row", "n", "word", "held_out", "all_lines")],
])
EXTRA = ("x",) * 14

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30000))
LINE = "Shared boilerplate line of this site and many others."


def rows():
    out = [(1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "src1"), (2, None, "en", "src2"), (3, "", None, "src3"),
           (4, LONG, "de", None), (4, LONG, "de", None), (None, "no id here at all", None, None), (None, None, None, None),
           (7, "   \n\t\n ", "fr", "odd/name"), (8, "é ü 漢字   𝔘nicode", "es", "src99999999999999999999")]
    out += [(100 + i, f"{LINE}\nown line number {i}\n\n{LINE}", "en", f"src{i % 12}") for i in range(24)]
    return [(*r, None if r[1] is None else len(r[1]), *EXTRA) for r in out]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
