"""Centroid clustering of integer vectors with JVM-native expressions.

Vectors are integers, floor(scale x component). The first centroids are the ``k`` rows with the smallest SHA-256 of
``seed:id``. In each round the centroids stand in the plan as literal arrays: ``zip_with`` and ``aggregate`` give the squared
distance of a row to each, and ``array_min`` of (distance, number) structs chooses the cluster, ties to the smaller number.
One sum per component and a count, grouped by cluster in generated code and combined in each task before the shuffle, give
the new centroid: the exact floor of the mean. An empty cluster keeps its centroid.

The driver holds k centroids. A round reads the table once and shuffles k rows a task; no row moves. The last assignment is
written once as three narrow columns, from which the inertia is summed.

Cases: rows whose vector is null, not of ``dim`` components, or holds null or non-finite components are not kept, nor are
vectors with a squared norm of 2^60 or more, whose distances might not fit 64 bits. Fewer than k kept rows give as many
centroids; a null id takes part but is never a first centroid (without any other id there is no centroid and no row);
repeated rows count each, and rows with one id are told apart by their vectors; an empty table gives an empty result;
other columns are ignored. Inertias stop at 2^63 - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common
from vigilia.llm import vectors as V

SCALE, DIM, K, ROUNDS, SEED = 64, 64, 16, 3, 1
MOST = (1 << 63) - 1


def integer_vectors(table: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the kept rows."""
    x = F.col("x")
    rows = table.select(F.col(id_col).alias("vec_id"), V.doubles(F.col(vec_col)).alias("x")).filter((F.size(x) == dim) & V.finite(x))
    return rows.filter(V.squared_norm(F.transform(x, lambda e: e * F.lit(float(scale)))) < V.TOP).select("vec_id", V.floored(x, scale).alias("v"))


def _literal(centroid: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{c}L' for c in centroid)})")


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid."""
    def squared(c: list[int]) -> Column:
        return F.aggregate(F.zip_with(v, _literal(c), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, e: s + e)

    return F.array_min(F.array(*[F.struct(squared(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vectors`` with cluster and distance."""
    near = vectors.withColumn("near", nearest(F.col("v"), centroids))
    return near.select(*vectors.columns, F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.filter("vec_id is not null").orderBy(order, "v").limit(k).collect()]


def updated(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: k rows reach the driver."""
    dim = len(centroids[0])
    held = assign(vectors, centroids)
    # 2^30 bounds a kept component, so a sum of longs is exact below 2^33 rows; decimals have room for any number of rows
    sums = held.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("decimal(11,0)")).alias(f"s{i}") for i in range(dim)])
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    return out


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = updated(vectors, centroids)
    return centroids


def clusters(table: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id",
             vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) per kept row, after ``rounds`` rounds and a last assignment."""
    vectors = integer_vectors(table, dim, scale, id_col, vec_col)
    centroids = fit(vectors, k, rounds, seed)
    if not centroids:
        return vectors.limit(0).select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))],
                                       F.col("v").alias("centroid"))
    held = common.write_cut(assign(vectors, centroids).drop("v"))
    sums = {r["cluster"]: int(r["s"]) for r in held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    inertia = [min(sums.get(i, 0), MOST) for i in range(len(centroids))]
    own = F.element_at(_literal(inertia), F.col("cluster") + 1)
    centre = F.element_at(F.array(*[_literal(c) for c in centroids]), F.col("cluster") + 1)
    return held.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), centre.alias("centroid"))
