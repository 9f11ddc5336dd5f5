"""Queries of the training-data operators: opN_<name> over the whole intended table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilia.llm import centroids, decontam, hardneg, linededup, lm, mixing, mtree, pieces, quality, secrets, simhash, suffix, warc
from vigilia.llm.common import table

# Mixing plan of the query and the pipeline: source srcN belongs to the domain that N mod 3 names.
DOMAINS = ("web", "books", "code")
WEIGHTS = {"web": 50, "books": 30, "code": 20} | {f"{d}/{lang}": w for d in DOMAINS for lang, w in (("en", 60), ("de", 20), ("fr", 15), ("es", 5))}


def tree_levels():
    """domain, language, source of a documents row."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d+)$", 1)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    domain = F.when(number != "", F.try_element_at(names, (number.try_cast("long") % 3 + 1).cast("int"))).otherwise(F.lit("other"))
    return [domain, F.col("lang"), F.col("source")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-weighted mix of all documents: 60 % of the corpus's tokens over domain, language and source, 3 epochs at most."""
    out = mixing.mix(table(spark, sf_dir, "documents"), tree_levels(), WEIGHTS)
    return out.select("doc_id", "lang", "source", "epoch", "n_tokens", "take_tokens")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, at most 2 differing bits."""
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings."""
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without cross-site boilerplate lines (10 sources or more)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = linededup.remove_boilerplate(docs, lost_col="n_removed")
    return out.select("doc_id", "n_removed", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest inner products of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.filter(mtree.divisible("vec_id", 100)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by the salvage reader."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of any benchmark item, with the smallest such item."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).filter("contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).drop("text_key")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-mixing and unigram scores of every document."""
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; labels of ids divisible by 7 are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings: 16 centroids, 3 rounds."""
    out = centroids.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


PIECE_MODEL = "piece_bpe_32k.model"


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every document encoded and decoded again; ``model``: path of the model file on the driver."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(PIECE_MODEL)
    with open(model, "rb") as f:
        blob = f.read()
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), blob).select("doc_id", "ids"), blob)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(pieces.id_list(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline (corpus_pipeline.py) over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_suffix_dedup, op4_line_dedup, op5_topk, op6_warc, op7_decontamination, op8_quality, op9_secrets, op10_lm, op11_hard_negatives, op12_centroids,
                                   op13_sentencepiece, pipeline)}


def queries():
    return dict(QUERIES)


def _op1_sql(share: int = 600, max_epochs: int = 3, seed: int = 42) -> str:
    """The mix with whole-table windows: three levels of water filling, then the token prefix of one epoch per leaf."""
    weight = " ".join(f"WHEN path = '{k}' THEN {w}" for k, w in WEIGHTS.items())
    ctes = [f"""docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS body, coalesce(lang, 'null') AS l2, coalesce(source, 'null') AS l3,
          CASE TRY_CAST(regexp_extract(coalesce(source, ''), '^src([0-9]+)$', 1) AS BIGINT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'other' END AS l1,
          len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents)""",
            f"""leaf AS (SELECT '' AS p0, replace(l1, '/', '%2F') AS p1, replace(l1, '/', '%2F') || '/' || replace(l2, '/', '%2F') AS p2,
          replace(l1, '/', '%2F') || '/' || replace(l2, '/', '%2F') || '/' || replace(l3, '/', '%2F') AS p3, l1, l2, l3, sum(n)::BIGINT AS tokens, (sum(n) * {max_epochs})::BIGINT AS cap FROM docs GROUP BY l1, l2, l3)""",
            f"given0 AS (SELECT '' AS parent, least((SELECT (sum(n)::BIGINT * {share}) // 1000 FROM docs), sum(cap)::BIGINT) AS given FROM leaf)"]
    for i in (1, 2, 3):
        ctes += [f"""node{i} AS (SELECT parent, path, cap, given, CASE {weight} ELSE 1 END::BIGINT AS weight
          FROM (SELECT p{i - 1} AS parent, p{i} AS path, sum(cap)::BIGINT AS cap FROM leaf GROUP BY 1, 2) JOIN given{i - 1} USING (parent))""",
                 f"""filled{i} AS (SELECT *, given - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remains,
          (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS share FROM node{i} WHERE cap > 0
          WINDOW o AS (PARTITION BY parent ORDER BY cap / weight, path))""",
                 f"""stop{i} AS (SELECT parent, arg_max(remains, share) AS remains, max(share) AS share FROM filled{i} WHERE cap * share > weight * remains GROUP BY parent)""",
                 f"""given{i} AS (SELECT f.path AS parent, CASE WHEN f.cap * f.share <= f.weight * f.remains THEN f.cap ELSE (f.weight * s.remains) // s.share END AS given
          FROM filled{i} f LEFT JOIN stop{i} s USING (parent) UNION ALL SELECT path, 0 FROM node{i} WHERE cap <= 0)"""]
    ctes += [f"""plan AS (SELECT l1, l2, l3, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS part
          FROM leaf JOIN given3 ON p3 = parent)""",
             f"""part AS (SELECT *, sum(n) OVER (PARTITION BY l1, l2, l3 ORDER BY md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(body)) ROWS UNBOUNDED PRECEDING) - n AS before
          FROM docs JOIN plan USING (l1, l2, l3) WHERE part > 0)"""]
    return "WITH " + ",\n".join(ctes) + """
        SELECT doc_id, lang, source, unnest(range(whole)) AS epoch, n AS n_tokens, n AS take_tokens FROM docs JOIN plan USING (l1, l2, l3)
        UNION ALL SELECT doc_id, lang, source, whole, n, least(n, part - before)::BIGINT FROM part WHERE before < part AND n > 0"""


OP4_SQL = f"""
    WITH lines AS (SELECT doc_id, source, pos, raw, trim(raw, ' ') AS line FROM
             (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)),
         bad AS (SELECT line, min(doc_id) AS keeper FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('s:' || source, 'null')) >= {linededup.MIN_SITES}),
         marked AS (SELECT l.*, b.keeper IS NOT NULL AND b.keeper <> l.doc_id AS lost FROM lines l LEFT JOIN bad b USING (line)),
         edited AS (SELECT doc_id, count(*) FILTER (WHERE lost) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '') AS kept FROM marked GROUP BY doc_id)
    SELECT doc_id, coalesce(n_removed, 0)::INT AS n_removed, strlen(coalesce(kept, ''))::INT AS n_bytes_left, md5(kept) AS text_md5 FROM documents LEFT JOIN edited USING (doc_id)"""

OP5_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
               FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"""

OP6_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
         d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(body)) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM d"""


_FINE = "vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"

OP11_SQL = f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
               FROM embeddings WHERE label IS NOT NULL AND {_FINE}),
         s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::BIGINT AS score
               FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
         p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
         n AS (SELECT anchor_id, positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                      row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
               FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def _op12_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Rounds as chained tables: distances of every row to every centroid, nearest by a sort, means by a sum per component."""
    ctes = [f"""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
          FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
            f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS m FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS (SELECT row, vec_id, v, cluster, distance FROM
          (SELECT row, vec_id, v, cluster, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS distance FROM v, c{i})
          QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS (SELECT c{i}.cluster, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN
          (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS m FROM
            (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY cluster, i) GROUP BY cluster) n USING (cluster))""")
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def oracle_sql():
    return {"op1_mixing": _op1_sql(), "op4_line_dedup": OP4_SQL, "op5_topk": OP5_SQL, "op6_warc": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_centroids": _op12_sql()}
