import __spark_entry__ as E
from oracle_harness import compare, duck
from vigilia.llm import decontam

SF = "/root/testdata/sf0.001"


def test_sql_checked_queries_match(spark):
    from vigilia.llm import catalog
    con = duck(SF)
    for name in catalog.oracle_sql():
        assert compare(spark, name, SF, con)["status"] == "ok", name


def test_contaminated_documents_match_brute_force(spark):
    from test_decontam import brute
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id for r in E.queries()["op7_decontamination"](spark, SF).collect()}
    hashed = [decontam.Tokens().of(t) for t in items]
    known = {h for t in hashed for h in t.tolist()}
    # a window needs 7 tokens of an item at least: the brute force runs on the documents that have them
    near = [d for d in docs if sum(h in known for h in decontam.Tokens().of(d.text or "").tolist()) >= 7]
    small = [d for d in near if len((d.text or "").split()) < 250]
    assert {d.doc_id for d in small if brute(d.text, items)} == got & {d.doc_id for d in small}
    assert got <= {d.doc_id for d in near} and got
