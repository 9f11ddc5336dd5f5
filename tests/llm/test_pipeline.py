import importlib
import subprocess
import sys

import corpus_pipeline as P
import llm_odd as odd
from vigilia.llm import decontam, quality

SF = "/root/testdata/sf0.001"


def test_stages_edit_and_filter_as_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    good = P.quality_stage(spark, docs, SF)
    assert good.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, quality.fit(docs, labels)).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}
    lines = P.line_stage(spark, good, SF)
    assert lines.columns == docs.columns and lines.count() == good.count()
    single = P.near_duplicate_stage(spark, lines, SF)
    assert single.columns == docs.columns
    clean = P.decontamination_stage(spark, single, SF)
    flagged = {r.doc_id for r in decontam.contamination(single, bench).collect() if r.contaminated}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - flagged
    mixed = P.mixing_stage(spark, clean, SF)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    whole = P.run(spark, SF)
    assert sorted(map(str, whole.select("doc_id", "epoch", "take_tokens").collect())) == sorted(map(str, mixed.select("doc_id", "epoch", "take_tokens").collect()))


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd.docs(spark), odd.empty(spark)):
        for _, stage in P.STAGES:
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns)
            out.collect()


def test_entry_imports_without_the_subpackage():
    code = "import sys; sys.modules['vigilia.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=P.__file__.rpartition("/")[0], capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) >= 120, out.stderr
    assert importlib.import_module("__spark_entry__").queries()["pipeline"]
