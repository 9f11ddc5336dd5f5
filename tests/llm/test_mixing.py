from collections import defaultdict

import llm_odd as odd
from pyspark.sql import functions as F
from vigilia.llm import mixing


def plain(caps, weights, budget):
    """Water filling by repeated rounds: whoever can't take its share takes all it has."""
    out, live, left = dict.fromkeys(caps, 0), {k for k in caps if weights[k] > 0 and caps[k] > 0}, budget
    while live:
        total = sum(weights[k] for k in live)
        full = {k for k in live if caps[k] * total <= weights[k] * left}
        if not full:
            for k in live:
                out[k] = weights[k] * left // total
            break
        for k in full:
            out[k] = caps[k]
        left -= sum(caps[k] for k in full)
        live -= full
    return out


def budgets(leaves, weights, budget, epochs):
    """leaves: path tuple -> tokens."""
    cap = defaultdict(int)
    for path, tokens in leaves.items():
        for i in range(len(path) + 1):
            cap[path[:i]] += tokens * epochs
    given = {(): min(budget, cap[()])}
    for depth in range(3):
        for parent in [p for p in cap if len(p) == depth]:
            kids = {p: cap[p] for p in cap if len(p) == depth + 1 and p[:depth] == parent}
            given |= plain(kids, {p: weights.get("/".join(p), 1) for p in kids}, given[parent])
    return {p: given[p] for p in leaves}


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = {("a", "x", "1"): 100, ("a", "x", "2"): 5, ("a", "y", "1"): 10, ("b", "x", "1"): 1000, ("b", "z", "9"): 0, ("c", "q", "1"): 7}
    for weights, budget, epochs in (({}, 300, 1), ({"a": 5, "b": 1, "c": 3, "a/x/2": 50}, 90, 2), ({"a": 0}, 500, 3), ({"b": 2}, 10**6, 2), ({}, 0, 1)):
        df = spark.createDataFrame([(*p, 1, t) for p, t in leaves.items()], "l1 string, l2 string, l3 string, docs long, tokens long")
        got = {(r.l1, r.l2, r.l3): r.budget for r in mixing.leaf_budgets(df, 3, weights, budget, epochs).collect()}
        assert got == budgets(leaves, weights, budget, epochs), (weights, budget)


def test_mix_takes_each_leafs_budget_as_epochs_and_a_prefix(spark):
    docs = odd.docs(spark)
    levels = [F.lit("d"), F.col("lang"), F.col("source")]
    for share, per_range, few in ((250, 2, 1000), (600, 4096, 1000), (1700, 3, 1000), (600, 2, 0)):
        out = mixing.mix(docs, levels, {"d/en": 3}, budget_thousandths=share, max_epochs=2, per_range=per_range, few_leaves=few).collect()
        tokens, taken, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
        for i, text, lang, source, *_ in odd.rows():
            leaves["d", str(lang or "null"), str(source or "null")] += len((text or "").encode().split())
        want = budgets(leaves, {"d/en": 3}, sum(leaves.values()) * share // 1000, 2)
        for r in out:
            taken["d", r.lang or "null", r.source or "null"] += r.take_tokens
            tokens[r.epoch] += 1
            assert 0 <= r.take_tokens <= r.n_tokens and r.row == "x"
        assert {p: t for p, t in taken.items() if t} == {p: b for p, b in want.items() if b}
        cut = defaultdict(int)
        for r in out:
            cut[r.lang, r.source] += 0 < r.take_tokens < r.n_tokens
        assert max(cut.values(), default=0) <= 1  # only the row at a prefix's end is cut


def test_empty_table_and_no_budget(spark):
    levels = [F.lit("d"), F.col("lang"), F.col("source")]
    assert mixing.mix(odd.empty(spark), levels, {}).count() == 0
    assert mixing.mix(odd.docs(spark), levels, {}, budget_thousandths=0).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(odd.docs(spark), [F.col("lang")], {})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
