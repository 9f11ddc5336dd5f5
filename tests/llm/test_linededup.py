from collections import defaultdict

import llm_odd as odd
from vigilia.llm import linededup


def brute(rows, min_sites):
    """(id, text) -> text without lines on min_sites sources or more, except in the first document that has them."""
    sites, first = defaultdict(set), {}
    for i, text, _, source, *_ in rows:
        for line in (text or "").split("\n"):
            if line := line.strip(" "):
                sites[line].add(source)
                if line not in first or (i is None, i or 0) < first[line]:
                    first[line] = (i is None, i or 0)
    out = []
    for i, text, *_ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or len(sites[x.strip(" ")]) < min_sites or first[x.strip(" ")] == (i is None, i or 0)]
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def test_odd_rows_match_brute_force(spark, monkeypatch):
    for min_sites, few in ((2, 10**6), (10, 10**6), (12, 0), (13, 0)):
        monkeypatch.setattr(linededup, "FEW_LINES", few)
        got = linededup.remove_boilerplate(odd.docs(spark), min_sites=min_sites)
        assert got.columns == [f.name for f in odd.SCHEMA]
        assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(
            f"Row(doc_id={i!r}, text={t!r})" for i, t in brute(odd.rows(), min_sites))


def test_lines_near_the_threshold_are_counted_exactly(spark):
    # 300 sites: the sketch of 16 registers is far off, the band wide, and the exact count decides
    rows = [(i, "wide line\n" + ("narrow line" if i < 199 else "other line"), None, f"s{i}", 0, *odd.EXTRA) for i in range(300)]
    lines = linededup._lines(linededup._rows(odd.docs(spark, rows), "doc_id", "text", "source"))
    got = {r.sites for r in linededup.boilerplate(lines, min_sites=199, lg_k=4).collect()}
    assert got == {300, 199} or got - {199} and 199 in got
    assert linededup.boilerplate(lines, min_sites=200, lg_k=4).filter("sites = 199").count() == 0
    low, high = linededup.band(10)
    assert low < 10 <= high


def test_empty_table(spark):
    assert linededup.remove_boilerplate(odd.empty(spark), lost_col="lost").count() == 0


def test_all_lines_lost_leaves_an_empty_text(spark):
    rows = [(i, "same line", None, f"s{i}", 0, *odd.EXTRA) for i in range(12)]
    got = {r.doc_id: (r.text, r.lost) for r in linededup.remove_boilerplate(odd.docs(spark, rows), lost_col="lost").collect()}
    assert got == {0: ("same line", 0)} | {i: ("", 1) for i in range(1, 12)}
