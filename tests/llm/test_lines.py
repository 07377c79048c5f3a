from __future__ import annotations

from collections import defaultdict

from weftline.llm import lines

from .helpers import ODD, documents


def brute(rows, min_sites=5, min_chars=20):
    sites, keeper = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" ")
            if len(key) >= min_chars:
                sites[key].add(site)
                keeper[key] = min(keeper.get(key, i), i)
    out = {}
    for i, text, _ in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(x.strip(" ")) >= min_chars and len(sites[x.strip(" ")]) >= min_sites and keeper[x.strip(" ")] != i)]
        out[i] = (None if text is None else "\n".join(kept), len(own) - len(kept))
    return out


def test_against_brute_force(spark):
    rows = []
    for k in range(60):
        own = [f"a line of its own, number {k}"]
        for j in range(8):
            if k % (j + 2) == 0:
                own.append(f"a line that is shared by some, number {j}")
        own.append("short")
        rows.append((k, "\n".join(own), f"site{k % 9}"))
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.line_dedup(documents(spark, rows)).collect()}
    assert got == brute(rows)
    assert sum(n for _, n in got.values()) > 20


def test_threshold_is_exact(spark):
    """One site less than the threshold is no boilerplate, whatever the sketch says."""
    for n, gone in ((4, 0), (5, 4)):
        rows = [(k, "exactly this line is on so many sites", f"s{k}") for k in range(n)]
        got = lines.line_dedup(documents(spark, rows)).collect()
        assert sum(r.n_removed for r in got) == gone


def test_many_sites(spark):
    rows = [(k, "seen on very many different sites\nown line " + "x" * k, f"s{k}") for k in range(400)]
    got = lines.line_dedup(documents(spark, rows), min_sites=300).collect()
    assert sum(r.n_removed for r in got) == 399
    rows = rows[:299]
    assert sum(r.n_removed for r in lines.line_dedup(documents(spark, rows), min_sites=300).collect()) == 0


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    got = lines.line_dedup(docs).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.text) for r in got} == {(r[0], r[1]) for r in ODD}
    assert lines.line_dedup(docs.where("false")).count() == 0


def test_columns_stay(spark):
    docs = documents(spark, [(k, f"a boilerplate line on all sites\nown {k}", f"s{k}") for k in range(6)]).selectExpr("*", "7 as pos", "8 as k1", "9 as line", "1 as __gone", "2 as __Id", "3 as __version", "4 as gone", "5 as ID", "6 as version")
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].text.startswith("a boiler") and rows[3].text == "own 3" and rows[3].n_chars == 5 and rows[3].pos == 7
