from __future__ import annotations

import random

import numpy as np
import pytest

from weftline.llm import decontaminate, fmindex

from .helpers import ODD, documents, made_text, words_of


def brute(text, items, n=8, least=5):
    """Removal spans by looking for every phrase at every word."""
    import re

    found = [m for m in re.finditer(r"\w+", text or "")]
    words = [m[0].lower() for m in found]
    spans = []
    for item in items:
        w = words_of(item)
        phrases = [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w] if len(w) >= least else []
        for p in phrases:
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    spans.append((i, i + len(p)))
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(found[a].start(), found[b - 1].end()) for a, b in merged]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    items = [made_text(rng, n) for n in (30, 12, 8, 6, 3, 40)]
    rows = []
    for k in range(40):
        text = made_text(rng, 80).split()
        if k % 3 == 0:
            own = items[k % 6].split()
            a = rng.randrange(len(text))
            text[a:a] = own[rng.randint(0, 3) :]
        if k % 7 == 0:
            text = [w.upper() + "," for w in text]
        rows.append((k, " ".join(text)))
    return rows, items


def benchmark(spark, items):
    return spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")


@pytest.mark.parametrize(("shard", "part"), [(1 << 20, 200_000), (150, 200_000), (1 << 20, 20)])
def test_against_brute_force(spark, case, shard, part):
    rows, items = case
    got = decontaminate.contaminated(documents(spark, rows), benchmark(spark, items), shard_words=shard, part=part).collect()
    want = {i: brute(t, items) for i, t in rows}
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got} == {i: s for i, s in want.items() if s}
    texts = dict(rows)
    for r in got:
        kept, at = "", 0
        for a, b in [tuple(s) for s in r.spans]:
            kept, at = kept + texts[r.doc_id][at:a], b
        assert r.clean_text == kept + texts[r.doc_id][at:]
        assert r.n_removed == sum(b - a for a, b in map(tuple, r.spans))


def test_stage_keeps_all_rows(spark, case):
    rows, items = case
    docs = documents(spark, rows + ODD).selectExpr("*", "1 as spans", "2 as start")
    got = decontaminate.decontaminate(docs, benchmark(spark, items))
    assert got.columns == docs.columns
    out = got.collect()
    assert len(out) == len(rows) + len(ODD)
    for r in out:
        if r.text is not None:
            assert brute(r.text[:4000], items) == [] or r.doc_id == 906
            assert r.n_chars == len(r.text)


@pytest.mark.parametrize("part", [200_000, 20, 5])
def test_stage_against_brute_force(spark, case, part):
    """However many parts the phrases are in, the stage cuts what brute force finds in the whole text."""
    rows, items = case
    rows = [*rows, (60, " ".join([*items[2].split(), *items[3].split(), "end"])), (60, f"x {items[5]} y {items[0]}")]  # two items that adjoin; a repeated id
    docs = documents(spark, rows)

    def cut_by_hand(text):
        kept, at = "", 0
        for a, b in brute(text, items):
            kept, at = kept + text[at:a], b
        return kept + text[at:]

    got = decontaminate.decontaminate(docs, benchmark(spark, items), part=part).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i, cut_by_hand(t)) for i, t in rows)
    assert all(r.n_chars == len(r.text) for r in got)
    told = decontaminate.contaminated(docs, benchmark(spark, items), part=part).collect()
    assert sorted((r.doc_id, r.clean_text) for r in told) == sorted((i, cut_by_hand(t)) for i, t in rows if brute(t, items))


def test_odd_and_empty(spark):
    docs, none = documents(spark, ODD), benchmark(spark, [None, "", "too short"])
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.decontaminate(docs, none).count() == len(ODD)
    hit = decontaminate.contaminated(docs, benchmark(spark, ["dolor sit amet lorem ipsum dolor sit amet lorem"])).collect()
    assert [r.doc_id for r in hit] == [906]
    assert decontaminate.contaminated(docs.where("false"), benchmark(spark, ["a b c d e f g h i"])).count() == 0


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    s = rng.integers(2, 6, 3000)
    index = fmindex.FMIndex(s, 6)
    for length in (1, 2, 3, 5):
        phrases = np.array([rng.integers(2, 6, length) for _ in range(30)], np.uint32)
        lo, hi = index.find(phrases, np.full(30, length))
        which, at = index.locate(lo, hi)
        for k, p in enumerate(phrases):
            want = [i for i in range(len(s) - length + 1) if (s[i : i + length] == p).all()]
            assert sorted(at[which == k].tolist()) == want


def test_suffix_order_of_repeats():
    s = np.append(np.tile([3, 4, 3], 200), 0)
    sa = fmindex.suffix_array(s, 3)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
