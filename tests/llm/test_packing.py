from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from weftline.llm import packing, tokens

from .helpers import ODD, documents, made_text


def best_fit(lengths, capacity):
    """Bins of plain best-fit descending, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def packed(spark, lengths, capacity):
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    return packing.pack(df, capacity).collect()


def holds(rows, lengths, capacity):
    seen = Counter()
    for r in rows:
        assert r.used == sum(p.length for p in r.pieces) <= capacity
        assert list(r.doc_ids) == [p.doc_id for p in r.pieces]
        for p in r.pieces:
            seen.update((p.doc_id, x) for x in range(p.start, p.start + p.length))
    assert seen == Counter((i, x) for i, n in enumerate(lengths) for x in range(n))
    assert len({r.bin_id for r in rows}) == len(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_piece_once_and_no_worse_than_best_fit(spark, seed):
    rng = random.Random(seed)
    capacity = 64
    lengths = [rng.choice([0, 1, 5, rng.randint(1, 64), rng.randint(1, 30), 200]) for _ in range(400)]
    rows = packed(spark, lengths, capacity)
    holds(rows, lengths, capacity)
    pieces = [p for n in lengths for p in [capacity] * (n // capacity) + ([n % capacity] if n % capacity else [])]
    assert len(rows) <= best_fit(pieces, capacity) + 1


def test_exact_complements_fill_bins(spark):
    lengths = [40, 24, 50, 10, 4, 30, 20, 10, 4] + [33, 31] * 20
    rows = packed(spark, lengths, 64)
    holds(rows, lengths, 64)
    assert len(rows) == len(lengths and [1] * -(-sum(lengths) // 64))


def test_plan_uses_what_there_is():
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = np.zeros(33, np.int64)
        counts[1:] = rng.integers(0, 6, 32) * rng.integers(0, 2, 32)
        used = Counter()
        for lengths, times in packing.plan(counts, 32):
            assert sum(lengths) <= 32 and times > 0
            for v in lengths:
                used[v] += times
        assert used == Counter({k: int(v) for k, v in enumerate(counts) if v})


def fills(counts, capacity):
    """Whether some four pieces or fewer fill a bin exactly, by trying all."""
    own = [v for v, n in enumerate(counts) for _ in range(min(int(n), 4))]
    return any(sum(c) == capacity for k in (1, 2, 3, 4) for c in combinations(own, k))


def test_no_exact_combination_is_left():
    rng = np.random.default_rng(9)
    for _ in range(60):
        counts = np.zeros(25, np.int64)
        counts[1:] = rng.integers(0, 4, 24) * rng.integers(0, 2, 24)
        bins, left = packing.complements(counts, 24)
        assert all(sum(lengths) == 24 and len(lengths) <= 4 for lengths, _ in bins)
        assert not fills(left, 24)
        used = Counter()
        for lengths, times in bins:
            for v in lengths:
                used[v] += times
        assert all(used[v] + (left[v] if v < len(left) else 0) == counts[v] for v in range(25))


def test_plan_against_the_fewest_bins():
    """Of all ways to pack small sets, none takes more than one bin fewer."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = sorted(rng.integers(1, 13, 8).tolist(), reverse=True)

        def fewest(k, gaps, best):
            if len(gaps) >= best:
                return best
            if k == len(lengths):
                return len(gaps)
            for i in range(len(gaps)):
                if gaps[i] >= lengths[k]:
                    best = min(best, fewest(k + 1, (*gaps[:i], gaps[i] - lengths[k], *gaps[i + 1 :]), best))
            return min(best, fewest(k + 1, (*gaps, 12 - lengths[k]), best))

        counts = np.bincount(lengths, minlength=13)
        assert sum(t for _, t in packing.plan(counts, 12)) <= fewest(0, (), 9) + 1


def test_many_blocks_deal_each_piece_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)
    lengths = [10, 20, 34, 64, 64, 130] * 30
    holds(packed(spark, lengths, 64), lengths, 64)


def test_clashing_columns(spark):
    docs = documents(spark, [(k, "some words in a text " * k) for k in range(5)]).selectExpr("*", "1 as block", "2 as length", "3 as k", "4 as start", "5 as bin_id")
    rows = packing.best_fit_packing(docs).collect()
    assert {i for r in rows for i in r.doc_ids} == {1, 2, 3, 4}


def test_lengths_are_those_of_the_tokenizer(spark):
    rng = random.Random(6)
    rows = [(k, made_text(rng, k * 3)) for k in range(30)] + ODD
    got = Counter((r.doc_id, r.length) for r in packing.token_lengths(documents(spark, rows)).collect())
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    assert got == Counter((i, len(encode(t))) for i, t in rows if t is not None)


def test_odd_rows(spark):
    rows = packing.best_fit_packing(documents(spark, ODD)).collect()
    ids = Counter(i for r in rows for i in set(r.doc_ids))
    assert 901 not in ids and 900 not in ids and None in ids
    assert sum(p.doc_id == 904 and p.start == 0 for r in rows for p in r.pieces) == 2
    assert packing.best_fit_packing(documents(spark, ODD).where("false")).count() == 0
    assert packing.best_fit_packing(documents(spark, [(1, "")])).count() == 0
