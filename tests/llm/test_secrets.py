from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import secrets
from weftline.llm.text import char_offsets, slices

from .helpers import ODD, documents


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(1)
    words = "the quick brown fox jumps over a lazy dog and then we deploy the service with care on every new release of it".split()
    snippets = [" ".join(rng.choice(words, 25)) + "." for _ in range(1500)]
    return secrets.train(*secrets.made_windows(snippets))


def found(field, texts):
    out = []
    for a, b, buf, off in slices(pa.array(texts)):
        t = secrets.Tokens(buf, off)
        first, last = secrets.spans(field.decode(field.emissions(t.features), t.at), t.at)
        rows = [[] for _ in range(b - a)]
        for r, x, y in zip(np.searchsorted(t.at, first, "right") - 1, first, last):
            raw = buf[off[r] : off[r + 1]]
            rows[r].append(tuple(int(v) for v in char_offsets(raw, np.array([t.start[x], t.end[y]]) - off[r])))
        out += rows
    return out


def test_held_out(field):
    rng = np.random.default_rng(77)
    words = "some other words that were not seen while the field was being fitted to its made windows".split()
    texts, marked = secrets.made_windows([" ".join(rng.choice(words, 20)) for _ in range(500)], windows=500, seed=31)
    got = found(field, texts)
    hit = sum(len(set(g) & set(m)) for g, m in zip(got, marked))
    assert hit >= 0.85 * sum(map(len, marked))
    assert hit >= 0.85 * sum(map(len, got))


def test_plain_prose_is_left_alone(field):
    texts = ["The cat sat on the mat. Nothing is secret here.", "Version 3.0 of 2024-01-02 has 1,234 changes.", "token ring networks need no password at all", "call +1 (323) 555-9830 or mail ann.54@mail3.example.com"]
    assert found(field, texts) == [[], [], [], []]


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        e = rng.normal(0, 2, (2, n)).astype(np.float32)
        field = secrets.Field(np.zeros((1, 2), np.float32), rng.normal(0, 1, (3, 3)))
        score = np.concatenate([np.zeros((1, n)), e])

        def value(tags, field=field, score=score, n=n):
            path = [0, *tags, 0]
            return sum(score[t, k] for k, t in enumerate(tags)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(value(t) for t in product(range(3), repeat=n))
        got = field.decode(e, np.array([0, n]))
        assert abs(value(got.tolist()) - best) < 1e-4


def test_texts_don_t_touch(field):
    a, b = 'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" and so on', "é the next text, without any"
    both = found(field, [a, b, a])
    assert both[0] == both[2] == found(field, [a])[0] and both[1] == found(field, [b])[0]
    assert [a[x:y] for x, y in both[0]] == ["2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"]


def test_rows(spark):
    secret = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"
    text = f'é the service runs with token = "{secret}" in every region'
    rows = [*ODD, (1, text), (1, text), (None, text), (2, "word " * 60_000 + text)]
    got = secrets.scan_secrets(documents(spark, rows).selectExpr("*", "1 as start", "2 as score")).collect()
    own = sorted(str(r.doc_id) for r in got if r.sha256 == hashlib.sha256(secret.encode()).hexdigest())
    assert own == ["1", "1", "2", "None"]
    assert all(text[r.start : r.end] == secret for r in got if r.doc_id == 1)
    assert {r.doc_id for r in got} <= {None, 1, 2}


def test_empty_table(spark):
    assert secrets.scan_secrets(documents(spark, []).where("false")).count() == 0
