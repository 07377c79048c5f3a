from __future__ import annotations

import random
from collections import Counter
from math import log

import pyarrow as pa
import pytest

from weftline.llm import language
from weftline.llm.text import slices

from .helpers import DOCS, ODD

LETTERS = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "klmnopéü"}


def table(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(LETTERS))
        text = " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(2, 30)))
        rows.append((k, text, lang, "s", len(text)))
    return rows, spark.createDataFrame(rows, DOCS)


def test_held_out_accuracy(spark):
    rows, docs = table(spark)
    hidden = docs.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, lang, null) as lang")
    got = {r.doc_id: r.language for r in language.identify_language(hidden).collect()}
    held = [r for r in rows if r[0] % 2]
    assert sum(got[r[0]] == r[2] for r in held) >= 0.97 * len(held)


def test_scores_one_by_one():
    """Batch scores are those of a plain naive Bayes over the same buckets."""
    texts = ["Abc abc é", "xyz", "", "a"]
    bits = 6

    def grams(t, n):
        for _, _, buf, off in slices(pa.array([t])):
            if len(buf):
                cp, bounds = language.characters(buf, off)
                return language.hashed(cp, bounds, n, bits)[0].tolist()
        return []

    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (3, 2, 1 << bits)).astype(float)
    model = language.Model(["a", "b", "c"], counts, 2, bits)
    (s, _, size), = [model.score(buf, off) for _, _, buf, off in slices(pa.array(texts), 1 << 30)]
    assert size.tolist() == [len(t) for t in texts]
    for k, t in enumerate(texts):
        for lang in range(3):
            want = sum(c * log((counts[lang, n - 1, g] + 0.5) / (counts[lang, n - 1].sum() + 0.5 * (1 << bits))) for n in (1, 2) for g, c in Counter(grams(t, n)).items())
            assert abs(s[k, lang] - want) <= 1e-5 * max(1, abs(want))


def test_odd_rows(spark):
    _, docs = table(spark, 60)
    odd = spark.createDataFrame([(i, t, "aa" if i == 908 else None, "s", 0) for i, t in ODD], DOCS)
    got = language.identify_language(docs.unionByName(odd).selectExpr("*", "1 as language", "2 as share")).collect()
    assert len(got) == 60 + len(ODD)
    by = {r.doc_id: r.language for r in got}
    assert by[900] is None and by[901] is None and by[902] is None and by[903] is None and by[904] is not None
    assert sum(r.doc_id == 904 for r in got) == 2


def test_no_labels_and_empty(spark):
    odd = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ODD], DOCS)
    assert {r.language for r in language.identify_language(odd).collect()} == {None}
    assert language.identify_language(odd.where("false")).count() == 0


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "ENTRIES", 1 << 15)
    with pytest.raises(ValueError, match="labels"):
        language.identify_language(table(spark, 60)[1])
