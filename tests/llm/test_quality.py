from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from weftline.llm import quality
from weftline.llm.text import slices

from .helpers import ODD, documents, made_text


def sentences(rng, n):
    out = []
    for _ in range(n):
        out.append(made_text(rng, rng.randint(6, 14)).capitalize() + ".")
    return " ".join(out[: n // 2]) + "\n" + " ".join(out[n // 2 :])


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in made_text(rng, n * 6).split())
    if kind == 1:
        return " ".join([made_text(rng, 2)] * (n * 4))
    return made_text(rng, n * 6).upper() + "!!!!!! 99999 88888"


def corpus(seed, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        good = k % 4 != 0
        rows.append((k, sentences(rng, rng.randint(6, 20)) if good else junk(rng, rng.randint(6, 20))))
        labels.append((k, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 400)
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.quality_rules(documents(spark, rows), known).collect()}
    held = labels[300:]
    good = [i for i, q, _ in held if q]
    bad = [i for i, q, _ in held if not q]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i not in kept for i in bad) >= 0.9 * len(bad)


def test_paths_against_one_by_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    f = quality.grow(x, 20, 64)
    for row in x[:20]:
        total = 0.0
        for t in range(20):
            node = 0
            while np.isfinite(f.split[t, node]):
                node = f.left[t, node] + (row[f.feature[t, node]] >= f.split[t, node])
            total += f.path[t, node]
        assert abs(f.score(row[None])[0] - 2 ** (-total / 20 / f.norm)) < 1e-12


def test_statistics_don_t_depend_on_the_batch():
    rng = random.Random(3)
    texts = [sentences(rng, 8), "", junk(rng, 8), "a b b b a", sentences(rng, 30)]
    together = [quality.statistics(buf, off) for _, _, buf, off in slices(pa.array(texts), 1 << 30)][0]
    for k, t in enumerate(texts):
        for _, _, buf, off in slices(pa.array([t])):
            x, n = quality.statistics(buf, off)
            assert n[0] == together[1][k]
            if n[0]:
                assert np.allclose(x[0], together[0][k])


def test_stage_agrees_with_query(spark):
    rows, labels = corpus(5)
    docs, known = documents(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = sorted(str(r.doc_id) for r in quality.quality_rules(docs.where("doc_id is not null"), known).collect())
    more = docs.selectExpr("*", "1 as x", "2 as keep", "3 as score")
    kept = quality.keep_good(more, known)
    assert kept.columns == more.columns
    assert sorted(str(r.doc_id) for r in kept.where("doc_id is not null").collect()) == a


def test_without_labels_only_wordless_texts_go(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = [r.doc_id for r in quality.keep_good(docs, none).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [None, 904, 904, 905, 906, 907, 908]))
    odd = spark.createDataFrame([(None, 1, 0), (904, None, 0), (12345, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, odd).count() == 7
    assert quality.quality_rules(docs.where("false"), none).count() == 0


def test_threshold_is_the_best_of_those_that_spare_the_good(spark):
    """Against trying every threshold on every labelled row."""
    rows, labels = corpus(9, 200)
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    x = quality.features(docs)
    rules = quality.fit(x, known, clean_loss=0.02, bins=512)
    score = {r.doc_id: rules.forest.score(np.array([r.x]))[0] for r in x.collect()}
    good, bad = ([score[i] for i, q, _ in labels if q == k] for k in (1, 0))

    def value(t):
        lost, caught = (sum(s >= t for s in part) / len(part) for part in (good, bad))
        return caught - lost if lost <= 0.02 else -1

    assert abs(value(rules.threshold) - max(value(k / 512) for k in range(512))) < 1e-12
    assert rules.threshold == min(k / 512 for k in range(512) if abs(value(k / 512) - value(rules.threshold)) < 1e-12)


def test_clashing_columns(spark):
    rows, labels = corpus(5, 80)
    docs = documents(spark, rows).selectExpr("*", "1 as x", "2 as score", "3 as keep", "4 as good")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as x", "2 as good", "3 as n")
    assert quality.quality_rules(docs, known).columns == ["doc_id", "score"]
    assert quality.quality_rules(docs, known).count() > 0
