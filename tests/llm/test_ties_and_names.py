"""Ties, columns with clashing names, and what the operators' own tests leave out."""

from __future__ import annotations

from itertools import product

import numpy as np

from weftline.llm import common, decontaminate, frames, language, licenses, secrets

from .helpers import DOCS, documents

ITEM = "one two three four five six seven eight nine ten"


def test_columns_of_any_name(spark):
    docs = documents(spark, [(1, f"before {ITEM} after"), (2, "nothing of it"), (3, 'token = "0123456789abcdef0123456789abcdef01234567"'), (4, "Released under the MIT License.")])
    more = docs.selectExpr("*", "1 as spans", "2 as n_removed", "3 as clean_text", "4 as start", "5 as end", "6 as score", "7 as sha256", "8 as h", "9 as p", "1 as template", "2 as content", "3 as doc_ids", "4 as language", "5 as margin")
    item = spark.createDataFrame([(0, ITEM, 1)], "item_id int, text string, doc_id int")
    assert [r.clean_text for r in decontaminate.contaminated(more, item).collect()] == ["before  after"]
    files = frames.token_files(more).collect()
    assert sorted(i for f in files for i in f.doc_ids) == [1, 2, 3, 4]
    assert [r.doc_id for r in secrets.scan_secrets(more).collect()] == [3]
    assert [(r.doc_id, r.license) for r in licenses.scan_licenses(more).collect()] == [(4, "mit")]
    assert language.identify_language(more).columns == ["doc_id", "language", "margin"]


def test_equal_languages_give_the_first_by_name(spark):
    rows = [(k, "the same words", lang, "s", 0) for k, lang in enumerate(["zz", "aa", "mm"] * 4)]
    got = language.identify_language(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.language, r.margin) for r in got} == {("aa", 0.0)}


def test_equal_templates_give_the_first_by_name(spark):
    text = "you may do as you like with all of this work"
    (row,) = licenses.scan_licenses(documents(spark, [(1, text)]), {"z-text": text, "a-text": text}).collect()
    assert (row.license, row.start, row.end) == ("a-text", 0, len(text))


def test_licenses_side_by_side(spark):
    text = "All rights reserved. All rights reserved. All rights reserved."
    got = licenses.scan_licenses(documents(spark, [(1, text)])).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 19), (21, 40), (42, 61)]


def test_the_fields_gradient_is_that_of_all_paths():
    rng = np.random.default_rng(2)
    sequences = [(rng.integers(0, 6, (len(secrets._SIZES), n)), rng.integers(0, 3, n)) for n in (3, 1, 4)]
    w, t = rng.normal(size=(6, 2)) / 3, rng.normal(size=(3, 3)) / 2

    def loss(w, t):
        total = 0.0
        for x, y in sequences:
            e = np.zeros((len(y), 3))
            e[:, 1:] = w[x].sum(0)

            def score(path, e=e):
                steps = [0, *path, 0]
                return sum(t[a, b] for a, b in zip(steps, steps[1:])) + sum(e[i, p] for i, p in enumerate(path))

            every = np.array([score(p) for p in product(range(3), repeat=len(y))])
            total += np.log(np.exp(every - every.max()).sum()) + every.max() - score(y)
        return total / sum(len(y) for _, y in sequences)

    gw, gt = secrets._Batch([(x.copy(), y) for x, y in sequences]).slope(w, t)
    for own, got in ((w, gw), (t, gt)):
        for at in np.ndindex(own.shape):
            h = np.zeros_like(own)
            h[at] = 1e-6
            up, down = (loss(w + s * h, t) if own is w else loss(w, t + s * h) for s in (1, -1))
            assert abs((up - down) / 2e-6 - got[at]) < 1e-5


def test_names_that_are_taken(spark):
    df = spark.range(1).selectExpr("1 as Gone", "2 as _gone", "3 as x")
    assert common.fresh(df, "gone", "gone", "y") == ["__gone", "___gone", "y"]


def test_written_tables_can_be_freed(spark):
    with common.freeing() as done:
        a, b = common.cut(spark.range(3)), common.cut(spark.range(4))
        done(b)
        assert b.count() == 4 and a._weftline_path not in common._written


def test_an_undefined_shared_folder_is_an_error_on_a_cluster():
    import pytest

    class Context:
        master = "yarn"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf: dict = {}
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session())
