from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions.charsmap import Charsmap, graphemes
from weftline.toy_models import charsmap

CASES = [
    (N.BERT_UNCASED, {"Hello World!": "hello world!", "HÉLLO": "hello", "straße": "straße", "café résumé naïve": "cafe resume naive", "ΑΣ": "ασ"}),
    (N.BERT_CASED, {"﻿Hello\x00World": "HelloWorld", "a\xa0b": "a b", "a\tb\nc\rd": "a b c d", "\x7fx�": "x"}),
    ((("nfc",),), {"é": "é", "plain": "plain"}),
    ((("metaspace", "always"),), {"Hello world": "▁Hello▁world", " spaces": "▁▁spaces", "": ""}),
    ((("metaspace", "unless_led"),), {" a": "▁a", "a": "▁a", "▁a": "▁a"}),
    ((("metaspace", "never"),), {"Hello world": "Hello▁world"}),
    ((("sentencepiece",),), {"  Hello   world\n": "▁Hello▁world", "": "▁", "ﬁx": "▁fix"}),
    ((("sentencepiece_lowercase",),), {"  Héllo   Wörld\n": "▁hello▁world"}),
    ((("punct_pad", b""),), {"a.b  c": "▁a▁.▁b▁c", "  ": "", ".": "▁.", "a..": "▁a▁.▁."}),
    ((("replace", " ", "---"),), {"a b c": "a---b---c"}),
    ((("replace", "", "x"),), {"a b c": "a b c"}),
    ((("replace_regex", r"\s+", " "),), {"a \n b": "a b"}),
    ((("strip", True, False),), {"  a ": "a "}),
    ((("space_cjk",),), {"a你b": "a 你 b"}),
    ((("lowercase",),), {"ÀΣ Σ": "àσ σ"}),
    ((("prepend", "▁"),), {"a": "▁a", "": ""}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_goldens(spark, k):
    steps, cases = CASES[k]
    f = N.normalizer(steps)
    assert {t: f(t) for t in cases} == cases
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", N.normalize(F.col("t"), steps).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {**cases, None: None}


@pytest.mark.parametrize("steps", [s for s, _ in CASES if N.is_native(s)])
def test_native_is_python(spark, sf_dir, steps):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(80)
    f = N.normalizer(steps)
    for r in docs.select("text", N.normalize(F.col("text"), steps).alias("n")).collect():
        assert r.n == f(r.text)


def test_charsmap():
    m = Charsmap(charsmap({"a": "A", "b": "xyz", "\t": " "}))
    assert m.apply("abc\t") == "Axyzc "
    steps = (("precompiled_metaspace", charsmap({"a": "A"}), False),)
    assert N.normalizer(steps)("a  b ") == "▁A▁b▁"
    assert N.normalizer((("precompiled_metaspace", charsmap({"a": "A"}), True),))(" a  b ") == "▁A▁b"
    with pytest.raises(ValueError, match="cut short"):
        Charsmap(b"\xff\0\0\0")


def test_graphemes():
    assert graphemes("a\r\nb") == ["a", "\r\n", "b"]
    assert graphemes("éx") == ["é", "x"]


def test_unknown_step():
    with pytest.raises(ValueError, match="nothing"):
        N.normalizer((("nothing",),))
