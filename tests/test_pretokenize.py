from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.functions.pretokenize import NAMED, pieces
from weftline.functions.pretokenize import splitter

GOLDEN = [
    ("gpt2", "Hello, world!", "Hello|,| world|!"), ("gpt2", "don'ts", "don|'t|s"), ("gpt2", "a   b", "a|  | b"), ("gpt2", "x ¹", "x| ¹"), ("gpt2", "\tword", "\t|word"),
    ("gpt2", "a\xa0\xa0b", "a|\xa0|\xa0|b"), ("gpt2", "\x0b\x0b!", "\x0b|\x0b|!"),
    ("cl100k", "12345", "123|45"), ("cl100k", "DON'T", "DON|'T"), ("cl100k", "a”\n\nb", "a|”\n\n|b"), ("cl100k", "a\n \nb", "a|\n \n|b"), ("cl100k", "a  \n  b", "a|  \n| | b"),
    ("o200k", "XMLHttpRequest", "XMLHttp|Request"), ("o200k", "don'ts", "don't|s"), ("voyage", "12345", "1|2|3|4|5"), ("smollm", "a 1 b", "a| |1| b"), ("smollm", "a\n\n½ cup", "a|\n\n|½| cup"),
    ("deepseek", "O'Toole", "O|'Toole"), ("deepseek", "x «y", "x| «|y"), ("deepseek", "values ​​that", "values| ​|​|that"), ("qwen", "O'Toole", "O|'T|oole"), ("qwen", "smart”\n\nM", "smart|”\n\n|M"),
    ("bert", "Hello, world!", "Hello|,|world|!"), ("bert", "你好ab", "你|好|ab"), ("units", "▁a▁▁bc", "▁a|▁▁bc"),
]
EDGES = ["", " ", "'", "é", "👍🏽", "x" * 33, "word " * 40, "日本語 mixed Latin", "​", "a­ b", "\x01", "\r\n", "a\r\n\r\nb", "\t\tx", "a\xa0\xa0b", "  lead", "trail  ", "don't DON'T", "a1b22c333d4444", "<<>>", "नमस्ते दुनिया", "\n \n"]


@pytest.mark.parametrize("name", sorted({n for n, _, _ in GOLDEN}))
def test_goldens(spark, name):
    own = [(t, p) for n, t, p in GOLDEN if n == name and "​" not in t]
    df = spark.createDataFrame([(t,) for t, _ in own], "t string").select("t", pieces(F.col("t"), name).alias("p"))
    assert {r.t: "|".join(r.p) for r in df.collect()} == dict(own)


@pytest.mark.parametrize("name", ["gpt2", "cl100k", "o200k", "voyage", "smollm", "deepseek", "qwen"])
def test_nothing_is_lost(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t in EDGES], "text string"))
    assert docs.where(F.array_join(pieces(F.col("text"), name), "") != F.col("text")).count() == 0


@pytest.mark.parametrize("name", ["gpt2", "cl100k", "o200k", "voyage", "smollm", "deepseek", "qwen", "bert"])
def test_spark_and_python_agree(spark, sf_dir, name):
    rows = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + EDGES
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", pieces(F.col("t"), name).alias("p"))
    for r in df.collect():
        assert r.p == splitter(name)(r.t), r.t[:40]


def test_null_and_behaviours(spark):
    df = spark.createDataFrame([(None,), ("a-b--c",)], "t string")
    got = {b: [r.p for r in df.select(pieces(F.col("t"), (("-", b),)).alias("p")).collect()] for b in ("matches", "isolated", "removed", "with_previous", "with_next")}
    assert all(v[0] is None for v in got.values())
    assert {k: v[1] for k, v in got.items()} == {
        "matches": ["-", "-", "-"], "isolated": ["a", "-", "b", "-", "-", "c"], "removed": ["a", "b", "c"], "with_previous": ["a-", "b-", "-", "c"], "with_next": ["a", "-b", "-", "-c"],
    }
    assert set(NAMED) >= {"gpt2", "cl100k", "o200k", "voyage", "smollm", "deepseek", "qwen", "bert"}
