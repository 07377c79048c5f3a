from __future__ import annotations

import datetime
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weftline import toy_models
from weftline.functions import arrays
from weftline.operators import diff
from weftline.operators.tokenizer import Tokenizer, with_starts
from weftline.plans import dedup
from weftline.spec import ModelSpec, Padding, Template, Truncation

T = None


@pytest.fixture(autouse=True)
def column(spark):
    """The text column of the tests' tables; it can't be made before there is a session."""
    global T
    T = F.col("t")


BYTES = toy_models.bpe_bytes((b"a", b"b"), template=Template.bert(1, 2))
TEXTS = ["", " ", "abab x", "é👍🏽", None, "a  b\n\nc", "Hello, World! don't 123"]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def values(df, c):
    return [r[0] for r in df.orderBy("k").select(c).collect()]


def test_encode(spark):
    t = Tokenizer(BYTES)
    got = values(rows(spark, ["ab", "", None]), t.encode(T))
    assert got[0].asDict() == {"ids": [1, 256, 2], "attention_mask": [1, 1, 1], "type_ids": [0, 0, 0], "offsets": []}
    assert got[1].ids == [1, 2] and got[2] is None
    assert values(rows(spark, ["ab"]), t.encode(T, add_special_tokens=False))[0].ids == [256]
    assert values(rows(spark, ["abc" * 4]), Tokenizer(BYTES.with_truncation(max_length=5)).encode_ids(T)) == [[1, 256, 99, 256, 2]]
    assert values(rows(spark, ["abc" * 4]), Tokenizer(BYTES.with_truncation(max_length=5, direction="left")).encode_ids(T)) == [[1, 99, 256, 99, 2]]


def test_fixed_padding_only_in_encode(spark):
    one = rows(spark, ["ab"])
    e = values(one, Tokenizer(BYTES.with_padding(length=6, pad_id=9)).encode(T))[0]
    assert e.ids == [1, 256, 2, 9, 9, 9] and e.attention_mask == [1, 1, 1, 0, 0, 0]
    assert values(one, Tokenizer(BYTES.with_padding(Padding(pad_to_multiple_of=8))).encode(T))[0].ids == [1, 256, 2]
    assert values(one, Tokenizer(BYTES.with_padding(length=6)).encode_ids(T)) == [[1, 256, 2]]


def test_batch_padding(spark):
    t = Tokenizer(BYTES.with_padding(Padding(pad_to_multiple_of=4, direction="left")))
    df = spark.createDataFrame([(0, 0, "c"), (1, 0, "cccc"), (2, 1, "c")], "k int, g int, t string")
    got = values(t.encode_batch(df, "t"), "encoding")
    assert [len(e.ids) for e in got] == [8, 8, 8] and got[0].ids == [0, 0, 0, 0, 0, 1, 99, 2]
    assert [len(e.ids) for e in values(t.encode_batch(df, "t", batch=["g"]), "encoding")] == [8, 8, 4]


def test_pairs(spark):
    df = spark.createDataFrame([(0, "ccccc", "ddd"), (1, "ccccc", "ddddd"), (2, None, "d")], "k int, a string, b string")
    t = Tokenizer(BYTES.with_truncation(max_length=8))
    e = values(df, t.encode_pair(F.col("a"), F.col("b")))
    assert e[0].ids == [1, 99, 99, 2, 100, 100, 100, 2] and e[0].type_ids == [0, 0, 0, 0, 1, 1, 1, 1]
    assert e[1].ids == [1, 99, 99, 2, 100, 100, 100, 2] and e[2] is None
    assert values(df, t.encode_pair(F.col("a"), F.col("b"), False))[0].ids == [99] * 5 + [100] * 3


@pytest.mark.parametrize("strategy", ["longest_first", "only_first", "only_second"])
def test_pair_lengths_by_the_loop(spark, strategy):
    cases = [(a, b, m) for a in range(9) for b in range(9) for m in range(0, 18, 1)]
    for m in range(18):
        df = spark.createDataFrame([(a, b) for a, b, x in cases if x == m], "a int, b int")
        for r in df.select("a", "b", *[c.alias(n) for c, n in zip(arrays.pair_lengths(F.col("a"), F.col("b"), m, strategy), "xy")]).collect():
            a, b = r.a, r.b
            while a + b > m:
                if strategy == "longest_first":
                    a, b = (a - 1, b) if a >= b else (a, b - 1)
                elif strategy == "only_first" and a:
                    a -= 1
                elif strategy == "only_second" and b:
                    b -= 1
                else:
                    break
            assert (r.x, r.y) == (a, b), (r.a, r.b, m)
        if m == 3 and strategy != "longest_first":
            break


def test_offsets(spark):
    spec = ModelSpec(encoder="wordpiece", vocab=toy_models.words().vocab, normalizer=toy_models.words().normalizer, pretokenizer="bert", unk_id=1, template=Template.bert(2, 3))
    e = values(rows(spark, ["The  HAND é xü!"]), Tokenizer(spec).encode_with_offsets(T))[0]
    text = "the  hand e xu!"
    assert (e.offsets[0].start, e.offsets[0].end) == (e.offsets[-1].start, e.offsets[-1].end) == (0, 0)
    assert "".join(text[o.start : o.end] for o in e.offsets) == "thehandexu!"
    b = values(rows(spark, ["aé b"]), Tokenizer(toy_models.bpe_bytes(pretokenizer="gpt2")).encode_with_offsets(T))[0]
    assert [(o.start, o.end) for o in b.offsets] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_counts_are_sizes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("k"), F.col("text").alias("t")).unionByName(rows(spark))
    for spec in (toy_models.letters(), toy_models.words(), toy_models.pieces_unigram(), toy_models.with_end_of_text(toy_models.letters(), "the")):
        t = Tokenizer(spec)
        assert docs.where(~t.count_tokens(T).eqNullSafe(F.when(T.isNotNull(), F.size(t.encode_ids(T, False))))).count() == 0
    assert values(rows(spark, ["abab", "c", None]), Tokenizer(BYTES).compare_count(T, 2)) == [0, -1, None]
    assert values(rows(spark, ["abab", "abc" * 3]), Tokenizer(BYTES).exceeds(T, 2)) == [False, True]


def test_round_trip_and_decoding(spark):
    t = Tokenizer(toy_models.letters())
    assert values(rows(spark), t.decode(t.encode_ids(T))) == TEXTS
    w = Tokenizer(toy_models.words())
    assert values(rows(spark, ["The hand, it is"]), w.decode(w.encode_ids(T))) == ["the hand , it is"]
    assert values(rows(spark, ["the"]), w.decode(w.encode_ids(T), False)) == ["[CLS] the [SEP]"]
    df = spark.createDataFrame([(0, [0xC3, 0xA9]), (1, [0xC3]), (2, [9999]), (3, None), (4, [])], "k int, t array<int>")
    assert values(df, Tokenizer(BYTES).decode(T)) == ["é", None, None, None, ""]
    assert [None if x is None else bytes(x) for x in values(df, Tokenizer(BYTES).decode_bytes(T))] == ["é".encode(), b"\xc3", None, None, b""]
    assert values(df, Tokenizer(BYTES).tokens(T)) == [["�", "�"], ["�"], [None], None, []]
    u = Tokenizer(toy_models.pieces_unigram())
    assert values(rows(spark, ["the and of"]), u.decode(u.encode_ids(T))) == ["the and of"]


def test_bytes_and_masks(spark):
    df = spark.createDataFrame([(0, bytearray(b"ab\xff")), (1, None), (2, bytearray())], "k int, t binary")
    assert values(df, Tokenizer(BYTES).encode_bytes(T)) == [[256, 255], None, []]
    ids = spark.createDataFrame([(0, [1, 97, 2, 1])], "k int, t array<int>")
    assert values(ids, Tokenizer(BYTES).special_tokens_mask(T)) == [[1, 0, 1, 1]]


@pytest.mark.parametrize(
    ("flags", "text", "want"),
    [
        ({}, "Hello <S> world", ["Hello ", 256, " world"]), ({}, "Hello <S>world<S>", ["Hello ", 256, "world", 256]), ({"lstrip": True}, "a  <S>  b", ["a", 256, "  b"]),
        ({"rstrip": True}, "a  <S>  b", ["a  ", 256, "b"]), ({"single_word": True}, "x<S> <S>", ["x<S> ", 256]), ({"lstrip": True, "rstrip": True}, "<S> <S>", [256, 256]), ({}, "<S>", [256]), ({}, "", []),
    ],
)
def test_added_tokens(spark, flags, text, want):
    t = Tokenizer(toy_models.with_end_of_text(toy_models.bpe_bytes(), "<S>", **flags))
    expected = [i for x in want for i in ([x] if isinstance(x, int) else x.encode())]
    assert values(rows(spark, [text]), t.encode_ids(T)) == [expected]


def test_added_tokens_after_normalization(spark):
    spec = replace(toy_models.with_end_of_text(toy_models.bpe_bytes(), "stop", normalized=True), normalizer=(("lowercase",),))
    assert values(rows(spark, ["A STOP b"]), Tokenizer(spec).encode_ids(T)) == [[97, 32, 256, 32, 98]]
    raw = replace(toy_models.with_end_of_text(toy_models.bpe_bytes(), "stop"), normalizer=(("lowercase",),))
    assert 256 not in values(rows(spark, ["A STOP b"]), Tokenizer(raw).encode_ids(T))[0]


def test_plans_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9000, ""), (9001, None), (9002, "a a a")], "doc_id long, text string"))
    for spec in (toy_models.letters(), toy_models.words(), toy_models.pieces_unigram()):
        local = {r[0]: r[1] for r in docs.select("doc_id", Tokenizer(spec).encode_ids(F.col("text"), False)).collect() if r[1] is not None}
        assert {r[0]: r[1] for r in dedup.encode_by_key(docs, spec).collect()} == local
        if spec.encoder != "unigram":
            assert {r[0]: r[1] for r in dedup.count_by_key(docs, spec).collect()} == {k: len(v) for k, v in local.items()}
    total = sum(r.n for r in dedup.token_counts(docs, toy_models.letters()).collect())
    assert total == docs.select(F.sum(Tokenizer(toy_models.letters()).count_tokens(F.col("text")))).first()[0]


def test_partitions_don_t_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100)
    ids = lambda df: {r[0]: r[1] for r in df.select("doc_id", Tokenizer(toy_models.letters()).encode_ids(F.col("text"))).collect()}
    assert ids(docs.repartition(1)) == ids(docs.repartition(8))


def test_flat_batch(spark):
    got = {r.k: r for r in Tokenizer(BYTES).encode_batch_flat(rows(spark, ["ab", None, "", "cd"]), "k", "t").collect()}
    assert [(got[k].n, got[k].start) for k in range(4)] == [(3, 0), (0, 3), (2, 3), (4, 5)]
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n long")
    assert {r.k: r.start for r in with_starts(df, "k").collect()} == {"a": 0, "b": 1}


def test_starts_of_any_keys(spark):
    """Null, text, date, repeated and many keys against a running sum; null keys come first."""
    rng = random.Random(4)
    many = [(rng.randint(-50, 10**6), rng.randint(0, 9)) for _ in range(3000)] + [(7, 3)] * 40 + [(None, 5), (None, 2)]
    for kind, rows_ in (
        ("long", [(1, 5), (None, 7), (3, 2)]), ("string", [("b", 2), ("a", 1), (None, 4), ("", 3)]), ("date", [(datetime.date(2024, 1, k), k) for k in (3, 1, 2)]), ("long", many), ("long", []), ("double", [(0.5, 1), (-2.0, 3)]),
    ):
        df = spark.createDataFrame(rows_, f"key {kind}, n long").selectExpr("*", "1 as range", "2 as before", "3 as __range", "4 as hash")
        got = with_starts(df, "key")
        assert got.columns == [*df.columns, "start"]
        own = sorted(((r.key is not None, r.key), r.start, r.n) for r in got.collect())
        assert [k for (_, k), _, _ in own] == sorted((k for k, _ in rows_), key=lambda k: (k is not None, k))
        at = 0
        for _, start, n in sorted(own, key=lambda x: (x[0], x[1], x[2])):
            assert start == at
            at += n


def test_starts_shuffle_the_rows_once(spark):
    df = Tokenizer(BYTES).encode_batch_flat(rows(spark, ["ab", "cd"]), "k", "t")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final or final.count("ArrowEvalPython") == 1


def test_one_call_for_single_and_pair(spark):
    t = Tokenizer(BYTES)
    df = spark.createDataFrame([(0, "ab", "c"), (1, "ab", None), (2, None, "c")], "k int, a string, b string")
    got = values(df, t.encode_any(F.col("a"), F.col("b")))
    pair, single = values(df, t.encode_pair(F.col("a"), F.col("b"))), values(df, t.encode(F.col("a")))
    assert got[0] == pair[0] and got[1] == single[1] and got[2] is None
    assert values(df, t.encode_any(F.col("a"))) == single


def test_bytes_stream_and_adjacency(spark):
    t = Tokenizer(toy_models.letters())
    df = spark.createDataFrame([(1, bytearray(b"the\xff"), "x")], "pos0 int, content binary, valid0 string")
    assert [(r.pos, t.spec.tokens[r.id]) for r in t.stream_bytes(df).orderBy("pos").collect()] == [(0, b"the"), (1, b"\xff")]
    pairs = spark.createDataFrame([(116, 104, 1), (104, 116, 2), (None, 3, 3)], "left int, right int, rule int")
    assert {r.rule: r.valid for r in t.adjacent(pairs).collect()} == {1: False, 2: True, 3: True}
    assert not t.spec.is_valid_pair(116, 104) and t.spec.is_valid_pair(104, 116)


def test_vocabulary(spark):
    t = Tokenizer(toy_models.letters())
    df = spark.createDataFrame([("the",), ("zzz",)], "token string")
    got = {r.token: r.id for r in t.token_to_id(df).collect()}
    assert got["zzz"] is None and t.spec.tokens[got["the"]] == b"the"
    back = t.id_to_token(spark.createDataFrame([(got["the"],), (10**6,)], "id int")).collect()
    assert {r.id: r.token_str for r in back} == {got["the"]: "the", 10**6: None}
    assert t.vocab().count() == t.spec.vocab_size and t.merges().count() == len(t.spec.merges)
    stream = t.stream_tokens(rows(spark, ["the the"]), "t").orderBy("pos").collect()
    assert [(r.pos, t.spec.tokens[r.id]) for r in stream] == [(0, b"the"), (1, b" "), (2, b"the")] or len(stream) >= 2


def test_diff(spark):
    a, b = toy_models.bpe_bytes(), toy_models.bpe_bytes((b"a", b"b"), (b"b", b"c"))
    df = rows(spark, ["xabyabc", "xyz", "", None])
    x, y = Tokenizer(a).encode_ids(T), Tokenizer(b).encode_ids(T)
    got = values(df, diff.diff(T, x, y, a, b))
    assert got[3] is None and got[1].diff_count == 0 and got[2].match_rate == 1.0
    assert [(r.start, r.end, r.text) for r in got[0].regions] == [(1, 3, "ab"), (4, 6, "ab")] and got[0].diff_bytes == 4 and abs(got[0].match_rate - 3 / 7) < 1e-12
    assert [[s.text for s in r.a] for r in got[0].regions] == [["a", "b"]] * 2 and [[s.text for s in r.b] for r in got[0].regions] == [["ab"]] * 2
    assert values(df, diff.diff(T, x, y, a, b, limit=1))[0].truncated
    assert values(df, diff.first_difference(x, y)) == [1, None, None, None]
    pairs = spark.createDataFrame([(0, [1, 2, 3], [1, 2]), (1, [1], [1]), (2, [1], [2])], "k int, a array<int>, b array<int>")
    assert values(pairs, diff.first_difference(F.col("a"), F.col("b"))) == [2, None, 0]
    assert diff.verify(df, T, x, y).first().asDict() == {"texts": 4, "passed": 3, "failed": 1, "tokens": 10}
    assert [r.at for r in diff.mismatches(df, "k", T, x, y).collect()] == [1]


def test_bad_options():
    for wrong in (lambda: Padding(direction="up"), lambda: Truncation(strategy="none"), lambda: Truncation(direction="x"), lambda: Truncation(stride=2), lambda: ModelSpec(encoder="x", vocab=())):
        with pytest.raises(ValueError, match=r"."):
            wrong()
    assert BYTES.num_special_tokens_to_add() == 2 and BYTES.num_special_tokens_to_add(True) == 3
    assert BYTES.with_padding(length=3).with_padding().padding is None
