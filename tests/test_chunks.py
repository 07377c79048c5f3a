"""Work by chunks gives what whole texts give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline import toy_models
from weftline.functions import normalize as N
from weftline.functions import pretokenize as P
from weftline.operators import chunks
from weftline.operators import encode as E
from weftline.operators.tokenizer import Tokenizer
from weftline.spec import AddedToken, ModelSpec

PARTS = [" ", "  ", "\t", "\n", " \n", "\r\n ", "\u00a0", "\u3000", "\u2003", "\x00", "\u200b", "a", "the", "The", "É", "e\u0301", "ß", "Σ", "ﬁ", "ͺ", "½", "1", "12345", "'s", "'LL", "don't", "!", "...", "?!", "/", "#", "_", "日本", "字", "ক", "้", "👍🏽", "▁", "\u0085", "\x1c", "-", "x" * 70]


def made(seed, n=400):
    rng = random.Random(seed)
    return ["", " ", "a", *("".join(rng.choice(PARTS) + rng.choice(["", "", " ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(n))]


def table(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").repartition(3)


@pytest.mark.parametrize("name", ["gpt2", "cl100k", "o200k", "voyage", "smollm", "deepseek", "qwen", "bert", "whitespace", "whitespace_split"])
def test_pieces(spark, name):
    assert chunks.cuts_at_spaces((), name)
    df = table(spark, made(3))
    for r in df.select("t", E.split_text(F.col("t"), name).alias("a"), P.pieces(F.col("t"), name).alias("b")).collect():
        assert r.a == r.b, repr(r.t)


@pytest.mark.parametrize("name", ["digits", "punctuation", "digit_runs", None])
def test_what_joins_over_spaces_is_not_cut(name):
    assert not chunks.cuts_at_spaces((), name)
    assert not chunks.cuts_at_spaces((("sentencepiece",),), "gpt2") and not chunks.cuts_at_spaces((("replace", "a b", "c"),), "gpt2")


@pytest.mark.parametrize("steps", [N.BERT_UNCASED, (("nfkc",),), (("nfkd",), ("drop_marks",), ("lowercase",)), (("strip_accents",), ("metaspace", "always")), (("nfc",), ("replace", " ", "▁"), ("prepend", "▁")), (("nfc",), ("replace_regex", r"\s+"), )])
def test_normal_forms(spark, steps):
    steps = tuple((*s, " ") if s[0] == "replace_regex" else s for s in steps)
    whole, df = N.normalizer(steps), table(spark, made(5))
    assert chunks.local_steps(steps)
    for r in df.select("t", N.normalize(F.col("t"), steps).alias("a")).collect():
        assert r.a == (None if r.t is None else whole(r.t)), repr(r.t)


def models():
    letters = toy_models.letters()
    yield letters
    yield toy_models.words()
    yield toy_models.with_end_of_text(letters, "the")
    yield toy_models.with_end_of_text(letters, "The", lstrip=True, rstrip=True)
    yield toy_models.with_end_of_text(letters, "a", single_word=True)
    yield ModelSpec(encoder="bpe", vocab=letters.vocab, merges=letters.merges, pretokenizer="gpt2", add_prefix_space=True)
    yield ModelSpec(encoder="sp_bpe", vocab=(*letters.vocab, (letters.vocab_size, "▁".encode())), merges=letters.merges, normalizer=(("metaspace", "always"),), unk_id=0, fuse_unk=True)
    yield toy_models.pieces_unigram()
    yield ModelSpec(encoder="bpe", vocab=letters.vocab[:200], pretokenizer="bert")  # some bytes have no token
    yield ModelSpec(encoder="bpe", vocab=letters.vocab, merges=letters.merges, pretokenizer="gpt2", normalizer=(("nfc",),), added=(AddedToken(900, "THE", normalized=False),))


@pytest.mark.parametrize("k", range(10))
def test_ids(spark, k):
    """Ids, counts and places against the plan by native pieces."""
    spec = list(models())[k]
    assert E.by_chunks(spec)
    df, t = table(spark, made(7 + k, 250)), Tokenizer(spec)
    by_pieces = E.ids_of_pieces(E.pieces(F.col("t"), spec), spec)
    for r in df.select("t", t.raw_ids(F.col("t")).alias("a"), by_pieces.alias("b"), t.count_tokens(F.col("t")).alias("n")).collect():
        assert r.a == r.b, repr(r.t)
        assert r.n == (None if r.b is None else len(r.b))


@pytest.mark.parametrize("k", [0, 1, 5, 6, 7, 8])
def test_offsets(spark, k):
    spec = list(models())[k]
    df, t = table(spark, made(20 + k, 250)), F.col("t")
    by_pieces = E.offsets_of_pieces(E.normalized(t, spec), E.pieces(t, spec), spec)
    for r in df.select("t", E.offsets_of_text(t, spec).alias("a"), by_pieces.alias("b")).collect():
        assert r.a == r.b, repr(r.t)


def test_worker_forgets(spark, monkeypatch):
    monkeypatch.setattr(chunks, "KEEP_RESULTS", 50)
    work = chunks.Chunks(lambda text, first, whole: ([len(text)], [1]))
    import pyarrow as pa

    for _ in range(3):
        values, _, bounds, _ = work.lists(pa.array([f"w{k} x" for k in range(100)]))
        assert values.tolist() == [n for k in range(100) for n in (len(f"w{k}"), 2)] and bounds[-1] == 200


LETTERED = ["gpt2", "cl100k", "voyage", "qwen", *(((p, b),) for p in sorted(P.KNOWN) for b in ("isolated", "matches"))]


@pytest.mark.parametrize("how", LETTERED)
@pytest.mark.parametrize("options", [{}, {"ignore_merges": True}, {"low": 98, "unk_id": 300}, {"low": 98}])
def test_words_are_encoded_as_bytes(how, options):
    """Chunks of letters go to the encoder as spans of bytes, unsplit, and all chunks give what whole texts give."""
    import pyarrow as pa

    letters = toy_models.letters()
    own = {k: v for k, v in options.items() if k != "low"}
    spec = ModelSpec(encoder="bpe", vocab=letters.vocab[options.get("low", 0) :], merges=letters.merges, pretokenizer=how, **own)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "in", "er", "a", "S", "é", "Σ", "ж", "ʰ", "ª", "字"][: rng.choice([4, 11])]) for _ in range(rng.randint(1, 30)))
    texts = [*made(9, 150), *(rng.choice(["", " "]).join(rng.choice([word, lambda: rng.choice(PARTS), lambda: rng.choice(".,:;_'")])() for _ in range(rng.randint(1, 40))) for _ in range(150)), None]
    encode = E.Worker(spec)
    work, parts, asked = E._encoding_chunks(encode), E.prepared(spec), []
    many = work.many
    work.many = lambda chunk, *more: asked.extend(chunk) or many(chunk, *more)
    ids, sizes, bounds, bad = work.lists(pa.array(texts))
    for k, t in enumerate(texts):
        want = [encode(p.encode()) for _, p in parts(t or "")]
        assert bad[k] == (None in want), t
        if not bad[k]:
            assert list(zip(ids[bounds[k] : bounds[k + 1]].tolist(), sizes[bounds[k] : bounds[k + 1]].tolist())) == [x for a, b in want for x in zip(a, b)], t
    if chunks.of_letters((), how):
        assert asked and not any(c.removeprefix(" ").isascii() and c.removeprefix(" ").isalpha() for c in asked)
    else:
        assert "[\\p{L}]+|[\\p{N}]|" in how[0][0]
