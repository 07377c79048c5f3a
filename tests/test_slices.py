"""What a worker holds doesn't grow with a batch or with what it has seen."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline import toy_models, workers
from weftline.functions import decode
from weftline.operators import batch, chunks, cores, diff
from weftline.operators import encode as E
from weftline.operators.tokenizer import Tokenizer
from weftline.spec import AddedToken, ModelSpec


class Shared:
    def __init__(self, value):
        self.value = value


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abthein") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_batches_are_worked_on_in_slices():
    texts, lists = pa.array(["x" * 1000] * 50 + [None, "", "y" * 9000]), pa.array([[1] * 100] * 50 + [None, [], [2] * 4000], pa.list_(pa.int32()))
    got = list(workers.sliced((texts, lists), 5000))
    assert pa.concat_arrays([t for t, _ in got]).equals(texts) and pa.concat_arrays([x for _, x in got]).equals(lists)
    assert all(t.get_total_buffer_size() and sum(len(x or "") for x in t.to_pylist()) <= 5000 or len(t) == 1 for t, _ in got) and len(got) > 10


def test_a_column_in_slices(spark, monkeypatch):
    @workers.in_slices("int")
    def rows_at_once(texts):
        return pa.array([len(texts)] * len(texts), pa.int32())

    df = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).alias("t"))
    assert df.select(rows_at_once("t").alias("n")).agg(F.max("n")).first()[0] <= workers.STEP // 4000 + 1


@pytest.mark.parametrize("options", [{}, {"unk_id": 300}, {"ignore_merges": True}])
@pytest.mark.parametrize("low", [0, 98])
def test_many_pieces_at_once(low, options):
    letters = toy_models.letters()
    spec = ModelSpec(encoder="bpe", vocab=letters.vocab[low:], merges=letters.merges, **options)
    pieces = [*(w.encode() for w in words(1, 500)), b"", b"a", b"\xff", "é".encode() * 40]
    ids, sizes, count = batch.Merges(spec)(pieces)
    bounds, run = np.append(0, np.cumsum(np.maximum(count, 0))), cores.bpe(spec)
    for k, p in enumerate(pieces):
        own = slice(bounds[k], bounds[k + 1])
        assert (None if count[k] < 0 else list(zip(ids[own].tolist(), sizes[own].tolist()))) == (run(p) if p else []), p


@pytest.mark.parametrize("pairs", [[(b"t", b"h")], [(b"a", b"a"), (b"aa", b"a"), (b"t", b"h")], [(b"i", b"n"), (b"th", b"e"), (b"t", b"h")][::2]])
def test_flat_merges(pairs):
    spec = toy_models.bpe_bytes(*pairs)
    assert batch.in_order(spec) and E.by_bytes(spec)
    texts = ["", *words(2, 300), "th" * 500, "a" * 501, None]
    ids, _, bounds, _ = E.Flat(spec).lists(pa.array(texts))
    run = cores.bpe(spec)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == ([i for i, _ in run(t.encode())] if t else [])


def test_whole_texts_are_not_kept():
    spec = toy_models.bpe_bytes((b"t", b"h"))
    E.text_lists(Shared(spec), pa.array(words(3, 100)))
    E.byte_lists(Shared(spec), pa.array([w.encode() for w in words(3, 100)]))
    assert not E.worker(Shared(spec)).memo


def test_the_memo_counts_what_python_needs(monkeypatch):
    monkeypatch.setattr(E, "MEMO", 1 << 20)
    encode = E.Worker(toy_models.pieces_unigram())
    for w in words(4, 5000):
        encode(w.encode())
    assert len(encode.memo) * 400 < 1 << 20


def test_chunks_are_kept_in_a_table_of_fixed_size(monkeypatch):
    monkeypatch.setattr(chunks, "PLACES", 64)
    work = chunks.Chunks(lambda text, first, whole: ([len(text)], [1]))
    texts = chunks.Texts(lambda text, first, whole: [text[:1], text[1:]])
    for seed in range(3):
        own = [" ".join(words(10 * seed + k, 20)) for k in range(30)] * 2
        values, _, bounds, _ = work.lists(pa.array(own))
        assert values.tolist() == [len(w) + (k > 0) for t in own for k, w in enumerate(t.split(" "))]
        parts, bounds = texts.texts(pa.array(own))
        got = pa.concat_arrays(parts).to_pylist()
        assert ["".join(got[a:b]) for a, b in zip(bounds, bounds[1:])] == own
    assert len(work.hash) == len(texts.hash) == 64


def test_texts_with_added_tokens_are_not_kept_whole():
    spec = ModelSpec(encoder="bpe", vocab=toy_models.letters().vocab, merges=toy_models.letters().merges, pretokenizer="gpt2", added=(AddedToken(900, "the", lstrip=True), AddedToken(901, "<x>", normalized=False)))
    shared, texts = Shared(spec), [f"a {w} the <x><x>b the the {w}" for w in words(5, 60)] + ["", None, "the", "no"]
    ids, sizes, bounds, _ = E.text_lists(shared, pa.array(texts * 2))
    parts, encode = E.prepared(spec), E.worker(shared)
    for k, t in enumerate(texts * 2):
        want = [([i], [len(spec.tokens.get(i, b""))]) if i is not None else encode(p.encode()) for i, p in parts(t or "")]
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [x for a, _ in want for x in a]
        assert sizes[bounds[k] : bounds[k + 1]].tolist() == [x for _, b in want for x in b]
    assert not any(len(t or "") > 20 and t.encode() in encode.memo for t in texts)
    assert chunks._kept["encode", spec.key].used < sum(len(t or "") for t in texts)


def test_bytes_with_null_and_empty(spark):
    df = spark.createDataFrame([(b"ab",), (b"",), (None,), (b"\xff\x00",)], "b binary")
    assert [r.x for r in df.select(Tokenizer(toy_models.bpe_bytes()).encode_bytes(F.col("b")).alias("x")).collect()] == [[97, 98], [], None, [255, 0]]


def test_a_character_is_looked_up_once(monkeypatch):
    """Normalizers that go over every character of a text ask for each distinct one alone."""
    from weftline.functions import normalize as N

    asked = []
    monkeypatch.setattr(N, "unicodedata", type("U", (), {"category": staticmethod(lambda c, own=N.unicodedata: asked.append(c) or own.category(c)), "normalize": staticmethod(N.unicodedata.normalize)}))
    for steps in ((("sentencepiece_lowercase",),), (("sentencepiece",),), (("clean",),)):
        before = len(asked)
        N.normalizer(steps)("Tous ℗℘­\t\x01 été " * 500)
        assert len(asked) - before < 60
    assert N.normalizer((("sentencepiece_lowercase",),))(" \x01É­Σ　a�\tb ") == "▁eσ▁a▁b"
    assert N.normalizer((("sentencepiece",),))("a​b\x01c") == "▁a▁bc"


def test_written_files_are_of_bounded_size(spark, sf_dir, monkeypatch):
    from weftline import public_queries as Q

    monkeypatch.setattr(Q, "_PER_FILE", 5)
    files = spark.read.format("binaryFile").load(Q._files(spark, sf_dir)).count()
    assert files >= 20


def test_files_are_encoded_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the one|another|in the end")
    done = Tokenizer(toy_models.letters()).encode_files_flat(spark, str(tmp_path), "|").select("ids", "n", "start")
    rows = sorted(done.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, rows[0].n, rows[0].n + rows[1].n]
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") == 1


def told_by_rows(t, x, y, ta, tb, limit):
    """``diff`` of one text, token by token."""
    if t is None or x is None or y is None:
        return None
    raw, found, size = t.encode(), [], 0
    shown = lambda i, tokens: tokens.get(i, f"<unk:{i}>".encode())

    def spans(ids, tokens):
        at, out = 0, []
        for i in ids:
            out.append({"id": i, "start": at, "end": (at := at + len(shown(i, tokens))), "text": shown(i, tokens).decode(errors="replace")})
        return out

    a, b = spans(x, ta), spans(y, tb)
    place = {(s["id"], s["start"], s["end"]): k for k, s in enumerate(b) if s["end"] > s["start"]}
    same = [(k, place[s["id"], s["start"], s["end"]]) for k, s in enumerate(a) if (s["id"], s["start"], s["end"]) in place]
    for (p, q), (p_end, q_end) in zip([(-1, -1), *same], [*same, (len(a), len(b))]):
        if own := [*a[p + 1 : p_end], *b[q + 1 : q_end]]:
            start, end = min(s["start"] for s in own), max(s["end"] for s in own)
            size += end - start
            found.append({"start": start, "end": end, "text": raw[start:end].decode(errors="replace"), "a": a[p + 1 : p_end], "b": b[q + 1 : q_end]})
    rate = 1 - size / len(raw) if raw else 1.0
    return {"text_bytes": len(raw), "tokens_a": len(x), "tokens_b": len(y), "diff_count": len(found), "diff_bytes": size, "match_rate": rate, "truncated": len(found) > limit, "regions": found[:limit]}


@pytest.mark.parametrize("limit", [0, 2, 100])
def test_rows_are_compared_on_flat_arrays(limit):
    rng = random.Random(6)
    a, b = toy_models.bpe_bytes((b"a", b"b")), toy_models.bpe_bytes((b"t", b"h"), (b"\xc3", b"a"))
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("abthé x") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    lists = []
    for run in (cores.bpe(a), cores.bpe(b)):
        own = [None if t is None or rng.random() < 0.05 else [i for i, _ in run(t.encode())] for t in texts]
        # some ids aren't known, one has no bytes, some end early
        lists.append([x and [*(999 if rng.random() < 0.02 else 998 if rng.random() < 0.02 else i for i in x)][: len(x) - (rng.random() < 0.1)] for x in own])
    ta, ids = a.tokens | {999: b""}, pa.list_(pa.int32())
    got = diff.compared(pa.array(texts), pa.array(lists[0], ids), pa.array(lists[1], ids), ta, b.tokens, limit).to_pylist()
    assert got == [told_by_rows(t, x, y, ta, b.tokens, limit) for t, x, y in zip(texts, *lists)]
    assert diff.compared(pa.array([], pa.string()), pa.array([], ids), pa.array([], ids), ta, b.tokens, limit).to_pylist() == []


@pytest.mark.parametrize("content,flags", [("the", {"single_word": True}), ("the", {}), ("é", {"single_word": True}), ("-", {"single_word": True}), ("aba", {"single_word": True}), ("the", {"single_word": True, "lstrip": True})])
@pytest.mark.parametrize("model", ["bytes", "letters"])
def test_one_added_token_is_looked_for_in_bytes(content, flags, model, monkeypatch):
    rng = random.Random(8)
    letters = toy_models.letters()
    spec = ModelSpec(encoder="bpe", vocab=letters.vocab, merges=letters.merges if model == "letters" else (), pretokenizer="gpt2", added=(AddedToken(900, content, **flags),))
    texts = [None, "", content, content * 3, *("".join(rng.choice([content, content, "a", "ab", "é", "字", "_", "1", "½", " ", ".", "-", "x the ", "́", "👍"]) for _ in range(rng.randint(1, 25))) for _ in range(400))]
    looked = []
    monkeypatch.setattr(E, "segments", lambda text, *more, own=E.segments: looked.append(text) or own(text, *more))
    ids, sizes, bounds, null = E.text_lists(Shared(spec), pa.array(texts))
    in_bytes = not flags.get("lstrip") and content != "aba"
    assert bool(looked) != in_bytes
    parts, encode = E.prepared(spec), E.worker(Shared(spec))
    for k, t in enumerate(texts):
        want = [([i], [len(spec.tokens.get(i, b""))]) if i is not None else encode(p.encode()) for i, p in parts(t or "")]
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [x for a, _ in want for x in a], t
        assert sizes[bounds[k] : bounds[k + 1]].tolist() == [x for _, b in want for x in b], t
    assert null.tolist() == [t is None for t in texts]


def test_ranks_of_rules_by_slots():
    rules = np.random.default_rng(3).integers(0, 200, (20_000, 2)).tolist()
    first = {tuple(pair): rank for rank, pair in reversed(list(enumerate(rules)))}
    merges = batch.Merges(ModelSpec(encoder="bpe", vocab=toy_models.letters().vocab, merges=tuple((a, b, 1) for a, b in rules)))
    left, right = np.repeat(np.arange(-1, 201), 202), np.tile(np.arange(-1, 201), 202)
    assert merges.count.max() > 1
    assert merges._ranks(left.astype(np.int32), right.astype(np.int32)).tolist() == [first.get(pair, batch._FAR >> 6) for pair in zip(left.tolist(), right.tolist())]


def test_decoded_bytes_stay_where_the_gather_put_them(monkeypatch):
    """Rows of tokens are joined by their bounds alone, without another copy of their bytes."""
    spec, gathered = toy_models.letters(), []
    take = decode.Pool.take
    monkeypatch.setattr(decode.Pool, "take", lambda self, ids: gathered.append(take(self, ids)) or gathered[-1])
    lists = [[116, 104, 256], [], None, [101, 32, 195, 169], [300_000], [97, None], [-1], [195], [258]]
    told = [None if x is None or any(i not in spec.tokens for i in x) else b"".join(spec.tokens[i] for i in x) for x in lists]
    text = [None if x in (None, b"\xc3") else x.decode() for x in told]
    for kind in (pa.int32(), pa.int64()):
        column = pa.array(lists, pa.list_(kind))
        assert decode.bytes_array(column, spec).to_pylist() == told and decode.text_array(column, spec, frozenset()).to_pylist() == text
        assert decode.bytes_array(column.slice(3, 2), spec).to_pylist() == told[3:5]
        assert decode.text_array(column, spec, frozenset({104, 300_000})).to_pylist() == [text[0].replace("h", "", 1), *text[1:4], "", *text[5:]]
        for form in (lambda x: decode.bytes_array(x, spec), lambda x: decode.text_array(x, spec, frozenset())):
            assert form(column.slice(3, 1)).buffers()[2].address == gathered[-1][0].buffers()[2].address
