from __future__ import annotations

import random

import pytest

from weftline import toy_models
from weftline.operators.cores import bpe, core, sp_bpe, splits_at_marks, unigram, wordpiece
from weftline.spec import ModelSpec


def ids(run, text):
    got = run(text.encode())
    return None if got is None else [i for i, _ in got]


def model(kind, tokens, merges=(), **more):
    own = {t: i for i, t in enumerate(tokens)}
    return ModelSpec(encoder=kind, vocab=tuple((i, t.encode()) for t, i in own.items()), merges=tuple((own[a], own[b], own[a + b]) for a, b in merges), **more)


HELLO = toy_models.bpe_bytes((b"a", b"b"), (b"ab", b"c"), (b"l", b"l"), (b"h", b"e"), (b"ll", b"o"), (b"he", b"llo"), (b" ", b"t"), (b" t", b"he"))


@pytest.mark.parametrize(("text", "want"), [("hello", [261]), ("abcabc", [257, 257]), ("llllll", [258, 258, 258]), ("", []), (" the", [263])])
def test_bpe(text, want):
    assert ids(bpe(HELLO), text) == want


def test_bpe_by_the_definition():
    """The least rank first, the leftmost on ties, one merge at a time."""
    rank = {(a, b): (k, m) for k, (a, b, m) in enumerate(HELLO.merges)}
    rng = random.Random(1)
    run = bpe(HELLO)
    for n in range(600):
        text = "".join(rng.choice("abchelo t") for _ in range(rng.randint(0, 24) if n % 3 else rng.randint(40, 90)))
        own = list(text.encode())
        while True:
            best = min(((rank[p][0], k) for k, p in enumerate(zip(own, own[1:])) if p in rank), default=None)
            if best is None:
                break
            k = best[1]
            own[k : k + 2] = [rank[own[k], own[k + 1]][1]]
        got = run(text.encode())
        assert [i for i, _ in got] == own
        assert sum(s for _, s in got) == len(text)


def test_bpe_options():
    abc = model("bpe", ["a", "b", "c", "ab", "abc"], [("a", "b"), ("ab", "c")])
    assert [ids(bpe(abc), t) for t in ("abc", "ab", "a")] == [[4], [3], [0]]
    loose = ModelSpec(encoder="bpe", vocab=((0, b"a"), (1, b"b"), (2, b"c"), (3, b"ab"), (4, b"abc")), merges=((0, 1, 3),))
    assert ids(bpe(loose), "abc") == [3, 2]
    assert ids(bpe(ModelSpec(**{**vars_of(loose), "ignore_merges": True})), "abc") == [4]
    assert ids(bpe(abc), "x") is None
    assert ids(bpe(ModelSpec(**{**vars_of(abc), "unk_id": 9})), "axxb") == [0, 9, 9, 1]
    assert ids(bpe(ModelSpec(**{**vars_of(abc), "unk_id": 9, "fuse_unk": True})), "axxb") == [0, 9, 1]
    end = ModelSpec(encoder="bpe", vocab=((0, b"a"), (1, b"b"), (2, b"b</w>"), (3, b"ab</w>")), merges=((0, 2, 3),), word_end="</w>")
    assert ids(bpe(end), "ab") == [3] and ids(bpe(end), "bb") == [1, 2]


def vars_of(spec):
    return {k: getattr(spec, k) for k in ModelSpec.__dataclass_fields__}


def test_wordpiece():
    run = wordpiece(model("wordpiece", ["[UNK]", "un", "break", "##break", "##able", "##ing"], unk_id=0))
    assert [ids(run, t) for t in ("un", "unbreakable", "xyz", "unxyz", "")] == [[1], [1, 3, 4], [0], [0], []]
    run = wordpiece(model("wordpiece", ["[UNK]", "grip", "##pe", "gripper"], unk_id=0))
    assert [ids(run, t) for t in ("grippe", "gripp", "grip", "gripx")] == [[1, 2], [0], [1], [0]]
    assert ids(wordpiece(model("wordpiece", ["[UNK]", "a", "##a"], unk_id=0, max_chars=3)), "aaaa") == [0]


def test_sentencepiece_bpe():
    sp = model("sp_bpe", ["▁", "a", "b", "c", "▁a", "▁ab"], [("▁", "a"), ("▁a", "b")])
    assert ids(sp_bpe(sp), "▁ab▁ab▁ab") == [5, 5, 5]
    assert ids(sp_bpe(model("sp_bpe", ["a", "b", "c", "ab", "bc", "abc"], [("a", "b"), ("ab", "c"), ("b", "c")])), "abc") == [5]
    byte = ModelSpec(encoder="sp_bpe", vocab=((0, b"<unk>"), (1, b"a"), (2, b"<0xC3>"), (3, b"<0xA9>")), unk_id=0, byte_fallback=True)
    assert ids(sp_bpe(byte), "aé") == [1, 2, 3] and ids(sp_bpe(byte), "ü") == [0]


def scored(tokens, **more):
    return ModelSpec(encoder="unigram", vocab=tuple((i, t.encode()) for i, t in enumerate(tokens)), scores=tuple(float(s) for s in tokens.values()), **more)


def test_unigram():
    run = unigram(scored({"h": -1, "e": -1, "l": -1, "o": -1, "hell": -2, "hello": -3}))
    assert ids(run, "hello") == [5] and ids(run, "h") == [0]
    assert ids(unigram(scored({"a": -0.1, "b": -0.1, "ab": -10})), "ab") == [0, 1]
    assert ids(unigram(scored({"ab": -2, "a": -1, "b": -1})), "ab") == [0]
    units = scored({"▁": -1, "▁a": -0.5, "a": -1, "b": -1, "▁b": -0.5})
    assert ids(unigram(units), "▁a▁b▁a") == [1, 4, 1] and splits_at_marks(units)
    inner = scored({"▁a▁b": -0.5, "▁a": -3, "▁b": -3, "a": -5, "b": -5, "▁": -5}, unk_id=5)
    assert ids(unigram(inner), "▁a▁b") == [0] and not splits_at_marks(inner)
    assert ids(unigram(scored({"<unk>": 0, "a": -1}, unk_id=0)), "xxaxé") == [0, 1, 0]


def test_unigram_is_the_best_of_all_segmentations():
    rng = random.Random(3)
    table = {t: -rng.random() * 5 for t in ("a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa")}
    spec = scored(table)
    run = unigram(spec)

    def best(text):
        if not text:
            return 0.0
        return max((s + best(text[len(t) :]) for t, s in table.items() if text.startswith(t)), default=float("-inf"))

    for _ in range(100):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        assert abs(sum(spec.scores[i] for i in ids(run, text)) - best(text)) < 1e-9


def test_sizes_cover_the_piece():
    for spec in (HELLO, toy_models.words(), toy_models.pieces_unigram()):
        run = core(spec)
        for text in ("hello", "the", "xyz", "und", "abcabc"):
            assert sum(s for _, s in run(text.encode())) == len(text)


def test_valid_pairs():
    assert not HELLO.is_valid_pair(97, 98) and HELLO.is_valid_pair(98, 97)
