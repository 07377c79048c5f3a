from __future__ import annotations

import random
from collections import defaultdict
from math import sqrt

import pyarrow as pa

from weftline.llm import pii

from .helpers import ODD, documents, made_text


def card(rng):
    digits = [rng.randint(0, 9) for _ in range(15)]
    for last in range(10):
        raw = "".join(map(str, [*digits, last]))
        if pii.luhn(raw):
            return raw


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    rows, marked = [], []
    for k in range(n):
        words = made_text(rng, 60).split()
        kind = k % 6
        own = [
            lambda: f"{made_text(rng, 1)}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            lambda: card(rng), lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: None, lambda: None,
        ][kind]()
        if own:
            words.insert(rng.randrange(len(words)), own)
            marked.append((k, own))
        elif kind == 5:
            words.insert(5, rng.choice(["version 3.0.", "in 2024", "1,234", "12:30", "300.400.500.600", "1234567890123456", "x86"]))
        rows.append((k, " ".join(words)))
    return rows, marked


def brute(rows, rounds=3, confident=0.8, least=3, least_confidence=0.4):
    """The same graph by dictionaries."""
    found = [(i, *c) for i, t in rows if t for c in pii.candidates_in(t, [(0, len(t))])]
    seeds = {v for _, _, _, kind, v, raw, _ in found if pii.proves(kind, raw)}
    edges = defaultdict(set)
    for *_, v, _raw, patterns in found:
        for p in patterns:
            edges[p].add(v)
    trusted = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        confidence = {}
        for p, values in edges.items():
            n, good, z = len(values), sum(trusted.get(v, 0.0) for v in values), 1.64
            if n >= least and good > 0:
                s = good / n
                low = (s + z * z / (2 * n) - z * sqrt(s * (1 - s) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                if low >= least_confidence:
                    confidence[p] = low
        miss = defaultdict(lambda: 1.0)
        for p, c in confidence.items():
            for v in edges[p]:
                miss[v] *= 1 - c
        trusted = dict.fromkeys(seeds, 1.0) | {v: 1 - m for v, m in miss.items() if v not in seeds and 1 - m >= confident}
    return {(i, a, b, kind): trusted[v] for i, a, b, kind, v, _, _ in found if v in trusted}


def same(got, want):
    own = {(r.doc_id, r.start, r.end, r.kind): r.score for r in got}
    assert own.keys() == want.keys()
    assert all(abs(own[k] - want[k]) < 1e-9 for k in want)


def test_all_planted_and_nothing_else(spark):
    rows, marked = corpus()
    got = pii.extract_identifiers(documents(spark, rows)).collect()
    texts = dict(rows)
    assert {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in got} == set(marked)
    same(got, brute(rows))


def test_contexts_discover_unseen_identifiers(spark):
    """Cards after 'member card' make that context trusted; numbers in it that prove nothing are then found."""
    rng = random.Random(2)
    rows = [(k, f"{made_text(rng, 8)} member card {card(rng)} was used {made_text(rng, 8)}") for k in range(40)]
    unseen = [(100, f"{made_text(rng, 5)} member card 123456789 was used {made_text(rng, 4)}"), (101, f"{made_text(rng, 5)} old member card 77001234 was used")]
    clean = [(200 + k, f"{made_text(rng, 6)} order total {rng.randint(10**7, 10**8)} {made_text(rng, 6)}") for k in range(30)]
    got = pii.extract_identifiers(documents(spark, rows + unseen + clean)).collect()
    assert {r.doc_id for r in got if not r.seed} == {100, 101}
    assert {r.doc_id for r in got if r.seed} == set(range(40))
    same(got, brute(rows + unseen + clean))


def test_a_few_seeds_in_a_context_are_enough(spark):
    """Five cards after 'member card' and before 'was used' speak for a sixth number there; one pattern alone does not."""
    rng = random.Random(6)
    rows = [(k, f"{made_text(rng, 8)} member card {card(rng)} was used {made_text(rng, 8)}") for k in range(5)]
    unseen = [(100, f"{made_text(rng, 5)} member card 123456789 was used {made_text(rng, 4)}"), (101, f"{made_text(rng, 5)} total 77001234 was paid")]
    got = pii.extract_identifiers(documents(spark, rows + unseen)).collect()
    assert {r.doc_id for r in got if not r.seed} == {100} and all(r.score < 1 for r in got if not r.seed)
    same(got, brute(rows + unseen))


def test_seeds_are_told_by_a_flag(spark):
    """A found value whose many patterns round its score to 1 is not told as a seed."""
    rng = random.Random(5)
    found = [(k, f"{made_text(rng, 4)} {a} {b} {{}} {c} {made_text(rng, 3)}") for k, (a, b, c) in enumerate([("my", "card", "is"), ("your", "card", "was"), ("the", "number", "of")] * 60)]
    rows = [(k, t.format(card(rng))) for k, t in found] + [(500 + k, t.format("1234567890123456")) for k, t in found]
    got = pii.extract_identifiers(documents(spark, rows)).collect()
    assert {r.seed for r in got if r.doc_id >= 500} == {False} and {r.seed for r in got if r.doc_id < 500} == {True}


def test_words_around_are_whole():
    long = "w" * 300
    assert pii.words_before(f"one {long} two{' ' * 500}", 900) == [long, "two"]
    (*_, patterns), = pii.candidates_in(f"one {long} 12345678{' ' * 200}{long}!", [(0, 1000)])
    (*_, other), = pii.candidates_in(f"one {long} 12345678 {long}!", [(0, 1000)])
    assert patterns == other


def test_known_values_are_seeds(spark):
    rng = random.Random(3)
    codes = [f"QX{rng.randint(10000, 99999)}" for _ in range(70)]
    rows = [(k, f"patient file {c} opened {made_text(rng, 4)}") for k, c in enumerate(codes)]
    known = spark.createDataFrame([(c,) for c in codes[:65]] + [(None,), ("",)], "value string")
    got = pii.extract_identifiers(documents(spark, rows), known).collect()
    assert {r.doc_id for r in got} == set(range(70))
    assert pii.extract_identifiers(documents(spark, rows)).count() == 0


def test_neighbours_don_t_run_together(spark):
    text = "97.51.17.173 9807915762804490 +1 (323) 555-9830 8.8.8.8 ann@mail.example.com, +1 (017) 555-7713 97.51.17.173."
    got = pii.extract_identifiers(documents(spark, [(1, text)])).collect()
    own = sorted(text[r.start : r.end] for r in got)
    assert own == sorted(["97.51.17.173", "97.51.17.173", "8.8.8.8", "+1 (323) 555-9830", "+1 (017) 555-7713", "ann@mail.example.com"] + (["9807915762804490"] if pii.luhn("9807915762804490") else []))


def test_what_proves_itself():
    good = ["(323) 555-9830", "323-555-9830", "123-45-6789", "4539 1488 0343 6467", "+44 20 7946 0958", "GB82 WEST 1234 5698 7654 32", "Ann.B@x.example.org", "255.0.10.1"]
    bad = ["000-45-6789", "123-00-6789", "923-45-6789", "123-555-9830", "4539148803436468", "1111111111111111", "GB83 WEST 1234 5698 7654 32", "256.0.10.1", "12-34", "2024-05-17"]
    for raw in good + bad:
        m = pii.CANDIDATE.fullmatch(raw)
        assert m, raw
        assert pii.proves(m.lastgroup, raw) == (raw in good), raw


def found_in(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    return sorted((i, a, b, k, v) for rows in pii._find([batch]) for i, a, b, k, v in zip(*(rows[x] for x in ("doc_id", "start", "end", "kind", "value"))))


def test_candidates_are_those_of_whole_texts():
    rng = random.Random(7)
    parts = ["GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "GB82", "WEST", "AB", "XYZ,", "WESTé", "ABCD”", "é", "1234", "a@b.example.com", "415.555.1234", "(415) 555.1234", "1.2.3.4", "the", "The", "Q" * 40, "4539 1488 0343 6467", "+1 (323) 555-9830", "x86", "3.14159"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "  ", "\n", ", ", ""]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    want = sorted((i, a, b, k, v) for i, t in enumerate(texts) for a, b, k, v, _, _ in pii.candidates_in(t, [(0, len(t))]))
    assert found_in(texts) == want


def test_codes_with_letters_and_dotted_numbers_are_found(spark):
    own = ["GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "415.555.1234", "(415) 555.1234", "1.415.555.1234"]
    rows = [(k, f"pay to {x}, he said. Then the rest") for k, x in enumerate(own)] + [(9, "released 17.05.2024 as 1.22.333 or 10.415.555.1234.9")]
    texts = dict(rows)
    got = pii.extract_identifiers(documents(spark, rows)).collect()
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end], r.seed) for r in got) == [(k, x, True) for k, x in enumerate(own)]


def test_odd_rows(spark):
    rows = [*ODD, (1, "a@b.example.com"), (1, "a@b.example.com"), (None, "mail a@b.example.com é 👍"), (2, "word " * 50_000 + "a@b.example.com"), (3, "1" * 200_000), (4, "9 " * 50_000)]
    got = pii.extract_identifiers(documents(spark, rows).selectExpr("*", "1 as value", "2 as pattern", "3 as kind")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    assert [r.start for r in got if r.doc_id == 2] == [250_000]
    assert pii.extract_identifiers(documents(spark, ODD)).count() == 0
    assert pii.extract_identifiers(documents(spark, []).where("false")).count() == 0
