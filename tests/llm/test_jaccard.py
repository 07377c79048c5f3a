from __future__ import annotations

import random
from collections import Counter

from weftline.llm import jaccard

from .helpers import ODD, documents, made_text, words_of


def gram_set(text, n=2):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def corpus(seed=3, groups=40):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = made_text(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = made_text(rng, 1)
            rows.append((k, " ".join(own)))
            k += 1
    return rows


def brute(rows, threshold):
    sets = {i: gram_set(t) for i, t in rows}
    out = {}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= threshold:
                    out[a, b] = j
    return out


def wanted(rows, threshold=0.5):
    """(class_id, n_links) by doc_id, from all pairs."""
    pairs, root = brute(rows, threshold), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links = Counter(x for p in pairs for x in p)
    return {i: (find(i), links[i]) for i, _ in rows}


def told(df):
    rows = df.collect()
    out = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert len(out) == len(rows)
    return out


def test_recall(spark):
    rows = corpus()
    got, want = told(jaccard.ngram_jaccard_join(documents(spark, rows))), wanted(rows)
    assert got.keys() == want.keys()
    assert all(got[i][1] <= want[i][1] for i in got)
    assert sum(n for _, n in got.values()) >= 0.92 * sum(n for _, n in want.values())


def test_all_links_and_classes(spark):
    rows = [*corpus(7, 30), (800, "two words"), (801, "Two words!"), (802, "two words two words two words"), (803, "alone"), (804, "")]
    assert told(jaccard.ngram_jaccard_join(documents(spark, rows), recall=0.9997)) == wanted(rows)


def test_copies_count_as_links(spark):
    rng = random.Random(2)
    base = made_text(rng, 40)
    rows = [(k, base if k < 30 else base + " more" * (k - 29)) for k in range(34)]
    assert told(jaccard.ngram_jaccard_join(documents(spark, rows))) == wanted(rows)
    assert told(jaccard.ngram_jaccard_join(documents(spark, rows)))[0] == (0, 33)


def test_blocks_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 3)
    rng = random.Random(8)
    base = made_text(rng, 60)
    rows = [(k, base + " " + made_text(rng, 3)) for k in range(20)]
    assert told(jaccard.ngram_jaccard_join(documents(spark, rows), recall=0.999)) == wanted(rows)


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = corpus(11, 20)
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d.parquet/*.parquet'")
    want = {i: (c, k) for i, c, k in con.sql(jaccard.sql()).fetchall()}
    assert want == wanted(rows) == told(jaccard.ngram_jaccard_join(docs, recall=0.9997))


def test_an_id_with_several_texts(spark):
    rng = random.Random(4)
    a, b = made_text(rng, 30), made_text(rng, 30)
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b)]
    assert told(jaccard.ngram_jaccard_join(documents(spark, rows))) == {3: (3, 1), 5: (3, 2), 9: (5, 1)}


def test_band_count():
    assert jaccard.choose_bands(0.5, 0.92, 4) == 40
    assert 1 - (1 - 0.5**4) ** jaccard.choose_bands(0.5, 0.92, 4) >= 0.92


def test_one_of_each_group_stays(spark):
    rows = [*corpus(5, 25), (700, "w1 w2 w3 w4 w5 w6"), (701, "w1 w2 w3 w4 w5 w6")]
    kept = {r.doc_id for r in jaccard.drop_near_duplicates(documents(spark, rows), recall=0.999).collect()}
    assert kept == {c for c, _ in wanted(rows).values()}


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    got = told(jaccard.ngram_jaccard_join(docs))
    assert got == {r[0]: (r[0], 0) for r in ODD if r[0] is not None}
    kept = jaccard.drop_near_duplicates(docs).collect()
    assert len(kept) == len(ODD) - 1  # the repeated row
    assert sorted(map(str, (r.doc_id for r in kept))).count("904") == 1


def test_empty_and_extra_columns(spark):
    assert jaccard.ngram_jaccard_join(documents(spark, []).where("false")).count() == 0
    more = documents(spark, [(1, "a b c d"), (2, "a b c d"), (3, "e f g h")]).selectExpr("*", "1 as rep", "2 as bands", "3 as id", "4 as n", "5 as __x", "6 as gone", "7 as __Gone", "8 as again", "9 as __again")
    assert told(jaccard.ngram_jaccard_join(more)) == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    kept = jaccard.drop_near_duplicates(more)
    assert kept.columns == more.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_chains_are_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    got = {r.id: r.root for r in jaccard.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 51)}, 101: 100}
