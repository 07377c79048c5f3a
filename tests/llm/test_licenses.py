from __future__ import annotations

import random

from weftline.llm import licenses

from .helpers import ODD, documents, made_text, words_of


def brute_votes(text, template, k=3):
    """Distinct template positions by diagonal."""
    w, t = words_of(text), words_of(template)
    out = {}
    for p in range(len(w) - k + 1):
        for q in range(len(t) - k + 1):
            if w[p : p + k] == t[q : q + k]:
                out.setdefault(p - q, set()).add(q)
    return out


def test_verbatim_templates_are_found_whole(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        before = made_text(rng, rng.randint(0, 60))
        rows.append((k, f"{before}\n{text} {made_text(rng, 20)}"))
        want[k] = (name, len(before) + 1)
    got = licenses.scan_licenses(documents(spark, rows)).collect()
    for k, (name, start) in want.items():
        own = [(r.license, r.start, r.similarity) for r in got if r.doc_id == k]
        assert (name, start, 1.0) in own, (name, own)


def test_small_changes_and_case(spark):
    t = licenses.TEMPLATES["mit-grant"]
    changed = t.replace("free of charge", "at no charge whatsoever").replace("without restriction, ", "").upper()
    got = licenses.scan_licenses(documents(spark, [(1, "intro words here. " + changed + " more")])).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "mit-grant")] and 0.8 <= got[0].similarity < 1


def test_twice_in_a_document(spark):
    rng = random.Random(2)
    t = licenses.TEMPLATES["gpl-3.0"]
    text = t + " " + made_text(rng, 3000) + " " + t
    got = sorted((r.start, r.end) for r in licenses.scan_licenses(documents(spark, [(1, text)])).collect())
    assert len(got) == 2 and got[0][0] == 0 and got[1][1] == len(text) - 1


def test_clean_and_odd(spark):
    rng = random.Random(3)
    rows = [(k, made_text(rng, 100)) for k in range(20)] + ODD + [(50, "the license of this car was void; rights reserved for members")]
    assert licenses.scan_licenses(documents(spark, rows)).count() == 0
    more = documents(spark, [(1, licenses.TEMPLATES["bsd"])] * 2).selectExpr("*", "1 as h", "2 as p", "3 as template")
    assert licenses.scan_licenses(more).count() == 1
    assert licenses.scan_licenses(documents(spark, []).where("false")).count() == 0


def test_candidates_are_those_of_brute_force(spark):
    """With no verification, a document is told just where enough of the template votes near one diagonal."""
    rng = random.Random(9)
    name, t = "bsd", words_of(licenses.TEMPLATES["bsd"])
    rows = []
    for k in range(30):
        own = list(t)
        for _ in range(k // 2):
            own[rng.randrange(len(own))] = made_text(rng, 1)
        rows.append((k, made_text(rng, 30) + " " + " ".join(own)))
    got = {r.doc_id for r in licenses.scan_licenses(documents(spark, rows), {name: licenses.TEMPLATES[name]}, least=0.0).collect()}
    want = {i for i, text in rows if any(len(q) >= 0.4 * (len(t) - 2) for q in brute_votes(text, licenses.TEMPLATES[name]).values())}
    assert want <= got
    assert all(sum(map(len, brute_votes(dict(rows)[i], licenses.TEMPLATES[name]).values())) >= 0.4 * (len(t) - 2) for i in got)


def test_distinguishing_words_and_whole_texts(spark):
    lines = {
        "Licensed under CC BY 4.0.": "cc-by-4.0-line", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0-line", "Licensed under CC BY-NC 3.0.": None,
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0", "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "This work is licensed under the GNU General Public License, version 1.": None,
    }
    bodies = {licenses.TEMPLATES[f"{x}-full"]: f"{x}-full" for x in licenses.BODIES}
    want = list((lines | bodies).items())
    got = licenses.scan_licenses(documents(spark, [(k, "some words go before " + t) for k, (t, _) in enumerate(want)])).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(k, x) for k, (_, x) in enumerate(want) if x]


def brute_similarity(text, template):
    """The greatest similarity of any span, by the longest common subsequence from each start."""
    w, t = words_of(text), words_of(template)
    best = 0.0
    for a in range(len(w)):
        row = [0] * (len(t) + 1)
        for b in range(a, min(len(w), a + 2 * len(t))):
            new = [0]
            for j, x in enumerate(t):
                new.append(row[j] + 1 if x == w[b] else max(row[j + 1], new[j]))
            row = new
            best = max(best, 2 * row[-1] / (b - a + 1 + len(t)))
    return best


def test_runs_put_in_or_left_out(spark):
    """Clauses of 5 to 15 words in the middle of long templates, and as many words left out, against brute force."""
    rng = random.Random(11)
    rows, want = [], {}
    for k, (name, size, sign) in enumerate([(x, y, z) for x in ("apache-2.0-header", "mit-grant", "gpl-notice") for y in (5, 6, 10, 15) for z in (1, -1)]):
        t = licenses.TEMPLATES[name].split()
        at = len(t) // 2
        t[at : at + (size if sign < 0 else 0)] = made_text(rng, size).split() if sign > 0 else []
        rows.append((k, f"{made_text(rng, 12)} {' '.join(t)} {made_text(rng, 12)}"))
        want[k] = (name, brute_similarity(rows[-1][1], licenses.TEMPLATES[name]))
    twice = rows[3][1] + " " + licenses.TEMPLATES["apache-2.0-header"] + " " + rows[2][1]
    got = licenses.scan_licenses(documents(spark, [*rows, (99, twice)])).collect()
    for k, (name, similarity) in want.items():
        own = [r.similarity for r in got if r.doc_id == k and r.license == name]
        assert (len(own) == 1) == (similarity >= 0.8), (k, name, similarity)
        assert all(0.8 <= x <= similarity + 1e-9 for x in own) and (not own or own[0] > similarity - 0.02), (k, own, similarity)
    assert sum(r.doc_id == 99 and r.license == "apache-2.0-header" for r in got) == 1 + sum(want[k][1] >= 0.8 for k in (2, 3))


def test_many_templates_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, f"{made_text(rng, 20)} {t} {made_text(rng, 9)}") for k, t in enumerate(licenses.TEMPLATES.values())] + [(90, "licensed under the terms of the license, version 2.0 of this")]
    told = lambda: sorted(map(tuple, licenses.scan_licenses(documents(spark, rows)).collect()))
    few = told()
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 3)
    assert told() == few and len(few) >= len(licenses.TEMPLATES)
