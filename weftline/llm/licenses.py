"""License scans by diagonal voting.

All rolling hashes of ``k`` words of all documents are joined with the positions
of the same hashes in license templates.  A match at word p of a document and
word q of a template votes for the diagonal p - q; votes are aggregated by
diagonal, diagonals as near as ``least`` allows for the template's length (words
put in or left out) are merged, and where enough of the template has voted, the
spans there are found word by word on the document's text, by an alignment that
is exact: of all spans the one with the most words in common for its length.

Cost: the join's template side is broadcast while it has at most
``BROADCAST_ROWS`` rows, else Spark chooses; only matches are shuffled.  For
verification the texts are read again, and those that have enough of a template's
hashes in any order move once; all texts do beyond ``BROADCAST_ROWS``.

Null and empty texts, and texts of fewer than k words, have no match.  Rows
without doc_id are left out.  Repeated rows are told once.  Spans are in
characters, end exclusive.  A span that several templates claim goes to the one
with the most matched words, then the most similar, then the first by name.  A
span with words that make another license of it (``NC``, ``Lesser``), or without
those or the version of its template, isn't told.
"""

from __future__ import annotations

import pkgutil
import re
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents_in
from .text import Words, char_offsets, grams, slices

BROADCAST_ROWS = 100_000

TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "isc": "Released under the ISC License.",
}
_GNU = {"gpl-2.0": ("", "2"), "lgpl-2.1": ("Lesser ", "2.1"), "lgpl-3.0": ("Lesser ", "3"), "agpl-3.0": ("Affero ", "3")}
TEMPLATES |= {name: f"This work is licensed under the GNU {kind}General Public License, version {version}." for name, (kind, version) in _GNU.items()}
TEMPLATES |= {
    f"{name}-notice": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    for name, (kind, version) in _GNU.items()
}
for _by, _long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
    if _by != "by-nc":
        TEMPLATES[f"cc-{_by}-4.0-line"] = f"Licensed under CC {_by.upper()} 4.0."
    if _by not in ("by", "by-sa"):
        TEMPLATES[f"cc-{_by}-4.0-{'long' if _by == 'by-nc' else 'work'}"] = f"This work is licensed under a Creative Commons {_long} 4.0 International License."
#: Whole texts, in ``license_texts``.
BODIES = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0", "mit", "mpl-2.0", "unlicense")
TEMPLATES |= {f"{name}-full": (pkgutil.get_data(__package__, f"license_texts/{name}-full.txt") or b"").decode().strip() for name in BODIES}

#: Words that make another license of a text that is else much the same: a span has no more of them than its template.
_MARKS = frozenset("noncommercial noderivatives noderivs sharealike lesser affero".split())
_SHORT = frozenset("nc nd sa".split())  # in a name such as BY-NC-SA only
_BEFORE_VERSION = frozenset("version v license by nc nd sa attribution noncommercial noderivatives sharealike cc0".split())
#: A template of at most so many words is a line or notice, whose own marks and version the span must have.
NOTICE_WORDS = 120


def _marks(words: list[str]) -> Counter[str]:
    return Counter(w for before, w in zip(["", *words], words) if w in _MARKS or (w in _SHORT and (before == "by" or before in _SHORT)))


def distinguishing(text: str) -> tuple[Counter[str], frozenset[str]]:
    """(marks, words that a span must have) of a template."""
    words = re.findall(r"\w+", text.lower())
    need = set(_marks(words)) | {b for a, b in zip(words, words[1:]) if a in _BEFORE_VERSION and b.isdigit()}
    return _marks(words), frozenset(need if len(words) <= NOTICE_WORDS else ())


def _grams(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, buf, off in slices(batch.column(1)):
                w = Words(buf, off)
                g, first, bounds = grams(w.hash, w.at, k, whole_if_short=False)
                if len(g):
                    n = np.diff(bounds)
                    yield {"doc_id": np.repeat(ids[a : a + len(n)], n), "p": (first - np.repeat(w.at[:-1], n)).astype(np.int32), "h": g.view(np.int64)}

    return run


def template_positions(templates: Mapping[str, str], k: int) -> list[tuple[str, int, int, int]]:
    """(template, word, hash, number of hashes)."""
    names = list(templates)
    arr = pa.array([templates[n] for n in names])
    out = []
    for a, _, buf, off in slices(arr, 1 << 30):
        w = Words(buf, off)
        g, first, bounds = grams(w.hash, w.at, k, whole_if_short=False)
        for t in range(len(off) - 1):
            for x in range(bounds[t], bounds[t + 1]):
                out.append((names[a + t], int(first[x] - w.at[t]), int(g[x].view(np.int64)), int(bounds[t + 1] - bounds[t])))
    return out


def _promising(places: list[tuple[str, int, int, int]], share: float, k: int):
    """Rows whose text has at least ``share`` of some template's hashes, in whatever order: all candidates are among them."""
    names = sorted({p[0] for p in places})
    one = np.array([[names.index(p[0]), p[2]] for p in places], np.int64).reshape(-1, 2)
    least = np.zeros(len(names))
    for name, _, _, n in places:
        least[names.index(name)] = max(1.0, n * share)
    one = one[np.argsort(one[:, 1], kind="stable")]
    known, bound = np.unique(one[:, 1], return_index=True)
    bound = np.append(bound, len(one))

    def run(batches):
        for batch in batches:
            for a, _, buf, off in slices(batch.column(1)):
                w = Words(buf, off)
                g, _, bounds = grams(w.hash, w.at, k, whole_if_short=False)
                h = g.view(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, np.int64)
                rows = np.searchsorted(bounds, hit, "right") - 1
                kept = []
                for r in np.unique(rows):
                    own = np.unique(at[hit[slice(*np.searchsorted(rows, [r, r + 1]))]])
                    there = np.concatenate([one[bound[x] : bound[x + 1], 0] for x in own.tolist()])
                    if (np.bincount(there, minlength=len(names)) >= least).any():
                        kept.append(a + int(r))
                if kept:
                    yield {"doc_id": batch.column(0).take(pa.array(kept)), "text": batch.column(1).take(pa.array(kept))}

    return run


def _best(own: np.ndarray, places: dict[int, np.ndarray], n: int, least: float) -> tuple[int, int, int] | None:
    """(start, end, words in common) of the span of ``own`` that is most over ``least``, among the first such.

    A span's similarity is at least ``least`` just where 2 * common - least * (length + n) >= 0.  The greatest
    2 * common - least * length of spans that end here and use the first j words of the template is kept for each j,
    in thousandths, with the span's start in the lower half; what each word costs is in ``off``.
    """
    cost, gain, held = round(least * 1000) << 32, 2000 << 32, np.zeros(n + 1, np.int64)
    best, found = None, None
    for i, h in enumerate(own.tolist()):
        if found and i > found[1] + n * 2:  # no span that overlaps this one reaches so far
            break
        at = places.get(h)
        if at is None:
            continue
        off = cost * i
        held[at + 1] = np.maximum(held[at + 1], np.maximum(held[at], off + i) + gain)
        np.maximum.accumulate(held, out=held)
        top = int(held[-1]) - off - cost
        if best is None or top >> 32 > best:
            start = top & 0xFFFFFFFF
            length = i + 1 - start
            same = ((top >> 32) + (cost >> 32) * length) // 2000
            best = top >> 32
            if 2 * same / (length + n) >= least:
                found = (start, i + 1, same)
    return found


def _spans(own: np.ndarray, places: dict[int, np.ndarray], n: int, least: float):
    """All spans of ``own`` that are like a template, none over another."""
    todo = [(0, len(own))]
    while todo:
        lo, hi = todo.pop()
        if found := _best(own[lo:hi], places, n, least):
            a, b, same = found
            yield lo + a, lo + b, same
            todo += [(x, y) for x, y in ((lo + b, hi), (lo, lo + a)) if y - x >= n * least / (2 - least) and y > x]


def _verify(templates: Mapping[str, str], least: float):
    words: dict[str, tuple[dict[int, np.ndarray], int]] = {}
    marks: dict[str, tuple[Counter[str], frozenset[str]]] = {}
    for name, text in templates.items():
        t = next(Words(buf, off) for _, _, buf, off in slices(pa.array([text]))).hash
        marks[name] = distinguishing(text)
        words[name] = ({int(h): np.flatnonzero(t == h) for h in np.unique(t)}, len(t))

    def run(batches):
        for batch in batches:
            rows = {"doc_id": [], "license": [], "start": [], "end": [], "similarity": []}
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(text.encode(), np.uint8)
                w = Words(raw, np.array([0, len(raw)]))
                found = set()
                for s in spans:
                    places, n = words[s["template"]]
                    lo, hi = max(0, s["first"]), min(len(w.hash), s["last"])
                    for a, b, same in _spans(w.hash[lo:hi], places, n, least):
                        own = re.findall(r"\w+", raw[w.start[lo + a] : w.end[lo + b - 1]].tobytes().decode().lower())
                        most, need = marks[s["template"]]
                        if _marks(own) <= most and need <= set(own):
                            found.add((-same, s["template"], lo + a, lo + b, 2 * same / (b - a + n)))
                taken = []
                for _, name, a, b, similarity in sorted(found, key=lambda x: (x[0], -x[4], x)):
                    if all(b <= x or a >= y for x, y in taken):
                        taken.append((a, b))
                        start, end = char_offsets(raw, np.array([w.start[a], w.end[b - 1]]))
                        for key, v in zip(rows, (doc_id, name, int(start), int(end), similarity)):
                            rows[key].append(v)
            if rows["doc_id"]:
                yield rows

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, k: int = 3, share: float = 0.4, apart: int = 4, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, end, similarity) of the spans that are like a template.

    A candidate has votes from at least ``share`` of the template's hashes on
    diagonals no further from each other's neighbours than a span that is like
    the template by ``least`` can have words put in or left out (``apart`` at
    least); a span is told if its words are like the template's by at least ``least``.
    """
    spark = docs.sparkSession
    d = documents_in(docs, id_col, text_col).where("doc_id is not null and text is not null")
    places = template_positions(templates, k)
    known = spark.createDataFrame(places, "template string, q int, h long, n int")
    if len(places) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    match = arrow_map(d, _grams(k), "doc_id long, p int, h long").join(known, "h")
    votes = match.groupBy("doc_id", "template", "n", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"), F.min("p").alias("first"), F.max("p").alias("last"))
    # of N words at most N * (2 / least - 2) can be put in; at most as many again are left out
    gap = F.greatest(F.lit(apart), F.ceil((F.col("n") + k - 1) * min(1.0, 2 / max(least, 1e-9) - 2))).cast("int")
    by = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int"), F.lit(1))
    merged = votes.withColumn("new", new).withColumn("cluster", F.sum("new").over(by)).groupBy("doc_id", "template", "n", "cluster").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("voted"), (F.min("first") - F.max(gap)).cast("int").alias("first"), (F.max("last") + k + F.max(gap)).cast("int").alias("last"),
    )
    spans = merged.where(F.col("voted") >= F.greatest(F.lit(1), F.col("n") * share)).groupBy("doc_id").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    texts = arrow_map(d, _promising(places, share, k), "doc_id long, text string") if len(places) <= BROADCAST_ROWS else d
    return arrow_map(texts.join(spans.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "spans"), _verify(dict(templates), least), "doc_id long, license string, start int, end int, similarity double").distinct()
