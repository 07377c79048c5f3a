"""Best-fit packing of documents into bins of ``capacity`` tokens, by exact complements.

A document longer than the capacity gives full pieces, which are bins of their
own, and a remainder.  The rest only depends on how many pieces have each
length, a histogram of at most ``capacity`` numbers, whatever the corpus:

1. Sums of the lengths at hand are indexed: of one by the counts, of two by all
   smaller parts of each sum, of three by all lengths that leave a sum of two.
   Taking lengths from the longest, the gap that a piece leaves is looked up as
   a single, a pair and a triple; a combination that fills it exactly is used as
   often as the counts allow.  Counts only fall, so what is used up in the index
   is passed over once.
2. What is left goes best-fit in descending order: into the open gap that it
   fills best, else into a new bin.

The plan (which lengths share a bin, and how often) is then dealt to documents:
pieces of one length are numbered, in blocks of about ``BLOCK`` pieces so that no
task numbers a whole length, and the number's range in the plan is the piece's
bin.  Full pieces aren't dealt: each is a bin with a negative id where it lies.
Ties don't matter to the plan; pieces of one length are dealt by doc_id and start.

Null and empty texts, and texts without tokens, are in no bin; rows without
doc_id are packed with a null id.  Repeated rows are packed once each.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, documents_in
from .text import slices
from .tokens import VOCABULARY, tokenizer

PIECES = "array<struct<doc_id: long, start: long, length: int>>"


#: Pieces that one task numbers, about.
BLOCK = 200_000


class Sums:
    """Sums of one, two and three of the lengths of which ``have`` counts are left; counts may only fall.

    ``smaller[s]`` has the smaller parts of all pairs of the sum s, ``third[s]`` the
    lengths that leave a sum of two; each list is read from where it was last alive.
    """

    def __init__(self, have: np.ndarray):
        self.have, top = have, len(have)
        lengths = np.flatnonzero(have)
        there = have > 0
        self.smaller: list[list[int]] = [[] for _ in range(top)]
        for s in range(2, top):
            low = lengths[: np.searchsorted(lengths, s // 2, "right")]
            self.smaller[s] = low[there[s - low]].tolist()[::-1]
        paired = np.array([bool(x) for x in self.smaller])
        self.third: list[list[int]] = [[] for _ in range(top)]
        for s in range(3, top):
            low = lengths[: np.searchsorted(lengths, s)]
            self.third[s] = low[paired[s - low]].tolist()
        self.pair_at, self.triple_at = [0] * top, [0] * top

    def _pairs(self, s: int, from_: int):
        """(place, parts) of the pairs of the sum s that are left."""
        have, own = self.have, self.smaller[s]
        for k in range(from_, len(own)):
            a = own[k]
            if have[a] >= 1 + (2 * a == s) and have[s - a]:
                yield k, (s - a, a)

    def pair(self, s: int) -> tuple[int, ...] | None:
        k, found = next(self._pairs(s, self.pair_at[s]), (len(self.smaller[s]), None))
        self.pair_at[s] = k
        return found

    def triple(self, s: int) -> tuple[int, ...] | None:
        have, own = self.have, self.third[s]
        for k in range(self.triple_at[s], len(own)):
            a = own[k]
            if have[a] and self.pair(s - a):
                for _, (x, y) in self._pairs(s - a, self.pair_at[s - a]):
                    if have[a] >= 1 + (a == x) + (a == y):
                        self.triple_at[s] = k
                        return (a, x, y)
        self.triple_at[s] = len(own)
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.have[gap] else self.pair(gap) or self.triple(gap)


def complements(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(bins of up to four pieces that are exactly full, what is left of the counts); of what is left, no four pieces or fewer fill a bin."""
    have = np.asarray(counts, np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if have[capacity]:
        out.append(((capacity,), int(have[capacity])))
        have[capacity] = 0
    sums = Sums(have[:capacity])
    have = sums.have = have.tolist()
    for length in range(capacity - 1, 0, -1):
        while have[length]:
            have[length] -= 1
            found = sums.filling(capacity - length)
            have[length] += 1
            if not found:
                break
            own = (length, *found)
            times = min(have[v] // own.count(v) for v in own)
            for v in own:
                have[v] -= times
            out.append((own, times))
    return out, np.array(have, np.int64)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins) for ``counts[length]`` pieces of each length up to the capacity."""
    out, have = complements(counts, capacity)
    gaps: dict[int, list[list]] = {}  # open bins by gap: [lengths, times]
    for length in range(capacity - 1, 0, -1):
        n = int(have[length])
        while n:
            fit = next((g for g in range(length, capacity) if gaps.get(g)), None)
            if fit is None:
                each = capacity // length
                whole = n // each
                if whole:
                    gaps.setdefault(capacity - each * length, []).append([(length,) * each, whole])
                if n - whole * each:
                    gaps.setdefault(capacity - (n - whole * each) * length, []).append([(length,) * (n - whole * each), 1])
                n = 0
                continue
            lengths, times = gaps[fit].pop()
            used = min(n, times)
            if times > used:
                gaps[fit].append([lengths, times - used])
            gaps.setdefault(fit - length, []).append([(*lengths, length), used])
            n -= used
    out += [(tuple(lengths), times) for rows in gaps.values() for lengths, times in rows]
    return out


def _deal(plans: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges (length, first, bin, step), sorted: pieces of a length numbered from first on go to bins from ``bin`` on, ``step`` to each.

    There are as many as lengths in the plan, which the capacity bounds.
    """
    used: dict[int, int] = {}
    rows, bin_ = [], 0
    for lengths, times in plans:
        for v, g in groupby(sorted(lengths)):
            step = len(list(g))
            a = used.get(v, 0)
            rows.append((v, a, bin_, step))
            used[v] = a + step * times
        bin_ += times
    length, first, bins, step = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return {"key": (length << 40) + first, "first": first, "bin": bins, "step": step}


def pack(lengths: DataFrame, capacity: int) -> DataFrame:
    """Bins (bin_id, doc_ids, pieces, used) of a table (doc_id, length)."""
    spark = lengths.sparkSession
    c = F.lit(capacity)
    own = cut(lengths.where("length > 0"))
    piece = lambda start, length: F.struct("doc_id", start.alias("start"), length.cast("int").alias("length"))
    full = own.where(F.col("length") >= c).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / c) - 1)).alias("k"))
    full = full.select((-1 - F.monotonically_increasing_id()).alias("bin_id"), F.array("doc_id").alias("doc_ids"), F.array(piece(F.col("k") * c, c)).alias("pieces"), c.cast("int").alias("used"))
    rest = own.where(F.col("length") % c > 0).select("doc_id", (F.floor(F.col("length") / c) * c).alias("start"), (F.col("length") % c).cast("int").alias("length"))
    counts = np.zeros(capacity + 1, np.int64)
    total = rest.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    counts[total.column("length").to_numpy()] = total.column("n").to_numpy()
    if not counts.any():
        return full
    deal = spark.sparkContext.broadcast(_deal(plan(counts, capacity)))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(int(counts.max()) // BLOCK + 1)).cast("int"))
    by_block = rest.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = by_block.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start")) - 1
    numbered = rest.select("*", number.alias("own")).join(before, ["length", "block"]).select("doc_id", "start", "length", (F.col("own") + F.col("before")).alias("number"))

    def place(batches):
        d = deal.value
        for batch in batches:
            length, nth = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            at = np.searchsorted(d["key"], (length << 40) + nth, "right") - 1
            yield {"bin_id": d["bin"][at] + (nth - d["first"][at]) // d["step"][at], "doc_id": batch.column(0), "start": batch.column(1), "length": batch.column(2)}

    binned = arrow_map(numbered, place, "bin_id long, doc_id long, start long, length int")
    shared = binned.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "start", "length"))).alias("pieces"), F.sum("length").cast("int").alias("used"))
    return full.unionByName(shared.select("bin_id", F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"), "pieces", "used"))


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length) of all texts that aren't null."""

    def run(batches):
        t = tokenizer(vocabulary)
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1), 1 << 20):
                yield {"doc_id": batch.column(0).slice(a, b - a), "length": t.counts(buf, off)}

    return arrow_map(documents_in(docs, id_col, text_col).where("text is not null"), run, "doc_id long, length long")


def best_fit_packing(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bins (bin_id, doc_ids, pieces, used) of whole documents; a piece is ``length`` tokens of a document from ``start`` on."""
    return pack(token_lengths(docs, vocabulary, id_col, text_col), capacity)
