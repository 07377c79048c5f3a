"""N-gram Jaccard join by MinHash banding.

Two texts are joined if the Jaccard similarity of their sets of word n-grams is
at least ``threshold``.  Texts of one word sequence form a class, of which one
goes on.  Each class gets ``bands`` hashes, each of ``rows`` minima; classes
that share a band hash meet in that bucket, where every pair is verified on
full n-gram sets.  ``choose_bands`` picks the number of bands by the recall
wanted at the threshold itself; above it recall is higher.

Cost: one pass computes signatures (a row of ``bands`` numbers per text).
Buckets are counted by an aggregation, with partial counts before the shuffle,
and joined back, so that no task sees a whole bucket; buckets of one class
vanish, and of buckets with the same members one is looked at.  Only members of
those have their sets computed and shuffled.  A large bucket is split into pairs
of blocks, so no task holds more than two blocks and no pair is left out.
Links are counted where they are verified, so no list of pairs is ever made.

Null or empty texts, and texts without words, have no n-grams and join with
nothing.  A text of fewer than n words has one n-gram, of all its words.  Rows
without doc_id are left out of the join.  Repeated rows of one doc_id count
once; a doc_id with several texts has the links of all of them and the least of
their class ids.  n-grams are compared by 48 bits of hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, documents_in, free, fresh, lists
from .text import U64, Words, grams, mix, powers, reduce_by, slices

#: A block of a bucket has about so many members, and so many n-grams, at most.
BLOCK_MEMBERS, BLOCK_GRAMS = 1024, 1 << 20
#: The number of a band lies in so many low bits of its hash.
BAND_BITS = 7


def choose_bands(threshold: float, recall: float, rows: int = 4) -> int:
    """The fewest bands that find a pair at the threshold with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 62, k, dtype=np.uint64) * U64(2) + U64(1)


def band_hashes(g: np.ndarray, starts: np.ndarray, by: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (a row for each set) of sets that begin at ``starts``, with the band's number in the low bits."""
    with np.errstate(over="ignore"):
        low = np.empty((len(by), len(starts)), np.uint64)
        for k, m in enumerate(by):
            low[k] = np.minimum.reduceat(g * m, starts)
        low = low.reshape(bands, rows, -1)
        band = np.full((bands, len(starts)), 0x51ED270B, np.uint64)
        for r in range(rows):
            band = mix(band * U64(0x2545F4914F6CDD1D) + low[:, r])
    own = U64((1 << BAND_BITS) - 1)
    return ((band & ~own) | np.arange(bands, dtype=np.uint64)[:, None]).T


def sequence_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    pw, inv = powers(len(w.hash) + 1)
    with np.errstate(over="ignore"):
        return tuple(mix(reduce_by(np.add, x * pw[: len(x)], w.at, U64(0)) * inv[w.at[:-1]]) for x in (w.hash, mix(w.hash + U64(99))))


def _signatures(n: int, bands: int, rows: int):
    def run(batches):
        by = _multipliers(bands * rows)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, buf, off in slices(texts):
                w = Words(buf, off)
                g, _, bounds = grams(w.hash, w.at, n)
                size = np.diff(bounds)
                keep = np.flatnonzero(size > 0)
                none = size == 0
                hashes = band_hashes(g, bounds[:-1][keep], by, bands, rows) if len(keep) else np.zeros(0, np.uint64)
                d1, d2 = sequence_hashes(w)
                at = np.append(0, np.cumsum(np.where(none, 0, bands)))
                yield {
                    "doc_id": ids.slice(a, b - a), "d1": pa.array(d1.view(np.int64), mask=none), "d2": pa.array(d2.view(np.int64), mask=none),
                    "n": size, "bands": lists(hashes.ravel().view(np.int64), at, pa.int64()),
                }

    return run


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, d1, d2, n, bands) of each row with an id: hashes of its words' sequence (null without words), number of n-grams, band hashes."""
    if bands > 1 << BAND_BITS:
        raise ValueError(f"at most {1 << BAND_BITS} bands")
    d = documents_in(docs, id_col, text_col).where("doc_id is not null")
    return arrow_map(d, _signatures(n, bands, rows), "doc_id long, d1 long, d2 long, n long, bands array<long>")


def members(sig: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, n_rows) of each document with words."""
    return sig.where("d1 is not null").groupBy("d1", "d2", "doc_id").agg(F.count("*").alias("n_rows"))


def sizes(sig: DataFrame) -> DataFrame:
    """(d1, d2, rep, n_docs, n_rows) of each class: its least doc_id, and how many documents and rows it has."""
    return members(sig).groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), F.sum("n_rows").alias("n_rows"))


def places(sig: DataFrame) -> DataFrame:
    """(rep, d1, bucket, blocks) of the buckets of at least two classes; of buckets with the same members only that of the first band."""
    one = sig.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = cut(one.select("rep", "d1", "n", F.explode("bands").alias("key")))
    shared = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).where("m > 1")
    found = cut(rows.select("rep", "d1", "key").join(shared, "key"))
    free(rows)
    alike = found.groupBy("key").agg(F.first("m").alias("m"), F.bit_xor(F.xxhash64("rep", "d1")).alias("x"), F.bit_xor(F.xxhash64("d1", "rep", F.lit(7))).alias("y"))
    first = alike.groupBy("m", "x", "y").agg(F.min_by("key", F.col("key").bitwiseAND((1 << BAND_BITS) - 1)).alias("key")).select("key")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    return found.join(first, "key").select("rep", "d1", F.col("key").alias("bucket"), blocks.alias("blocks"))


def _sets(n: int, bands: int, rows: int):
    def run(batches):
        by = _multipliers(bands * rows)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, buf, off in slices(texts):
                w = Words(buf, off)
                g, _, bounds = grams(w.hash, w.at, n)
                d1 = sequence_hashes(w)[0].view(np.int64)
                want = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero((np.diff(bounds) > 0) & (d1 == want))  # another text of the same doc_id isn't meant
                if not len(keep):
                    continue
                hashes = band_hashes(g, bounds[:-1], by, bands, rows)[keep] if len(keep) == b - a else np.concatenate([band_hashes(g[bounds[k] : bounds[k + 1]], np.zeros(1, np.int64), by, bands, rows) for k in keep])
                short = [np.unique(g[bounds[k] : bounds[k + 1]] >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for k in keep]
                took = pa.array(keep)
                yield {
                    "rep": ids.slice(a, b - a).take(took), "d1": d1[keep], "grams": short, "bands": lists(hashes.ravel().view(np.int64), np.arange(len(keep) + 1) * bands, pa.int64()),
                } | {c: batch.column(c).slice(a, b - a).take(took) for c in ("n_docs", "places")}

    return run


def unpacked(raw: bytes) -> np.ndarray:
    """A set of n-grams from six bytes each."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted unique arrays."""
    m = len(sets)
    if m == 2:
        x = np.concatenate(sets)
        x.sort()
        k = int((x[1:] == x[:-1]).sum())
        return np.array([[len(sets[0]), k], [k, len(sets[1])]])
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out, step = np.zeros((m, m), np.float32), max(256, (1 << 22) // m)
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + step, step))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            part = np.zeros((m, step), np.float32)
            part[owner[a:b], column[a:b] % step] = 1
            out += part @ part.T
    return out.astype(np.int64)


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, each tree a star on its least member."""
    out, seen = [], np.zeros(len(adjacent), bool)
    for s in range(len(adjacent)):
        if not seen[s]:
            reach, front = np.zeros(len(adjacent), bool), adjacent[s].copy()
            while front.any():
                reach |= front
                front = adjacent[front].any(0) & ~reach
            reach[s] = True
            seen |= reach
            out += [(s, int(x)) for x in np.flatnonzero(reach) if x != s]
    return out


def _verify(threshold: float):
    """(rep, d1, root, links) of each member of a pair of blocks that has a link there: the least member that it is connected with, and the number of documents that it is linked with here for the first time."""

    def bucket(rows):
        seen, unique = set(), []
        for r in sorted(rows, key=lambda r: (r[3], r[4])):
            if (r[3], r[4]) not in seen:
                seen.add((r[3], r[4]))
                unique.append(r)
        if len(unique) < 2:
            return
        sets = [unpacked(r[6]) for r in unique]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets)
        ok = both >= threshold * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(ok, False)
        if not ok.any():
            return
        rep = np.array([r[3] for r in unique])
        root = rep.copy()
        for i, j in _forest(ok):
            root[j] = rep[i]
        new = np.triu(ok)
        if rows[0][1] != rows[0][2]:
            block = np.array([r[5] for r in unique])
            new &= block[:, None] != block[None, :]
        i, j = np.nonzero(new)
        band = rows[0][0] & ((1 << BAND_BITS) - 1)  # a pair is told in the first band that it shares, once
        sig = np.array([r[7] for r in unique])[:, :band]
        first = np.ones(len(i), bool)
        for k in range(band):
            first &= sig[i, k] != sig[j, k]
        i, j = i[first], j[first]
        docs = np.array([r[8] for r in unique], np.float64)
        links = np.bincount(i, docs[j], len(unique)) + np.bincount(j, docs[i], len(unique))
        for k in np.flatnonzero(ok.any(1)):
            yield unique[k][3], unique[k][4], int(root[k]), int(links[k])

    def run(batches):
        def groups():
            at, rows = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[:3] != at:
                        if rows:
                            yield rows
                        at, rows = row[:3], []
                    rows.append(row)
            if rows:
                yield rows

        out, names = [], ("rep", "d1", "root", "links")
        for rows in groups():
            out += bucket(rows)
            if len(out) > 50_000:
                yield dict(zip(names, zip(*out)))
                out = []
        if out:
            yield dict(zip(names, zip(*out)))

    return run


def linked(docs: DataFrame, sig: DataFrame, n: int, threshold: float, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rep, d1, root, links) by class and pair of blocks: ``links`` add up to the number of documents of other classes that a class is linked with, ``rep`` and ``root`` are edges that connect what is connected."""
    at = places(sig).groupBy("rep", "d1").agg(F.collect_list(F.struct("bucket", "blocks")).alias("places"))
    at = at.join(sizes(sig).select("rep", "d1", "n_docs"), ["rep", "d1"])
    d = documents_in(docs, id_col, text_col).withColumnRenamed("doc_id", "rep").where("text is not null and rep is not null")
    sets = arrow_map(d.join(at.hint("shuffle_hash"), "rep").select("rep", "text", "d1", "n_docs", "places"), _sets(n, bands, rows), "rep long, d1 long, grams binary, bands array<long>, n_docs long, places array<struct<bucket: long, blocks: int>>")
    own = F.pmod(F.xxhash64("rep", "d1"), F.col("p.blocks")).cast("int")
    spread = sets.select("rep", "d1", "grams", "bands", "n_docs", F.explode("places").alias("p")).select(
        F.col("p.bucket").alias("bucket"), "rep", "d1", own.alias("block"), "grams", "bands", "n_docs", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("with"),
    )
    lo, hi = F.least("block", "with"), F.greatest("block", "with")
    near = spread.select("bucket", lo.alias("lo"), hi.alias("hi"), "rep", "d1", "block", "grams", "bands", "n_docs").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return arrow_map(near, _verify(threshold), "rep long, d1 long, root long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component, for ids in ``edges`` (a, b) that aren't the least.

    Rounds of large-star and small-star, each by an aggregation joined back, so
    that a hub's edges can be split among tasks; each round's edges are a table in
    the shared folder, and the work ends when they are stars around least ids.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("more"), F.lit(0).alias("least")).union(e.select("v", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("more").alias("more"), F.max("least").alias("least"))
        if ends.where("more > 1 or (more = 1 and least = 1)").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, e = e, cut(small)
        free(old)


def _roots(sig: DataFrame, found: DataFrame) -> DataFrame:
    """(d1, d2, rep, n_docs, n_rows, root) of each class."""
    root = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return sizes(sig).join(root, F.col("rep") == F.col("id"), "left").select("d1", "d2", "rep", "n_docs", "n_rows", F.coalesce("root", "rep").alias("root"))


def ngram_jaccard_join(docs: DataFrame, n: int = 2, threshold: float = 0.5, recall: float = 0.92, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of all documents.

    ``n_links`` is the number of other documents whose similarity is at least
    ``threshold``, copies included; ``class_id`` is the least doc_id of those that
    links connect a document with, itself included.
    """
    bands = choose_bands(threshold, recall, rows)
    sig = cut(signatures(docs, n, bands, rows, id_col, text_col))
    found = cut(linked(docs, sig, n, threshold, bands, rows, id_col, text_col))
    links = found.groupBy("rep", "d1").agg(F.sum("links").alias("links"))
    every = _roots(sig, found).join(links, ["rep", "d1"], "left")
    own = members(sig).select("d1", "d2", "doc_id").join(every, ["d1", "d2"]).select("doc_id", F.col("root").alias("class_id"), (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = sig.where("d1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return own.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, n: int = 2, threshold: float = 0.5, recall: float = 0.92, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the least id.

    A group is a connected component of joined documents.  Documents with
    nothing to compare (null or wordless texts, null ids) stay.  Of rows that
    repeat one doc_id with one text, one stays; they are looked for by id only
    where a word sequence has more rows than ids.
    """
    bands = choose_bands(threshold, recall, rows)
    sig = cut(signatures(docs, n, bands, rows, id_col, text_col))
    found = cut(linked(docs, sig, n, threshold, bands, rows, id_col, text_col))
    every = _roots(sig, found)
    key, repeated = fresh(docs, "gone", "again")
    own = members(sig).join(every.select("d1", "d2", "root"), ["d1", "d2"])
    gone = own.where("doc_id <> root").select(F.col("doc_id").alias(key)).distinct()
    id_ = F.col(f"`{id_col}`").cast("bigint")
    kept = docs.join(gone, id_ == F.col(key), "left_anti")
    again = cut(members(sig).where("n_rows > 1").select(F.col("doc_id").alias(repeated)).distinct())
    if again.isEmpty():
        return kept
    same = id_ == F.col(repeated)
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def sql(n: int = 2, threshold: float = 0.5) -> str:
    """The same rows by exact comparison of all pairs that share an n-gram."""
    return rf"""
with recursive words as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from documents where doc_id is not null),
sets as (select distinct doc_id, unnest(case when len(w) >= {n} then list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as gram from words),
n as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where k >= {threshold} * (x.n + y.n - k)),
reached(id, other) as (select distinct doc_id, doc_id from documents where doc_id is not null union select r.id, l.b from reached r join links l on l.a = r.other),
classes as (select id, min(other) as class_id from reached group by id)
select id as doc_id, class_id, cast((select count(*) from links where a = id) as bigint) as n_links from classes
"""
