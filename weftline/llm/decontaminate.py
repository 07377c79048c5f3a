"""Benchmark decontamination by an FM-index per training shard.

The test phrases are all word n-grams of the benchmark's items (an item of
fewer than ``n`` words, but at least ``least``, is one phrase; a shorter one is
left out, as it says nothing).  Each task gathers whole documents into shards of
about ``shard_words`` words, indexes each, searches all phrases backward,
locates occurrences by sampled suffix positions, and merges overlapping or
adjoining occurrences of a document into removal spans.  A match never crosses
documents, so results don't depend on the shards.  Words outside the phrases'
vocabulary share one symbol of the index: no phrase has it.

There is no shuffle.  Phrases are broadcast in parts of at most ``part``
phrases; each shard is indexed once for each part, always over the whole texts,
and the parts' occurrences are merged as words of a document before anything is
cut, so results don't depend on the parts.

Null or empty texts have no spans.  Spans are in characters, end exclusive.
Rows without doc_id are not reported by ``contaminated`` but cleaned by
``decontaminate``.  Repeated rows are each treated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import reach
from .common import arrow_map, documents_in, lists, pick
from .fmindex import FIRST, OTHER, SEPARATOR, FMIndex
from .text import Words, buffers, char_offsets, slices

SPANS = "array<struct<start: int, end: int>>"


def _phrases(n: int, least: int):
    def run(batches):
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0)):
                w = Words(buf, off)
                out = []
                for a, b in zip(w.at[:-1], w.at[1:]):
                    if b - a >= n:
                        out += [w.hash[i : i + n].view(np.int64) for i in range(a, b - n + 1)]
                    elif b - a >= least:
                        out.append(w.hash[a:b].view(np.int64))
                if out:
                    yield {"phrase": out}

    return run


def test_phrases(benchmark: DataFrame, n: int, least: int, text_col: str = "text") -> DataFrame:
    """Distinct phrases, as arrays of word hashes."""
    return arrow_map(pick(benchmark, text=(text_col, "string")), _phrases(n, least), "phrase array<long>").distinct()


def phrase_parts(benchmark: DataFrame, n: int, least: int, part: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Broadcast parts: (vocabulary, phrases as rows of symbols, lengths)."""
    phrases = test_phrases(benchmark, n, least)
    parts = max(1, math.ceil(phrases.count() / part))
    out = []
    for k in range(parts):
        own = phrases if parts == 1 else phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k)
        rows = own.toArrow().column(0).combine_chunks()
        if not len(rows):
            continue
        flat, off = rows.values.to_numpy().view(np.uint64), rows.offsets.to_numpy()
        flat, off = flat[off[0] : off[-1]], off - off[0]
        vocabulary, symbol = np.unique(flat, return_inverse=True)
        lengths = np.diff(off)
        table = np.zeros((len(lengths), int(lengths.max())), np.uint32)
        row = np.repeat(np.arange(len(lengths)), lengths)
        table[row, table.shape[1] - lengths[row] + np.arange(len(flat)) - off[:-1][row]] = symbol + FIRST
        out.append((vocabulary, table, lengths))
    return out


def _merge(spans: np.ndarray) -> np.ndarray:
    """Sorted spans (rows of start, end) with those that overlap or adjoin merged."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], 1)


def _occurrences(words: list[Words], part) -> tuple[np.ndarray, np.ndarray]:
    """First and last places, among all words and separators, of a part's phrases."""
    vocabulary, table, lengths = part
    symbols = []
    for w in words:
        k = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
        s = np.where(vocabulary[k] == w.hash, k + FIRST, OTHER)
        symbols.append(np.insert(s, w.at[1:], SEPARATOR))
    index = FMIndex(np.concatenate(symbols), len(vocabulary) + FIRST)
    which, at = index.locate(*index.find(table, lengths))
    return at, at + lengths[which] - 1


def shard_spans(columns: list[pa.Array], parts: list) -> dict[tuple[int, int], np.ndarray]:
    """Byte spans of all parts' phrases by (column, row) for a shard of text columns; only texts with any."""
    held, where = [], []
    for c, column in enumerate(columns):
        for a, b, buf, off in slices(column):
            w = Words(buf, off)
            held.append(w)
            gap = np.insert(np.stack([w.start, w.end], 1), w.at[1:], 0, axis=0)
            row = np.repeat(np.arange(a, b), np.diff(w.at) + 1)
            where.append((np.full(len(row), c, np.int32), row, gap[:, 0] - off[row - a], gap[:, 1] - off[row - a]))
    first, last = (np.concatenate(x) for x in zip(*(_occurrences(held, p.value) for p in parts)))
    if not len(first):
        return {}
    c, row, start, end = (np.concatenate(x) for x in zip(*where))
    order = np.lexsort((first, row[first], c[first]))
    first, last = first[order], last[order]
    key = np.stack([c[first], row[first]], 1)
    cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    out = {}
    for a, b in zip(cuts, np.append(cuts[1:], len(first))):
        words = _merge(np.stack([first[a:b], last[a:b] + 1], 1))
        out[int(key[a, 0]), int(key[a, 1])] = np.stack([start[words[:, 0]], end[words[:, 1] - 1]], 1)
    return out


def in_shards(batches, text: int, shard_words: int):
    """Record batches gathered until they have about so many words (of six bytes)."""
    held, size = [], 0
    for batch in batches:
        rows, step = batch.num_rows, 0
        off = buffers(batch.column(text))[1]
        while step < rows:
            room = max(1, shard_words * 6 - size)
            to = min(rows, max(step + 1, int(np.searchsorted(off, off[step] + room, "right")) - 1))
            held.append(batch.slice(step, to - step))
            size += int(off[to] - off[step])
            step = to
            if size >= shard_words * 6:
                yield held
                held, size = [], 0
    if held:
        yield held


def _find(parts: list, shard_words: int):
    def run(batches):
        for held in in_shards(batches, 1, shard_words):
            found = shard_spans([b.column(1) for b in held], parts)
            ids, spans, at, texts = [], [], [0], []
            for (c, row), s in found.items():
                raw = held[c].column(1)[row].as_py()
                ids.append(held[c].column(0)[row].as_py())
                spans.append(char_offsets(np.frombuffer(raw.encode(), np.uint8), s.ravel()).reshape(-1, 2))
                at.append(at[-1] + len(s))
                texts.append(raw)
            if ids:
                flat = np.concatenate(spans).astype(np.int32)
                pairs = pa.StructArray.from_arrays([flat[:, 0], flat[:, 1]], ["start", "end"])
                yield {"doc_id": ids, "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs), "text": texts}

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: int = 5, shard_words: int = 1 << 20, part: int = 200_000, id_col: str = "doc_id", text_col: str = "text", benchmark_text: str = "text") -> DataFrame:
    """(doc_id, spans, n_removed, clean_text) of the documents that hold a test phrase."""
    d = documents_in(docs, id_col, text_col).where("text is not null and doc_id is not null")
    parts = phrase_parts(benchmark.select(F.col(f"`{benchmark_text}`").alias("text")), n, least, part)
    if not parts:
        return d.where("false").select("doc_id", F.array().cast(SPANS).alias("spans"), F.lit(0).alias("n_removed"), F.col("text").alias("clean_text"))
    context = docs.sparkSession.sparkContext
    one = arrow_map(d, _find([context.broadcast(p) for p in parts], shard_words), f"doc_id long, spans {SPANS}, text string")
    size = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return one.select("doc_id", "spans", size.alias("n_removed"), remove_spans(F.col("text"), F.col("spans")).alias("clean_text"))


def remove_spans(text, spans):
    """``text`` without merged spans."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"])), "")


def _clean(parts: list, shard_words: int, text: int, size: int | None):
    def run(batches):
        for held in in_shards(batches, text, shard_words):
            found = shard_spans([b.column(text) for b in held], parts)
            for c, batch in enumerate(held):
                own = {row: s for (k, row), s in found.items() if k == c}
                if own:
                    texts = batch.column(text).to_pylist()
                    sizes = batch.column(size).to_pylist() if size is not None else []
                    for row, spans in own.items():
                        raw = texts[row].encode()
                        kept = [raw[a:b] for a, b in zip([0, *spans[:, 1]], [*spans[:, 0], len(raw)])]
                        texts[row] = b"".join(kept).decode()
                        if size is not None:
                            sizes[row] = len(texts[row])
                    columns = list(batch.columns)
                    columns[text] = pa.array(texts, batch.schema.field(text).type)
                    if size is not None:
                        columns[size] = pa.array(sizes, batch.schema.field(size).type)
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: int = 5, shard_words: int = 1 << 20, part: int = 200_000, text_col: str = "text", size_col: str | None = "n_chars", benchmark_text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with the spans removed from the text and its length set anew in ``size_col``."""
    context = docs.sparkSession.sparkContext
    reach(docs.sparkSession)
    text = docs.columns.index(text_col)
    size = docs.columns.index(size_col) if size_col in docs.columns else None
    parts = phrase_parts(benchmark.select(F.col(f"`{benchmark_text}`").alias("text")), n, least, part)
    return docs.mapInArrow(_clean([context.broadcast(p) for p in parts], shard_words, text, size), docs.schema) if parts else docs
