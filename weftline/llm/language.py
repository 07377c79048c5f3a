"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; the n-grams of 1 to ``order`` characters are hashed
into ``buckets`` for each order.  The model is fitted on a bounded sample of
labelled rows, about ``fit_rows`` of each language, those whose hash of doc_id is
below the share that gives so many; their n-grams are counted by Spark.  The
log-probability matrix (languages x orders x buckets, at most ``ENTRIES``, else an
error, whatever the corpus) is broadcast, and whole texts are scored in batches by gathering and summing.

Cost: one pass to fit (texts outside the sample are dropped before Python), one
to score; no shuffle of texts.

Null texts, and texts without letters, have no language (null) and margin 0.
Rows with a null label are not fitted on.  Every row is returned once,
rows without doc_id too.  With no labelled row, no text has a language.
Ties go to the first language by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick
from .text import U64, _tables, slices


def characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, and the texts' bounds in them."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = buf[at].astype(np.uint32)
    cp = b.copy()
    for low, high, size, mask in ((0xC2, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
        k = np.flatnonzero((b >= low) & (b < high))
        if len(k):
            x = b[k] & mask
            for j in range(1, size):
                x = (x << 6) | (buf[at[k] + j] & 0x3F)
            cp[k] = x
    small = cp < 1 << 16
    lower = _tables()[0]
    cp = np.where(small, lower[np.where(small, cp, 0)], cp)
    return cp, np.searchsorted(at, off)


def hashed(cp: np.ndarray, bounds: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, bounds) of the n-grams of each text; a text of fewer than n characters has none."""
    m = max(len(cp) - n + 1, 0)
    x = cp.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = x[:m].copy()
        for j in range(1, n):
            h = h * U64(0x100000001B3) + x[j : j + m]
        h = (h * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)
    full = np.maximum(np.diff(bounds) - n + 1, 0)
    ok = np.ones(m, bool)
    for k in range(1, n):  # n-grams that begin in the last n-1 characters of a text would cross its end
        cross = bounds[1:] - k
        ok[cross[(cross >= 0) & (cross < m)]] = False
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(full, out=out[1:])
    return h[ok].astype(np.int64), out


#: The log-probability matrix has at most so many entries, four bytes each; more labels than fit are an error.
ENTRIES = 1 << 25
#: Labels up to so many are broadcast to draw the sample.
BROADCAST_ROWS = 10_000


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, order: int, bits: int, alpha: float = 0.5):
        self.langs, self.order, self.bits = langs, order, bits
        total = counts.sum(2, keepdims=True)
        self.log = np.log((counts + alpha) / (total + alpha * counts.shape[2])).astype(np.float32)

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probabilities by text and language, number of letters, number of characters)."""
        cp, bounds = characters(buf, off)
        out = np.zeros((len(off) - 1, len(self.langs)))
        for n in range(1, self.order + 1):
            h, at = hashed(cp, bounds, n, self.bits)
            some = np.flatnonzero(at[1:] > at[:-1])
            if len(some):
                for k in range(len(self.langs)):
                    out[some, k] += np.add.reduceat(self.log[k, n - 1][h], at[some], dtype=np.float64)
        letters = np.append(0, np.cumsum(np.where(cp < 1 << 16, _tables()[1][np.minimum(cp, 65535)] & ~((cp >= 48) & (cp < 58)) & (cp != 95), True)))[bounds]
        return out, np.diff(letters), np.diff(bounds)


def fit(docs: DataFrame, fit_rows: int, order: int, bits: int, id_col: str, text_col: str, label_col: str) -> Model | None:
    known = pick(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"), lang=(label_col, "string")).where("lang is not null")
    counts = known.groupBy("lang").count().toArrow()  # reads the labels alone
    if not counts.num_rows:
        return None
    if counts.num_rows * order << bits > ENTRIES:
        raise ValueError(f"{counts.num_rows} labels are too many for {order} orders of {1 << bits} buckets")
    share = docs.sparkSession.createDataFrame([(lang, fit_rows / n) for lang, n in zip(*(c.to_pylist() for c in counts.columns))], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("fit")), 11) / F.lit(float(1 << 53))
    sample = known.where("text is not null").join(F.broadcast(share) if counts.num_rows <= BROADCAST_ROWS else share, "lang").where(place < F.col("share")).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                own = batch.column(1).filter(pc.equal(batch.column(0), lang))
                mine = total.setdefault(lang, np.zeros((order, 1 << bits), np.int64))
                for _, _, buf, off in slices(own):
                    cp, bounds = characters(buf, off)
                    for n in range(1, order + 1):
                        mine[n - 1] += np.bincount(hashed(cp, bounds, n, bits)[0], minlength=1 << bits)
        for lang, mine in total.items():
            n, bucket = np.nonzero(mine)
            yield {"lang": pa.array([lang] * len(n), pa.string()), "n": n, "bucket": bucket, "c": mine[n, bucket]}

    got = arrow_map(sample, count, "lang string, n int, bucket int, c long").groupBy("lang", "n", "bucket").agg(F.sum("c").alias("c")).toArrow()
    langs = sorted(got.column("lang").unique().to_pylist())
    if not langs:
        return None
    counts = np.zeros((len(langs), order, 1 << bits))
    row = {x: k for k, x in enumerate(langs)}
    counts[[row[x] for x in got.column("lang").to_pylist()], got.column("n").to_numpy(), got.column("bucket").to_numpy()] = got.column("c").to_numpy()
    return Model(langs, counts, order, bits)


def identify_language(docs: DataFrame, fit_rows: int = 1000, order: int = 3, bits: int = 14, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, language, margin): margin is the mean log-odds to the next language by character."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows, order, bits, id_col, text_col, label_col))

    def run(batches):
        m = model.value
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                if m is None or not len(buf):
                    yield {"doc_id": ids, "language": pa.nulls(b - a, pa.string()), "margin": np.zeros(b - a)}
                    continue
                s, n, size = m.score(buf, off)
                best = s.argmax(1)
                top = np.sort(s, 1)
                margin = (top[:, -1] - top[:, -2]) / np.maximum(size, 1) if s.shape[1] > 1 else np.zeros(b - a)
                yield {"doc_id": ids, "language": pa.array(np.array(m.langs, object)[best], pa.string(), mask=n == 0), "margin": np.where(n == 0, 0.0, margin)}

    return arrow_map(pick(docs, doc_id=(id_col, "bigint"), text=(text_col, "string")), run, "doc_id long, language string, margin double")
