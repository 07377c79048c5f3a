"""Quality rules: an isolation forest on rule statistics.

Each document has ``FEATURES``, computed over its whole text.  The forest is
grown on a bounded sample of rows labelled good (about ``fit_rows``, those whose hash of
doc_id is below the share that gives so many; of the bad ones where no row is good); random splits isolate anomalous documents on short paths.  The
threshold on the anomaly score is calibrated on all labelled rows: among
thresholds that reject at most ``clean_loss`` of the good rows, the one with the
highest balanced accuracy, the least of equal ones; a score equal to the threshold
is rejected.  The forest sees no label but good, so calibrating on its own rows
tells little more of them than of others: half of the rows for each made results
worse with few labels (at sf0.01 48 % of the bad rows were kept, none before).

Cost: one pass over the texts gives a narrow table of statistics, written to
the shared folder; fitting and calibration read that table joined with the
labels; there is no shuffle of texts.  What is broadcast (the forest) has a fixed
size, and the driver gathers about ``fit_rows`` rows and one histogram.

Null and empty texts, and texts without words, have no statistics and are
rejected.  Repeated rows get the same decision.  Labels of null, or for unknown
documents, are ignored.  If no row is labelled, or none with one of the two
labels, nothing but texts without words is rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import reach
from .common import arrow_map, cut, documents_in, pick
from .text import U64, fold, reduce_by, slices, span_hashes, spans_of

FEATURES = ("word_length", "symbol_share", "upper_share", "digit_share", "distinct_share", "stutter_share", "top_share", "repeated_lines", "ended_lines", "mark_share")
#: How far beyond a node's range, in widths of it, splits are drawn.
MARGIN = 0.5
_KINDS = np.zeros((5, 256), bool)
for _k, _s in enumerate((b"#$%&*|@^~<>{}[]\\+=_`", bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(97, 123)) + bytes(range(65, 91)), b"!?.")):
    _KINDS[_k, list(_s)] = True


def statistics(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of FEATURES, number of words) of a run of texts."""
    n = len(off) - 1
    if not len(buf):
        return np.zeros((n, len(FEATURES))), np.zeros(n, np.int64)
    low, inside = fold(buf)
    start, end = spans_of(inside, off)
    h = span_hashes(low, start, end)
    at = np.searchsorted(start, off)
    words = np.diff(at)
    doc = np.repeat(np.arange(n), words)
    total = np.maximum(np.diff(off), 1)
    share = lambda mask: np.diff(np.append(0, np.cumsum(mask))[off])
    symbols, upper, digits, letters = (share(_KINDS[k][buf]) for k in range(4))
    marks = total - share(inside | (buf <= 32))

    key = np.sort((doc.astype(np.uint64) << U64(44)) | (h >> U64(20)))
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    owner = (key[first] >> U64(44)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    runs = np.diff(np.append(first, len(key)))
    top = reduce_by(np.maximum, runs, np.searchsorted(owner, np.arange(n + 1)), 0)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    stutter = np.bincount(doc[1:][same], minlength=n)

    line_start, line_end = spans_of(buf != 10, off)
    lines_at = np.searchsorted(line_start, off)
    lines = np.maximum(np.diff(lines_at), 1)
    line_doc = np.repeat(np.arange(n), np.diff(lines_at))
    line_key = np.sort((line_doc.astype(np.uint64) << U64(44)) | (span_hashes(buf, line_start, line_end) >> U64(20)))
    fresh = np.append(True, line_key[1:] != line_key[:-1]) if len(line_key) else np.zeros(0, bool)
    repeated = np.diff(lines_at) - np.bincount((line_key[fresh] >> U64(44)).astype(np.int64), minlength=n)
    ended = np.bincount(line_doc[_KINDS[4][buf[line_end - 1]]], minlength=n)

    # each share is drawn to an ordinary value by a few imagined words, so that a short text isn't extreme by chance
    toward = lambda count, size, value, weight: (count + value * weight) / (size + weight)
    x = np.stack([
        toward(np.diff(np.append(0, np.cumsum(end - start))[at]), words, 5.5, 30), toward(symbols, total, 0.0, 150), toward(upper, letters, 0.02, 150), toward(digits, total, 0.0, 600),
        toward(distinct, words**0.85, 1.1, 15), toward(stutter, words, 0.01, 30), toward(top, words, 0.04, 30), toward(repeated, lines, 0.0, 8), toward(ended, lines, 0.95, 6), toward(marks, words, 0.15, 30),
    ], 1)
    return x, words


@dataclass(frozen=True)
class Forest:
    """Arrays of (tree, node); a leaf's ``split`` is inf, and it leads to itself; ``path`` is the expected path length at a node."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    depth: int
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2**-(mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, path in zip(self.feature, self.split, self.left, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = left[node] + ((x[rows, feature[node]] >= split[node]) & np.isfinite(split[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7, beyond: float = MARGIN) -> Forest:
    """Splits are drawn from a node's range and ``beyond`` of its width on either side, so that what lies outside of all rows grown on is cut off too."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(1, math.ceil(math.log2(max(sample, 2)))) + 2
    grown = []
    for _ in range(trees):
        feature, split, left, path = [0], [np.inf], [0], [0.0]
        todo = [(0, x[rng.choice(len(x), sample, replace=False)], 0)]
        while todo:
            node, own, d = todo.pop()
            wide = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
            path[node] = d + _expected(len(own))
            if d == depth or not len(wide):
                continue
            f = int(rng.choice(wide))
            low, high = own[:, f].min(), own[:, f].max()
            at = rng.uniform(low - beyond * (high - low), high + beyond * (high - low))
            side = own[:, f] >= at
            feature[node], split[node], left[node] = f, at, len(feature)
            for part in (own[~side], own[side]):
                todo.append((len(feature), part, d + 1))
                feature.append(0)
                split.append(np.inf)
                left.append(len(left))
                path.append(0.0)
        grown.append((feature, split, left, path))
    size = max(len(t[0]) for t in grown)
    pad = lambda k, fill: np.array([[*t[k], *[fill] * (size - len(t[k]))] for t in grown])
    return Forest(pad(0, 0), pad(1, np.inf), pad(2, 0), pad(3, 0.0), depth, _expected(sample) or 1.0)


def _features(batches):
    for batch in batches:
        for a, b, buf, off in slices(batch.column(1)):
            x, words = statistics(buf, off)
            keep = np.flatnonzero(words > 0)
            if len(keep):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * len(FEATURES), pa.int32()), pa.array(x[keep].ravel()))
                yield {"doc_id": batch.column(0).slice(a, b - a).take(pa.array(keep)), "x": flat}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return arrow_map(documents_in(docs, id_col, text_col).where("text is not null"), _features, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Rules:
    forest: Forest | None
    threshold: float


def fit(x: DataFrame, labels: DataFrame, fit_rows: int = 20_000, clean_loss: float = 0.005, trees: int = 100, sample: int = 4096, bins: int = 4096, label_id: str = "doc_id", label_col: str = "quality") -> Rules:
    """The forest and threshold from statistics ``x`` (doc_id, x) and labels (1 good, 0 bad)."""
    known = pick(labels, doc_id=(label_id, "bigint"), good=(label_col, "int")).where("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))
    rows = x.join(known, "doc_id")
    labelled = dict(zip(*(c.to_pylist() for c in known.groupBy("good").count().toArrow().columns)))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    own = np.zeros((0, len(FEATURES)))
    for good in (1, 0):
        if good in labelled and not len(own):
            some = rows.where((F.col("good") == good) & (place < F.lit(fit_rows / labelled[good]))).select("doc_id", "x").toArrow().combine_chunks()
            own = _matrix(some.take(pc.sort_indices(some, [("doc_id", "ascending")])).column("x").combine_chunks())
    if not len(own):
        return Rules(None, 2.0)
    forest = grow(own, trees, sample)

    def histogram(batches):
        count = np.zeros((2, bins), np.int64)
        for batch in batches:
            score = np.minimum((forest.score(_matrix(batch.column(0))) * bins).astype(int), bins - 1)
            for good in (0, 1):
                count[good] += np.bincount(score[batch.column(1).to_numpy() == good], minlength=bins)
        good, bin_ = np.nonzero(count)
        yield {"good": good, "bin": bin_, "n": count[good, bin_]}

    got = arrow_map(rows.select("x", "good"), histogram, "good int, bin int, n long").groupBy("good", "bin").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((2, bins + 1))
    count[got.column("good").to_numpy(), got.column("bin").to_numpy()] = got.column("n").to_numpy()
    if not count.sum(1).all():
        return Rules(forest, 2.0)
    reject = 1 - (np.cumsum(count, 1) - count) / count.sum(1, keepdims=True)  # of each label, at a threshold of each bin's lower end
    value = np.where(reject[1] <= clean_loss, reject[0] - reject[1], -1)
    return Rules(forest, float(np.argmax(value)) / bins)


def scored(x: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, score, keep) for a table of statistics."""
    shared = x.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        r = shared.value
        for batch in batches:
            s = r.forest.score(_matrix(batch.column(1))) if r.forest else np.zeros(batch.num_rows)
            yield {"doc_id": batch.column(0), "score": s, "keep": s < r.threshold}

    return arrow_map(x.select("doc_id", "x"), run, "doc_id long, score double, keep boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """(doc_id, score) of the rows that pass, a row for each."""
    x = cut(features(docs, id_col, text_col))
    return scored(x, fit(x, labels, **fitting)).where("keep").drop("keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """``docs``, all columns, without the rows that the rules reject; rows without doc_id are judged too."""
    rules = fit(cut(features(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col)), labels, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    text = docs.columns.index(text_col)
    reach(docs.sparkSession)

    def run(batches):
        r = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, buf, off in slices(batch.column(text)):
                x, words = statistics(buf, off)
                keep[a:b] = (words > 0) & ((r.forest.score(x) < r.threshold) if r.forest else True)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.where(F.col(f"`{text_col}`").isNotNull()).mapInArrow(run, docs.schema)
