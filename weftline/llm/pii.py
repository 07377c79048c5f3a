"""Personal identifiers by bootstrapped contextual extraction.

Candidates are stretches of text with a digit or ``@`` that are shaped like an
identifier (an address, a phone number, groups of digits, a mixed code).
Seeds are the candidates that prove themselves (address grammar, octets of an
IP address, Luhn or mod-97 check digits, a country code, groups of digits of a
telephone or social security number) and, if given, a table of
known values.  Around each candidate lie lexical patterns: the two words before
it, the word before, the word after, the words on both sides (each with the
candidate's class), and its own skeleton (``9{4}-A{2}``;
not of one that breaks the check digits or bounds of its shape).

Patterns and values form a graph.  In each round a pattern's confidence is the
lower bound (Wilson) of the share of its distinct values that are trusted, and
a value that isn't a seed gets the noisy-or of its patterns of at least
``least_confidence``; values so trusted strengthen the patterns of the next round.
Values that reach ``confident`` are identifiers wherever they occur as that
class of candidate, seen with a pattern or not.

Cost: one pass over the texts gives a narrow table of candidates, written to the
shared folder; distinct (pattern, value) edges are made once; each round is two
aggregations over them, whose results are tables in the shared folder.

Null and empty texts have no candidates; rows without doc_id are told with a null
id; repeated rows are told each, and count once in the graph, as it holds
distinct values.  Spans are in characters, end exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, documents_in, pick
from .text import slices, spans_of

#: A candidate that isn't an address needs so many letters and digits, and digits, to tell one person from another.
LEAST_SIGNS, LEAST_DIGITS = 6, 4
#: So many capitals at most follow one another in what the pattern of a code takes.
LONGEST_CODE = 31

CANDIDATE = re.compile(
    r"""(?x)
    (?P<email>[^\W_][\w.+-]*@[^\W_][\w-]*(?:\.[\w-]*[^\W_])+)
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
    |(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w]|[.-]\d))
    |(?P<code>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    |(?P<number>(?<!\w)(?:\(\d{2,4}\)[ .]?\d{2,4}(?:\.\d{2,4}){1,3}|(?<!\d\.)\d{1,4}(?:\.\d{2,4}){2,4}|(?:\(\d{2,4}\)[ ]?)?(?:\d{1,6}(?:[ -]\d{1,6})+|\d+))(?![\w]|\.\d))
    |(?P<mixed>(?<!\w)(?=[\w-]*\d)[^\W_][\w-]*(?!\w))
    """
)
_KINDS = ("email", "ip", "phone", "code", "number", "mixed")
_WORD = re.compile(r"\w+")
_RUN = re.compile(r"\d+|[a-z]+|[A-Z]+|[^\W\d_]+")
_HOT = np.zeros(256, bool)
_HOT[48:58], _HOT[64] = True, True
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False


#: A North American telephone number, or a social security number of a range that is given out.
_GROUPED = re.compile(r"\(?[2-9]\d\d\)?[ -]\d{3}-\d{4}|(?:1\.)?[2-9]\d\d\.\d{3}\.\d{4}|\([2-9]\d\d\)[ .]?\d{3}\.\d{4}|(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k & 1:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def proves(kind: str, raw: str) -> bool:
    """Whether a candidate shows by itself that it is an identifier."""
    if kind == "email":
        return raw.rsplit(".", 1)[1].isalpha() and ".." not in raw
    if kind == "ip":
        return all(int(x) < 256 for x in raw.split("."))
    digits = "".join(c for c in raw if "0" <= c <= "9")
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "code":
        flat = raw.replace(" ", "")
        return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    if kind == "number":
        return bool(_GROUPED.fullmatch(raw)) or (13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits))
    return False


def fails(kind: str, raw: str) -> bool:
    """Whether a candidate is shaped like what has check digits or bounds, and breaks them: its shape then speaks for nothing."""
    if kind == "number":
        return 13 <= sum("0" <= c <= "9" for c in raw) <= 19 and not proves(kind, raw)
    return kind in ("ip", "code") and not proves(kind, raw)


def skeleton(raw: str) -> str:
    """The runs of a value's digits and letters by class and length; of an address only that it is one."""
    return _RUN.sub(lambda m: ("9" if m[0][0].isdigit() else "A" if m[0][0].isupper() else "a") + (f"{{{len(m[0])}}}" if len(m[0]) > 1 else ""), raw)


def normal(kind: str, raw: str) -> str:
    """A value without what may differ between its spellings."""
    return raw.lower() if kind == "email" else re.sub(r"[ ().-]", "", raw).upper() if kind != "ip" else raw


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode()) - (1 << 63)


def words_before(text: str, at: int) -> list[str]:
    """The last two words before a place, whole."""
    width = 40
    while True:
        width *= 2
        words = [w.lower() for w in _WORD.findall(text[max(0, at - width) : at])]
        if at <= width or len(words) > 2:  # the first may be cut
            return words[-2:]


def candidates_in(text: str, stretches: list[tuple[int, int]]):
    """(start, end, class, value, raw, patterns) of the candidates in stretches of a text, which hold whole words."""
    for a, b in stretches:
        for m in CANDIDATE.finditer(text, a, b):
            kind, raw = m.lastgroup, m[0]
            signs = sum(c.isalnum() for c in raw)
            if kind in ("number", "mixed", "code") and (signs < LEAST_SIGNS or sum("0" <= c <= "9" for c in raw) < LEAST_DIGITS):
                continue
            before, after = words_before(text, m.start()), _WORD.search(text, m.end())
            after = after[0].lower() if after else ""
            last = before[-1] if before else ""
            patterns = [] if fails(kind, raw) else [_hash("S", kind, skeleton(raw)) if kind != "email" else _hash("S", kind)]
            if len(before) == 2:
                patterns.append(_hash("LL", kind, *before))
            if last:
                patterns.append(_hash("L", kind, last))
            if after:
                patterns.append(_hash("R", kind, after))
            if last and after:
                patterns.append(_hash("LR", kind, last, after))
            yield m.start(), m.end(), kind, _hash(kind, normal(kind, raw)), raw, patterns


def _stretches(buf: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text, byte spans of whole chunks that no candidate of the text reaches over.

    They are neighbouring chunks with a digit or ``@``, and those without that
    follow by one space and are capitals only, as in the groups of a code: the
    capitals that another sign ends are taken with that sign, and end the stretch.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(off) - 1)]
    if not _HOT[buf].any():
        return out
    start, end = spans_of(_INK[buf], off)
    row = np.searchsorted(off, start, "right") - 1
    hot = np.zeros(len(start), bool)
    hot[np.searchsorted(start, np.flatnonzero(_HOT[buf]), "right") - 1] = True
    near = np.append(False, (row[1:] == row[:-1]) & (start[1:] == end[:-1] + 1))
    other = np.append(np.flatnonzero((buf < 65) | (buf > 90)), len(buf))
    capitals = np.minimum(other[np.searchsorted(other, start)], end) - start
    linked = near & ~hot & (capitals > 0) & (capitals <= LONGEST_CODE)
    whole = linked & (start + capitals == end)
    stop = np.maximum.accumulate(np.where(whole, 0, np.arange(len(start))))  # the last chunk, this one or before, that isn't only capitals in a row of them
    taken = hot | (linked & np.append(False, hot[stop[:-1]]))
    end = np.where(hot | whole, end, start + capitals + 1)
    chunk = np.flatnonzero(taken)
    new = np.ones(len(chunk), bool)
    new[1:] = (chunk[1:] != chunk[:-1] + 1) | ~near[chunk[1:]] | ~(hot | whole)[chunk[:-1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(chunk)) - 1
    for r, a, b in zip(row[chunk[first]].tolist(), start[chunk[first]].tolist(), end[chunk[last]].tolist()):
        out[r].append((a - int(off[r]), b - int(off[r])))
    return out


def _find(batches):
    for batch in batches:
        for a, b, buf, off in slices(batch.column(1)):
            if not len(buf):
                continue
            rows = {k: [] for k in ("doc_id", "start", "end", "kind", "value", "seed", "patterns")}
            for r, own in enumerate(_stretches(buf, off)):
                if not own:
                    continue
                raw = buf[off[r] : off[r + 1]]
                text = raw.tobytes().decode()
                if len(text) != len(raw):
                    at = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                    own = [(int(at[x]), int(at[y])) for x, y in own]
                doc_id = batch.column(0)[a + r].as_py()
                for x, y, kind, value, found, patterns in candidates_in(text, own):
                    for key, v in zip(rows, (doc_id, x, y, kind, value, proves(kind, found), patterns)):
                        rows[key].append(v)
            if rows["doc_id"]:
                yield rows


def candidates(docs: DataFrame) -> DataFrame:
    return arrow_map(docs, _find, "doc_id long, start int, end int, kind string, value long, seed boolean, patterns array<long>")


def _seed_values(batches):
    for batch in batches:
        out = [(_hash(m.lastgroup, normal(m.lastgroup, m[0]))) for x in batch.column(0).to_pylist() if x for m in [CANDIDATE.fullmatch(x.strip())] if m]
        if out:
            yield {"value": out}


def wilson(good, n, z: float = 1.64):
    """The lower bound of a share of ``good`` in ``n``."""
    p = good / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def bootstrap(found: DataFrame, seeds: DataFrame, rounds: int, confident: float, least_values: int, least_confidence: float) -> DataFrame:
    """(value, score, seed) of the trusted values of the graph between patterns and values; seeds have the score 1."""
    own = seeds.select("value").distinct().select("value", F.lit(1.0).alias("score"), F.lit(True).alias("seed"))
    trusted = cut(own)
    edges = cut(found.select("value", F.explode("patterns").alias("pattern")).distinct())
    for _ in range(rounds):
        scored = edges.join(trusted, "value", "left").groupBy("pattern").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("good"), F.count("*").alias("n"))
        patterns = cut(scored.where((F.col("n") >= least_values) & (F.col("good") > 0)).select("pattern", wilson(F.col("good"), F.col("n")).alias("confidence")).where(F.col("confidence") >= least_confidence))
        new = edges.join(patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")).where(F.col("score") >= confident)
        trusted = cut(own.unionByName(new.join(own.select("value"), "value", "left_anti").withColumn("seed", F.lit(False))))
    return trusted


def extract_identifiers(docs: DataFrame, known: DataFrame | None = None, rounds: int = 3, confident: float = 0.8, least_values: int = 3, least_confidence: float = 0.4, id_col: str = "doc_id", text_col: str = "text", known_col: str = "value") -> DataFrame:
    """(doc_id, start, end, kind, seed, score) of the identifiers; ``known`` is a table of values to take as seeds too."""
    found = cut(candidates(documents_in(docs, id_col, text_col).where("text is not null")))
    seeds = found.where("seed").select("value")
    if known is not None:
        seeds = seeds.unionByName(arrow_map(pick(known, value=(known_col, "string")), _seed_values, "value long"))
    seeds = cut(seeds.distinct())
    trusted = bootstrap(found, seeds, rounds, confident, least_values, least_confidence)
    return found.drop("patterns", "seed").join(trusted, "value").select("doc_id", "start", "end", "kind", "seed", "score")
