"""Removal of lines that are spread over many sites.

A line's key is its text without outer spaces, as two 64-bit hashes; lines of
fewer than ``min_chars`` characters are never boilerplate.  For each key a
HyperLogLog sketch of the sites that have it is merged by aggregation (partial
sketches before the shuffle).  A key whose estimate is clearly at least
``min_sites`` is boilerplate, one clearly below is not; those within
``margin`` standard errors, or one site, of the threshold get exact distinct
counts.  A boilerplate line stays in the document of the least doc_id that has
it, so that no text is lost, and goes from all others.

Shuffles carry keys and numbers, not lines; the texts move at most once, when
the positions to remove are joined to them, and not at all if those are small
enough for Spark to broadcast.

Null and empty texts stay as they are, with no lines removed.  Rows without
doc_id count as documents of their sites but keep their lines.  A null site
doesn't count as a site.  Repeated rows are treated alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, pick


def _keyed(docs: DataFrame, min_chars: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    d = pick(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"), site=(site_col, "string")).where("text is not null")
    lines = d.select("doc_id", "site", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.trim("line")
    return lines.where(F.length(key) >= min_chars).select("doc_id", "version", "site", "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(11), key).alias("k2"))


def boilerplate(keyed: DataFrame, min_sites: int, log_k: int, margin: float) -> DataFrame:
    """(k1, k2, keeper) of the lines on at least ``min_sites`` sites."""
    error = margin * 1.04 / math.sqrt(1 << log_k)
    low, high = min(min_sites - 1, min_sites * (1 - error)), max(min_sites + 1, min_sites * (1 + error))
    spread = keyed.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_k))).alias("sites"), F.min("doc_id").alias("keeper")).where(F.col("sites") >= low)
    spread = cut(spread)
    near = spread.where(F.col("sites") <= high)
    exact = keyed.select("k1", "k2", "site").join(near.select("k1", "k2", "keeper"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.countDistinct("site").alias("n"), F.first("keeper").alias("keeper")).where(F.col("n") >= min_sites)
    return spread.where(F.col("sites") > high).select("k1", "k2", "keeper").unionByName(exact.select("k1", "k2", "keeper"))


def dedup_lines(docs: DataFrame, min_sites: int = 5, min_chars: int = 20, log_k: int = 10, margin: float = 3.0, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", size_col: str | None = "n_chars", count_col: str | None = None) -> DataFrame:
    """``docs``, all rows and columns, without boilerplate lines; the new length goes to ``size_col`` if there is such a column, the number of removed lines to ``count_col`` if given."""
    keyed = _keyed(docs, min_chars, id_col, text_col, site_col)
    found = cut(boilerplate(keyed, min_sites, log_k, margin))
    where, version, gone_at = fresh(docs, "id", "version", "gone")
    gone = keyed.join(found, ["k1", "k2"]).where("doc_id <> keeper").groupBy("doc_id", "version").agg(F.collect_set("pos").alias(gone_at))
    gone = gone.select(F.col("doc_id").alias(where), F.col("version").alias(version), gone_at)
    text, at = F.col(f"`{text_col}`"), F.col(gone_at)
    joined = docs.join(gone, (F.col(f"`{id_col}`").cast("bigint") == F.col(where)) & (F.xxhash64(text) == F.col(version)), "left")
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains(at, i), x)), lambda x: x.isNotNull())
    new = F.when(at.isNull(), text).otherwise(F.array_join(kept, "\n"))
    size = lambda c: F.length(new).cast(dict(docs.dtypes)[c]) if c == size_col else F.col(f"`{c}`")
    columns = [new.alias(c) if c == text_col else F.when(at.isNull(), F.col(f"`{c}`")).otherwise(size(c)).alias(c) if c == size_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([F.coalesce(F.size(at), F.lit(0)).alias(count_col)] if count_col else []))


def line_dedup(docs: DataFrame, min_sites: int = 5, min_chars: int = 20, **more) -> DataFrame:
    """(doc_id, text, n_removed) of all documents."""
    return dedup_lines(docs.select("doc_id", "text", "source"), min_sites, min_chars, size_col=None, count_col="n_removed", **more).select("doc_id", "text", "n_removed")


def sql(min_sites: int = 5, min_chars: int = 20) -> str:
    return f"""
with rows_ as (select row_number() over () as r, doc_id, text, source from documents),
lines as (select r, doc_id, source, generate_subscripts(l, 1) as pos, unnest(l) as line from (select *, string_split(text, chr(10)) as l from rows_ where text is not null)),
found as (select trim(line, ' ') as k, min(doc_id) as keeper from lines where length(trim(line, ' ')) >= {min_chars} group by 1 having count(distinct source) >= {min_sites}),
marked as (select l.*, f.k is not null and l.doc_id <> f.keeper as gone from lines l left join found f on f.k = trim(l.line, ' ')),
done as (select r, coalesce(string_agg(line, chr(10) order by pos) filter (where not coalesce(gone, false)), '') as text, count(*) filter (where gone) as n_removed from marked group by r)
select r.doc_id, d.text, cast(coalesce(d.n_removed, 0) as integer) as n_removed from rows_ r left join done d using (r)
"""
