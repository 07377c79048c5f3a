from __future__ import annotations

import random

import corpus_pipeline
import pytest
from weftline.llm import common, queries

from .helpers import DOCS, ODD, documents
from .test_decontaminate import brute as spans_of
from .test_jaccard import brute as near_pairs
from .test_lines import brute as line_brute
from .test_quality import junk, sentences


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables with junk, boilerplate, near copies, leaked items and odd rows."""
    rng = random.Random(12)
    out = tmp_path_factory.mktemp("tables")
    items = [" ".join(sentences(rng, 4).replace(".", "").split()[:30]) for _ in range(5)]
    rows, labels = [], []
    for k in range(160):
        if k % 8 == 7:
            text = junk(rng, 15)
        elif k % 8 == 6:
            own = rows[-1][1].split(" ")
            own[3] = "changed"
            text = " ".join(own)
        else:
            text = sentences(rng, 12)
            if k % 10 == 1:
                text += "\n" + items[k % 5]
            if k % 3 == 0:
                text += "\nThis very line is printed on every page of all sites."
        rows.append((k, text, f"site{k % 11}"))
        labels.append((k, int(k % 8 != 7), 0))
    table = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows] + [(i, t, "en", "odd", None) for i, t in ODD], DOCS)
    table.repartition(5).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def test_stages(spark, folder):
    sf_dir, _, items = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "decontamination", "best-fit packing"]
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.cut(stages["quality rules"](spark, docs, sf_dir))
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    assert len([k for k in range(160) if k % 8 == 7 and k in ids]) <= 2
    assert len([k for k in range(160) if k % 8 != 7 and k not in ids]) <= 3

    lined = corpus_pipeline.cut(stages["line dedup"](spark, good, sf_dir))
    assert lined.columns == columns
    before = [(r.doc_id, r.text, r.source) for r in good.where("doc_id is not null").dropDuplicates().collect()]
    want = line_brute(before)
    after = {r.doc_id: r.text for r in lined.where("doc_id is not null").collect()}
    assert after == {i: t for i, (t, _) in want.items()}

    apart = corpus_pipeline.cut(stages["near duplicates"](spark, lined, sf_dir))
    assert apart.columns == columns
    kept = {r.doc_id for r in apart.collect()}
    small = {i: t for i, t in after.items() if i < 900}
    pairs = near_pairs(list(small.items()), 0.5)
    assert not [p for p in pairs if p[0] in kept and p[1] in kept]
    assert {i for i in small if not any(i in p for p in pairs)} <= kept

    clean = corpus_pipeline.cut(stages["decontamination"](spark, apart, sf_dir))
    assert clean.columns == columns and clean.count() == apart.count()
    texts = {r.doc_id: r.text for r in clean.where("doc_id < 900").collect()}
    for i, t in texts.items():
        own, at = small[i], 0
        left = ""
        for a, b in spans_of(own, items):
            left, at = left + own[at:a], b
        assert t == left + own[at:]

    bins = stages["best-fit packing"](spark, clean, sf_dir).collect()
    assert {i for r in bins for i in r.doc_ids} == {r.doc_id for r in clean.collect()}
    assert all(r.used <= 2048 for r in bins)


def test_run(spark, folder):
    sf_dir, _, _ = folder
    before = set(common._written)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(set(common._written) - before) == 1  # the stages' tables are gone
    assert rows and all(r.used == sum(p.length for p in r.pieces) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_odd_tables(spark, folder, name):
    df = queries.QUERIES[name](spark, folder[0])
    assert df.count() > 0 or name in ("op3_secret_scans", "op8_license_scans", "op9_pii")
    assert len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_queries_over_empty_tables(spark, folder, name, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    f = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert f(spark, str(tmp_path)).count() == 0


def test_sql_agrees(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder[0]}/documents.parquet/*.parquet' where doc_id is not null and doc_id < 900")
    docs = documents(spark, [(r[0], r[1], r[2]) for r in folder[1]])
    from weftline.llm import lines

    got = sorted(tuple(r) for r in lines.line_dedup(docs).collect())
    assert got == sorted(con.sql(queries.SQL["op10_line_dedup"]).fetchall())
