from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline import __main__ as cli
from weftline import toy_models
from weftline.functions import sql
from weftline.operators.tokenizer import Tokenizer
from weftline.sources import resolver
from weftline.sources.documents import read_documents, scan_documents
from weftline.sources.tokenizer_json import byte_alphabet, from_json, from_json_str, from_ranks
from weftline.spec import ModelSpec, Template
from weftline.streaming import count_stream, encode_stream, padded_batches, windowed_counts

PUBLIC = Path("/opt/tokenizers")
SEP = "<SEP>"


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (b"first words<SEP>more of them<SEP>the end", 3), (b"<SEP>between two<SEP>", 1), (b"x y<SEP><SEP><SEP>z", 2), (b"no separator", 1), (b"", 0),
        (b"sound<SEP>bad \xff\xfe ones<SEP>sound again", 3), (SEP.join(f"document {k}" for k in range(200)).encode(), 200),
    ],
)
def test_documents(spark, tmp_path, content, want):
    (tmp_path / "a.txt").write_bytes(content)
    got = read_documents(spark, str(tmp_path), SEP).orderBy("doc_pos").collect()
    assert len(got) == want and all("�" in r.text or "bad" not in r.text for r in got)
    assert [r.text for r in got] == [x.decode(errors="replace") for x in content.split(b"<SEP>") if x]
    assert sorted(r.text for r in scan_documents(spark, str(tmp_path), SEP).collect()) == sorted(r.text for r in got)


def test_files(spark, tmp_path):
    for k, text in enumerate(("a b<SEP>c", "d", "e<SEP>f f", "")):
        (tmp_path / f"{k}.txt").write_text(text)
    t = Tokenizer(toy_models.bpe_bytes(template=Template.bert(1, 2)))
    paths = [str(tmp_path / f"{k}.txt") for k in range(4)]
    assert t.count_tokens_files(spark, paths, SEP).first().asDict() == {"documents": 5, "tokens": 9}
    rows = t.encode_files(spark, paths, SEP).orderBy("path", "doc_pos").collect()
    assert [r.ids for r in rows] == [[97, 32, 98], [99], [100], [101], [102, 32, 102]]
    assert read_documents(spark, paths, "").count() == 3
    with pytest.raises(Exception, match=r"(?i)path.*(exist|found)"):
        read_documents(spark, str(tmp_path / "missing.txt"), SEP).count()


def form(**parts):
    model = {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "Ġ": 3}, "merges": ["a b"]}
    return json.dumps({"model": model, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, **parts})


def test_forms():
    spec = from_json_str(form())
    assert spec.encoder == "bpe" and spec.pretokenizer[0][1] == "matches" and dict(spec.vocab)[3] == b" " and spec.merges == ((0, 1, 2),)
    assert from_json_str(form(), pretokenizer="cl100k").pretokenizer == "cl100k"
    assert from_json_str(form(), encoder="sp_bpe").encoder == "sp_bpe"
    assert from_json_str(form(normalizer={"type": "BertNormalizer", "lowercase": True, "strip_accents": False, "clean_text": True, "handle_chinese_chars": False})).normalizer == (("clean",), ("lowercase",))
    assert from_json_str(form(normalizer={"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"String": "x"}, "content": "y"}]})).normalizer == (("nfc",), ("lowercase",), ("replace", "x", "y"))
    two = {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "a", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "b", "type_id": 0}}],
           "pair": [{"SpecialToken": {"id": "a", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "b", "type_id": 0}}, {"Sequence": {"id": "B", "type_id": 1}}, {"SpecialToken": {"id": "b", "type_id": 1}}],
           "special_tokens": {"a": {"id": "a", "ids": [0], "tokens": ["a"]}, "b": {"id": "b", "ids": [1], "tokens": ["b"]}}}
    assert from_json_str(form(post_processor=two)).template == Template.bert(0, 1)
    assert from_json_str(form(post_processor={"type": "RobertaProcessing", "cls": ["a", 0], "sep": ["b", 1]})).template == Template((0,), (1,), (0,), (1,), (1,), (1,))
    wp = from_json_str(json.dumps({"model": {"type": "WordPiece", "vocab": {"[UNK]": 5, "a": 9}, "unk_token": "[UNK]"}, "pre_tokenizer": {"type": "BertPreTokenizer"}}))
    assert wp.encoder == "wordpiece" and wp.unk_id == 5 and wp.vocab == ((5, b"[UNK]"), (9, b"a"))
    uni = from_json_str(json.dumps({"model": {"vocab": [["<unk>", 0.0], ["▁a", -1.0]], "unk_id": 0}, "pre_tokenizer": {"type": "Metaspace", "prepend_scheme": "always"}}))
    assert uni.encoder == "unigram" and uni.normalizer == (("metaspace", "unless_led"),)
    for bad in ({"pre_tokenizer": {"type": "Strange"}}, {"normalizer": {"type": "Strange"}}, {"post_processor": {"type": "Strange"}}):
        with pytest.raises(ValueError, match="Strange"):
            from_json_str(form(**bad))
    assert len(byte_alphabet()) == 256


def test_save_and_load(tmp_path):
    for k, spec in enumerate((toy_models.letters(), toy_models.words(), toy_models.pieces_unigram(), toy_models.with_end_of_text(toy_models.letters(), lstrip=True))):
        spec.save(tmp_path / str(k))
        again = ModelSpec.load(tmp_path / str(k))
        assert again == spec and again.key == spec.key
        spec.save(tmp_path / str(k))
    head = json.loads((tmp_path / "0" / "model.json").read_text())
    (tmp_path / "0" / "model.json").write_text(json.dumps(head | {"unk_id": 3}))
    with pytest.raises(ValueError, match="damaged"):
        ModelSpec.load(tmp_path / "0")


def test_resolver_and_cli(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("WEFTLINE_CACHE", str(tmp_path / "cache"))
    (tmp_path / "org" / "m").mkdir(parents=True)
    (tmp_path / "org" / "m" / "tokenizer.json").write_text(form())
    a = resolver.from_pretrained("org/m", (tmp_path,))
    assert a == from_json_str(form()) and len(list((tmp_path / "cache").iterdir())) == 1
    (next((tmp_path / "cache").iterdir()) / "vocab.parquet").write_bytes(b"broken")
    try:
        assert resolver.from_pretrained("org/m", (tmp_path,)) == a
    finally:
        pass
    with pytest.raises(FileNotFoundError):
        resolver.from_pretrained("none", (tmp_path,))
    assert cli.main(["convert", str(tmp_path / "org" / "m" / "tokenizer.json"), str(tmp_path / "out")]) == 0
    assert ModelSpec.load(tmp_path / "out") == a
    assert cli.main(["cache", "clear"]) == 0 and "1 models" in capsys.readouterr().out


def test_cli_verify(spark, tmp_path, sf_dir, capsys):
    toy_models.letters().save(tmp_path / "a")
    toy_models.bpe_bytes(pretokenizer="gpt2").save(tmp_path / "b")
    corpus = f"{sf_dir}/documents.parquet"
    assert cli.main(["verify", str(tmp_path / "a"), str(tmp_path / "a"), corpus]) == 0
    assert cli.main(["verify", str(tmp_path / "a"), str(tmp_path / "b"), corpus]) == 1
    assert "0 of 200" in capsys.readouterr().out


@pytest.mark.skipif(not PUBLIC.exists(), reason="no public vocabularies here")
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_public_models(spark, sf_dir, name):
    tokenizers = pytest.importorskip("tokenizers")
    spec, other = from_json(PUBLIC / name), tokenizers.Tokenizer.from_file(str(PUBLIC / name))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(spark.createDataFrame([("",), ("\tword",), ("x <|endoftext|> y",), ("日本語 a\xa0\xa0b",)], "text string"))
    for r in docs.select("text", Tokenizer(spec).encode_ids(F.col("text")).alias("ids")).collect():
        assert r.ids == other.encode(r.text).ids


@pytest.mark.skipif(not PUBLIC.exists(), reason="no public vocabularies here")
def test_ranks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    a, b = (Tokenizer(s).encode_ids(F.col("text"), False) for s in (from_ranks(PUBLIC / "byte_bpe_50k.tiktoken"), from_json(PUBLIC / "byte_bpe_50k.json")))
    assert docs.where(a != b).count() == 0


@pytest.mark.skipif(not PUBLIC.exists(), reason="no public vocabularies here")
def test_sentencepiece_model(spark, sf_dir):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=str(PUBLIC / "piece_bpe_32k.model"))
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    merges = [(ids[p[:k]], ids[p[k:]], ids[p]) for p in sorted(ids, key=lambda p: -sp.get_score(ids[p])) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    spec = ModelSpec(encoder="sp_bpe", vocab=tuple((i, sp.id_to_piece(i).encode()) for i in range(sp.get_piece_size())), merges=tuple(merges), normalizer=(("replace", " ", "▁"), ("prepend", "▁")), unk_id=0, byte_fallback=True)
    t = Tokenizer(spec)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", t.encode_ids(F.col("text")).alias("ids"), t.decode(t.encode_ids(F.col("text"))).alias("back")).collect():
        assert r.ids == sp.encode(r.text) and r.back == r.text


def test_sql_functions(spark):
    spec = toy_models.with_end_of_text(toy_models.letters())
    sql.register(spark, spec)
    t = Tokenizer(spec)
    df = spark.createDataFrame([("the and <|endoftext|> that",), ("",), (None,)], "text string")
    df.createOrReplaceTempView("texts")
    want = df.select(t.encode_ids(F.col("text")), t.count_tokens(F.col("text")), t.decode(t.encode_ids(F.col("text")))).collect()
    got = spark.sql("select tok_encode_ids(text), tok_count(text), tok_decode(tok_encode_ids(text)) from texts").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    rows = spark.sql("select t.* from texts, lateral tok_tokens(text) t").collect()
    assert [r.id for r in rows] == want[0][0] and rows[0].token == "the"


def test_streams(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(60).repartition(3).write.parquet(str(tmp_path / "in"))
    own = spark.read.parquet(str(tmp_path / "in"))
    t = Tokenizer(toy_models.letters())
    stream = lambda: spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = encode_stream(stream(), t).writeStream.format("memory").queryName("ids").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert {r.doc_id: r.ids for r in spark.table("ids").collect()} == {r.doc_id: r.ids for r in own.select("doc_id", t.encode_ids(F.col("text")).alias("ids")).collect()}
    q = count_stream(stream(), t, "lang").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {r.lang: r.tokens for r in spark.table("counts").collect()} == {r[0]: r[1] for r in own.groupBy("lang").agg(F.sum(t.count_tokens(F.col("text")))).collect()}
    seen = []
    padded = Tokenizer(toy_models.letters().with_padding(direction="right", pad_to_multiple_of=8))
    padded_batches(stream(), padded, lambda df, k: seen.append({len(r.ids) for r in df.select("encoding.ids").collect()})).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start().awaitTermination(120)
    assert len(seen) == 3 and all(len(s) == 1 and next(iter(s)) % 8 == 0 for s in seen)
    timed = stream().withColumn("at", F.timestamp_seconds(F.col("doc_id") * 60))
    q = windowed_counts(timed, t, "at", "10 minutes", "0 seconds").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c4")).start()
    q.awaitTermination(120)
    assert spark.table("windows").count() > 0


def test_models_on_hadoop_paths(spark, tmp_path):
    spec = toy_models.words()
    path = f"file://{tmp_path}/models/words"
    spec.save(path)
    spec.save(path)  # over what is there
    assert ModelSpec.load(path) == spec
    assert Tokenizer(ModelSpec.load(path)).spec.key == spec.key


def test_templates_in_a_sequence():
    from weftline.sources.tokenizer_json import template_of
    from weftline.spec import Template

    def made(pair):
        node = {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "<s>", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}], "special_tokens": {"<s>": {"ids": [7]}}}
        return node | ({"pair": pair} if pair is not None else {})

    assert template_of({"type": "Sequence", "processors": [{"type": "ByteLevel"}, made(None)]}, {}) == Template((7,), (), (7,), (), (7,), ())
    two = [*made(None)["single"], {"Sequence": {"id": "B", "type_id": 1}}]
    assert template_of({"type": "Sequence", "processors": [made(two), {"type": "ByteLevel"}]}, {}) == Template((7,), (), (7,), (), (), ())
    with pytest.raises(ValueError, match="two post-processors"):
        template_of({"type": "Sequence", "processors": [made(two), made(two)]}, {})
