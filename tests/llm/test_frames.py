from __future__ import annotations

import random

import pytest
import zstandard

from weftline.llm import frames, tokens

from .helpers import ODD, documents, made_text


def rows_of(n=60):
    rng = random.Random(2)
    return [(k, made_text(rng, rng.choice([0, 3, 200, 3000]))) for k in range(n)] + [(70, "don't  stop now\n\n \t x"), (71, "　wide   spaces")] + ODD


def test_round_trip(spark):
    rows = rows_of()
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    files = frames.token_files(documents(spark, rows), frame_tokens=2000, file_tokens=20_000).collect()
    got = []
    for f in files:
        reader = frames.FileReader.of(f.content)
        own = [reader.document(i) for i in range(len(reader.index))]
        assert [i for i, _ in own] == list(f.doc_ids)
        assert f.n_docs == len(own) and f.n_tokens == sum(len(x) for _, x in own if x is not None)
        got += [(i, None if x is None else x.tolist()) for i, x in own]
        plain = b"".join(x.tobytes() for _, x in own if x is not None)
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(f.content)[: len(plain)] == plain
    key = lambda r: (str(r[0]), len(r[1] or ()))
    assert sorted(got, key=key) == sorted([(i, None if t is None else encode(t)) for i, t in rows], key=key)


def test_reads_only_what_is_wanted(spark):
    rng = random.Random(3)
    docs = documents(spark, [(k, made_text(rng, 2000)) for k in range(40)]).coalesce(1)
    (f,) = frames.token_files(docs, frame_tokens=4000, file_tokens=1 << 30).collect()
    reader = frames.FileReader.of(f.content)
    before = reader.bytes_read
    ((i, ids),) = list(reader.find([17]))
    assert i == 17 and len(ids)
    assert reader.bytes_read - before < len(f.content) / 10


def test_damage_is_found(spark):
    rng = random.Random(4)
    (f,) = frames.token_files(documents(spark, [(k, made_text(rng, 500)) for k in range(5)]).coalesce(1)).collect()
    reader = frames.FileReader.of(f.content)
    raw = bytearray(f.content)
    raw[int(reader.at[1]) - 6] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frames.FileReader.of(bytes(raw)).document(0)
    with pytest.raises(ValueError, match="seek table"):
        frames.FileReader.of(f.content[:-1])


def test_files_on_disk(spark, tmp_path):
    docs = documents(spark, rows_of(20))
    index = frames.write_files(frames.token_files(docs), str(tmp_path)).collect()
    assert sum(r.n_docs for r in index) == docs.count()
    reader = frames.FileReader.open(index[0].path)
    assert reader.document(0)[0] == index[0].doc_ids[0]


def test_empty_table(spark):
    assert frames.token_files(documents(spark, []).where("false")).count() == 0
