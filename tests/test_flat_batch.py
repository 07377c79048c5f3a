from __future__ import annotations

import hashlib

import pytest

from weftline import queries
from weftline.operators.tokenizer import Tokenizer


def test_flat_batch_encodes(spark, sf_dir, monkeypatch):
    """The places are those of ids that the tokenizer made, not of byte lengths."""
    made, encode = [], Tokenizer.encode_batch_flat

    def watched(self, *args, **more):
        made.append(encode(self, *args, **more))
        return made[-1]

    monkeypatch.setattr(Tokenizer, "encode_batch_flat", watched)
    got = sorted((r.doc_id, r.n, r.start, r.digest) for r in queries.QUERIES["d8_flat_batch"](spark, sf_dir).collect())
    assert len(made) == 1
    ids = {r.doc_id: r.ids for r in made[0].select("doc_id", "ids").collect()}
    place = 0
    for doc_id, n, start, digest in got:
        assert (n, start) == (len(ids[doc_id]), place)
        assert digest == hashlib.md5(" ".join(map(str, ids[doc_id])).encode()).hexdigest()
        place += n


def test_public_ids_are_those_of_another_library(spark, sf_dir):
    """On whole documents, id for id, with the same ranks."""
    tiktoken = pytest.importorskip("tiktoken")
    from base64 import b64decode
    from pathlib import Path

    from weftline.public_queries import VOCABULARY, public

    if not Path(VOCABULARY).exists():
        pytest.skip("no public vocabularies here")
    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, Path(VOCABULARY).read_bytes().splitlines())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in queries.table(spark, sf_dir, "documents").select("text", Tokenizer(public()).encode_ids(queries.F.col("text")).alias("ids")).collect():
        assert r.ids == other.encode_ordinary(r.text)
