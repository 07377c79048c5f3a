"""A tokenization model as an immutable value: vocabulary, merges, normalizer, pretokenizer, templates.

``ModelSpec`` is built on the driver, sent to the workers once as a broadcast,
and saved as Parquet tables with a JSON header.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import shutil
import tempfile
from dataclasses import dataclass, field, replace
from functools import cached_property
from pathlib import Path

ENCODERS = ("bpe", "wordpiece", "sp_bpe", "unigram")
DIRECTIONS = ("right", "left")
STRATEGIES = ("longest_first", "only_first", "only_second")


@dataclass(frozen=True)
class AddedToken:
    id: int
    content: str
    special: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = False
    single_word: bool = False


@dataclass(frozen=True)
class Template:
    """Ids put before and after a single text, and before and after each text of a pair."""

    single_prefix: tuple[int, ...] = ()
    single_suffix: tuple[int, ...] = ()
    pair_a_prefix: tuple[int, ...] = ()
    pair_a_suffix: tuple[int, ...] = ()
    pair_b_prefix: tuple[int, ...] = ()
    pair_b_suffix: tuple[int, ...] = ()

    @classmethod
    def bert(cls, start: int, end: int) -> Template:
        return cls((start,), (end,), (start,), (end,), (), (end,))

    @classmethod
    def prefix(cls, start: int) -> Template:
        return cls((start,), (), (start,), (), (start,), ())

    @property
    def specials(self) -> tuple[int, ...]:
        return tuple(sorted({*self.single_prefix, *self.single_suffix, *self.pair_a_prefix, *self.pair_a_suffix, *self.pair_b_prefix, *self.pair_b_suffix}))

    def added(self, pair: bool = False) -> int:
        if pair:
            return sum(map(len, (self.pair_a_prefix, self.pair_a_suffix, self.pair_b_prefix, self.pair_b_suffix)))
        return len(self.single_prefix) + len(self.single_suffix)


@dataclass(frozen=True)
class Padding:
    """``length`` None pads to the longest of the batch."""

    direction: str = "right"
    pad_id: int = 0
    pad_type_id: int = 0
    length: int | None = None
    pad_to_multiple_of: int | None = None

    def __post_init__(self):
        if self.direction not in DIRECTIONS:
            raise ValueError(f"direction {self.direction!r} is none of {DIRECTIONS}")


@dataclass(frozen=True)
class Truncation:
    """``stride`` is accepted at 0 only: no windows of what overflows are made."""

    max_length: int = 512
    stride: int = 0
    strategy: str = "longest_first"
    direction: str = "right"

    def __post_init__(self):
        if self.direction not in DIRECTIONS:
            raise ValueError(f"direction {self.direction!r} is none of {DIRECTIONS}")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy {self.strategy!r} is none of {STRATEGIES}")
        if self.stride:
            raise ValueError("overflowing windows aren't supported: stride must be 0")


@dataclass(frozen=True)
class ModelSpec:
    """``vocab`` has (id, bytes) pairs; ids may have gaps.  ``merges`` are (left, right, merged) ids in order of rank.

    ``normalizer`` is a tuple of steps of ``functions.normalize``, ``pretokenizer``
    a name or stages of ``functions.pretokenize``, or None.
    """

    encoder: str
    vocab: tuple[tuple[int, bytes], ...]
    merges: tuple[tuple[int, int, int], ...] = ()
    scores: tuple[float, ...] = ()
    normalizer: tuple[tuple, ...] = ()
    pretokenizer: str | tuple | None = None
    added: tuple[AddedToken, ...] = ()
    template: Template = field(default_factory=Template)
    unk_id: int | None = None
    byte_fallback: bool = False
    ignore_merges: bool = False
    fuse_unk: bool = False
    continuing_prefix: str = "##"
    word_end: str = ""
    max_chars: int = 100
    add_prefix_space: bool = False
    pad_token_id: int | None = None
    padding: Padding | None = None
    truncation: Truncation | None = None

    def __post_init__(self):
        if self.encoder not in ENCODERS:
            raise ValueError(f"encoder {self.encoder!r} is none of {ENCODERS}")
        if self.scores and len(self.scores) != len(self.vocab):
            raise ValueError("scores and vocab differ in length")

    @cached_property
    def key(self) -> str:
        """A digest of what decides the ids."""
        return hashlib.sha256(pickle.dumps((self.encoder, self.vocab, self.merges, self.scores, self.normalizer, self.pretokenizer, self.added, self.unk_id, self.byte_fallback, self.ignore_merges, self.fuse_unk, self.continuing_prefix, self.word_end, self.max_chars, self.add_prefix_space))).hexdigest()

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return dict(self.vocab) | {t.id: t.content.encode() for t in self.added}

    @property
    def vocab_size(self) -> int:
        return len(self.tokens)

    @property
    def decoder(self) -> str:
        return {"bpe": "byte_level", "wordpiece": "wordpiece"}.get(self.encoder, "metaspace")

    def num_special_tokens_to_add(self, is_pair: bool = False) -> int:
        return self.template.added(is_pair)

    def with_padding(self, padding: Padding | None = None, **options) -> ModelSpec:
        return replace(self, padding=padding or (Padding(**options) if options else None))

    def with_truncation(self, truncation: Truncation | None = None, **options) -> ModelSpec:
        return replace(self, truncation=truncation or (Truncation(**options) if options else None))

    def is_valid_pair(self, left: int, right: int) -> bool:
        """Whether two ids may stand side by side: no merge rule joins them."""
        return all((a, b) != (left, right) for a, b, _ in self.merges)

    # tables

    def header(self) -> dict:
        plain = {k: getattr(self, k) for k in ("encoder", "normalizer", "pretokenizer", "unk_id", "byte_fallback", "ignore_merges", "fuse_unk", "continuing_prefix", "word_end", "max_chars", "add_prefix_space", "pad_token_id")}
        return plain | {"format": 1, "template": vars(self.template), "key": self.key}

    def vocab_rows(self) -> list[tuple]:
        score = self.scores or [None] * len(self.vocab)
        special = {t.id for t in self.added if t.special} | set(self.template.specials)
        rows = [(i, b, b.decode(errors="replace"), len(b), s, i in special) for (i, b), s in zip(self.vocab, score)]
        known = {i for i, _ in self.vocab}
        return rows + [(t.id, t.content.encode(), t.content, len(t.content.encode()), None, t.special) for t in self.added if t.id not in known]

    def save(self, folder: str | Path) -> None:
        """Writes the model to a new folder beside its place, and then renames that; a path with a scheme is one of a file system of Hadoop's."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        from .sources import storage

        if storage.is_remote(folder):
            with tempfile.TemporaryDirectory(prefix="weftline-save-") as own:
                self.save(Path(own) / "model")
                storage.put(Path(own) / "model", str(folder))
            return
        folder = Path(folder)
        folder.parent.mkdir(parents=True, exist_ok=True)
        own = Path(tempfile.mkdtemp(prefix=f".{folder.name}-", dir=folder.parent))
        pq.write_table(pa.table({"id": pa.array([i for i, _ in self.vocab], pa.int32()), "token": pa.array([b for _, b in self.vocab], pa.binary()), "score": pa.array(list(self.scores) or [None] * len(self.vocab), pa.float64())}), own / "vocab.parquet")
        pq.write_table(pa.table({k: pa.array([m[j] for m in self.merges], pa.int32()) for j, k in enumerate(("left", "right", "merged"))}), own / "merges.parquet")
        names = list(AddedToken.__dataclass_fields__)
        kinds = {"id": pa.int32(), "content": pa.string()}
        pq.write_table(pa.table({n: pa.array([getattr(t, n) for t in self.added], kinds.get(n, pa.bool_())) for n in names}), own / "added.parquet")
        (own / "model.json").write_text(json.dumps(self.header(), default=lambda b: {"bytes": b.hex()}))
        if folder.exists():
            shutil.rmtree(folder)
        os.replace(own, folder)

    @classmethod
    def load(cls, folder: str | Path) -> ModelSpec:
        import pyarrow.parquet as pq

        from .sources import storage

        if storage.is_remote(folder):
            with storage.fetched(str(folder)) as own:
                return cls.load(own)
        folder = Path(folder)
        head = json.loads((folder / "model.json").read_text(), object_hook=lambda d: bytes.fromhex(d["bytes"]) if d.keys() == {"bytes"} else d)
        tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
        vocab, merges = pq.read_table(folder / "vocab.parquet"), pq.read_table(folder / "merges.parquet")
        scores = vocab["score"].to_pylist()
        own = {k: tuples(v) for k, v in head.items() if k not in ("format", "template", "key")}
        spec = cls(
            **own, vocab=tuple(zip(vocab["id"].to_pylist(), vocab["token"].to_pylist())), scores=tuple(scores) if scores and scores[0] is not None else (),
            merges=tuple(zip(*(merges[k].to_pylist() for k in ("left", "right", "merged")))), added=tuple(AddedToken(**r) for r in pq.read_table(folder / "added.parquet").to_pylist()),
            template=Template(**{k: tuple(v) for k, v in head["template"].items()}),
        )
        if spec.key != head["key"]:
            raise ValueError(f"{folder} is damaged: its tables don't give the digest in its header")
        return spec
