"""Token-id files of independent zstandard frames with a seek table.

A file is: frames of token ids (little-endian, two bytes each while the
vocabulary allows, else four), one or more whole documents to a frame; a
skippable frame with the index of documents; and the trailing seek table of the
public seekable format, a skippable frame with each frame's compressed and
decompressed size and checksum (the low half of XXH64 of its content).  A reader
takes the end of a file, then decompresses the frames of the documents wanted,
and no others; any zstandard tool can decompress all of it.

A document never spans frames, so a very long one has a frame of its own.  Files
are made by the tasks as they read, of about ``file_tokens`` ids; there is no
shuffle, and a task that runs again makes the same files.

A null text reads back as None, an empty one as no ids; a null doc_id is kept as
null.  Repeated rows are stored each.  An empty table gives no files.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from .common import arrow_map, documents_in
from .text import slices
from .tokens import VOCABULARY, tokenizer

SKIPPABLE_TABLE, SKIPPABLE_INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
NULL_ID, NULL_TEXT = 1, 2
_INDEX = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("start", "<u8"), ("n", "<u8"), ("flags", "u1")])


class FileWriter:
    def __init__(self, width: int = 2, frame_tokens: int = 1 << 15, level: int = 3):
        self.width, self.frame_tokens = width, frame_tokens
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.parts: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        self.size = self.tokens = self.docs = 0

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, flags: np.ndarray, bounds: np.ndarray) -> None:
        """Documents i with ``ids[bounds[i]:bounds[i+1]]``."""
        n, a = len(doc_ids), 0
        ids = ids.astype(f"<u{self.width}")
        while a < n:
            room = self.frame_tokens - self.size
            b = int(np.searchsorted(bounds, bounds[a] + room, "right")) - 1
            if b <= a:
                if self.held:
                    self.close_frame()
                    continue
                b = a + 1
            row = np.zeros(b - a, _INDEX)
            row["doc_id"], row["flags"], row["frame"] = doc_ids[a:b], flags[a:b], len(self.table)
            row["start"], row["n"] = bounds[a:b] - bounds[a] + self.size, np.diff(bounds[a : b + 1])
            self.index.append(row)
            self.held.append(ids[bounds[a] : bounds[b]])
            self.size += int(bounds[b] - bounds[a])
            if self.size >= self.frame_tokens:
                self.close_frame()
            a = b
        self.tokens += int(bounds[n] - bounds[0])
        self.docs += n

    def close_frame(self) -> None:
        raw = b"".join(x.tobytes() for x in self.held)
        frame = self.compress(raw)
        self.parts.append(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def finish(self) -> tuple[bytes, np.ndarray]:
        if self.held:
            self.close_frame()
        index = np.concatenate(self.index) if self.index else np.zeros(0, _INDEX)
        raw = index.tobytes()
        skip = struct.pack("<II", SKIPPABLE_INDEX, len(raw)) + raw
        table = [*self.table, (len(skip), 0, xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *t) for t in table) + struct.pack("<IBI", len(table), 0x80, SEEKABLE)
        return b"".join([*self.parts, skip, struct.pack("<II", SKIPPABLE_TABLE, len(body)), body]), index


class FileReader:
    """Reads documents of one file through ``read(start, length)``; ``bytes_read`` tells how much that was."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, width: int = 2):
        self._read, self.width, self.bytes_read = read, width, 0
        n, flags, magic = struct.unpack("<IBI", self.read(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        raw = self.read(size - 9 - 12 * n, 12 * n)
        self.table = np.frombuffer(raw, "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.table[:, 0]))
        skip = self.read(int(self.at[n - 1]), int(self.table[n - 1, 0]))
        if xxhash.xxh64_intdigest(skip[8:]) & 0xFFFFFFFF != self.table[n - 1, 2]:
            raise ValueError("the index is damaged")
        self.index = np.frombuffer(skip[8:], _INDEX)
        self._frame: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint16))

    @classmethod
    def of(cls, content: bytes, width: int = 2) -> FileReader:
        return cls(lambda a, n: content[a : a + n], len(content), width)

    @classmethod
    def open(cls, path: str, width: int = 2) -> FileReader:
        f = open(path, "rb")  # noqa: SIM115
        return cls(lambda a, n: (f.seek(a), f.read(n))[1], f.seek(0, 2), width)

    def read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self._read(at, n)

    def frame(self, k: int) -> np.ndarray:
        if self._frame[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.read(int(self.at[k]), int(self.table[k, 0])), max_output_size=max(1, int(self.table[k, 1])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._frame = (k, np.frombuffer(raw, f"<u{self.width}"))
        return self._frame[1]

    def document(self, i: int) -> tuple[int | None, np.ndarray | None]:
        """(doc_id, ids) of the file's document number i."""
        r = self.index[i]
        ids = None if r["flags"] & NULL_TEXT else self.frame(int(r["frame"]))[int(r["start"]) : int(r["start"] + r["n"])]
        return None if r["flags"] & NULL_ID else int(r["doc_id"]), ids

    def find(self, doc_ids: Iterable[int]):
        """The documents with these ids, in the file's order."""
        for i in np.flatnonzero(np.isin(self.index["doc_id"], list(doc_ids)) & (self.index["flags"] & NULL_ID == 0)):
            yield self.document(int(i))


def token_files(docs: DataFrame, vocabulary: str = VOCABULARY, frame_tokens: int = 1 << 15, file_tokens: int = 1 << 22, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each file: (part, number, n_docs, n_tokens, n_frames, doc_ids, content)."""

    def run(batches):
        t = tokenizer(vocabulary)
        width = 2 if t.encoding.n_vocab <= 1 << 16 else 4
        part, number = TaskContext.get().partitionId(), 0
        w = FileWriter(width, frame_tokens, level)

        def row():
            content, index = w.finish()
            ids = pa.array(index["doc_id"], mask=(index["flags"] & NULL_ID) > 0)
            return {"part": [part], "number": [number], "n_docs": [w.docs], "n_tokens": [w.tokens], "n_frames": [len(w.table)], "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "content": [content]}

        for batch in batches:
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            flags = NULL_ID * np.asarray(batch.column(0).is_null()) + NULL_TEXT * np.asarray(batch.column(1).is_null())
            for a, b, buf, off in slices(batch.column(1), 1 << 20):
                ids, bounds = t.encode(buf, off)
                w.add(ids, doc_ids[a:b], flags[a:b], bounds)
                if w.tokens >= file_tokens:
                    yield row()
                    number += 1
                    w = FileWriter(width, frame_tokens, level)
        if w.docs:
            yield row()

    return arrow_map(documents_in(docs, id_col, text_col), run, "part int, number int, n_docs long, n_tokens long, n_frames int, doc_ids array<long>, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes the files of ``token_files`` under ``folder`` (a URI that pyarrow can open, shared by the executors) and returns their index.

    Each is written beside its place and then renamed, so one left by a lost
    task is never seen.
    """

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for r in batch.to_pylist():
                path = f"{root}/part-{r['part']:06d}-{r['number']:04d}.zst"
                with system.open_output_stream(f"{path}.{attempt}") as f:
                    f.write(r["content"])
                system.move(f"{path}.{attempt}", path)
                yield {k: [v] for k, v in r.items() if k != "content"} | {"path": [path]}

    return arrow_map(files, run, "part int, number int, n_docs long, n_tokens long, n_frames int, doc_ids array<long>, path string")
