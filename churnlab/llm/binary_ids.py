"""6. Token ids in binary files: independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each with the little-endian unsigned 32-bit ids
of some consecutive documents; then a skippable frame with the documents' ids and
lengths; then the seek table of the public seekable format (a skippable frame with
each frame's compressed and decompressed size and the low half of the XXH64 of its
content).  Frames also carry zstandard's own checksum.  A reader of one document
reads the tail of a file and decompresses one frame.

Documents are dealt to files by range of ``doc_id``, ascending within and across
files.  A task names its files anew on each attempt and the manifest lists those of
the attempts that succeeded, so a lost executor leaves no half-written document.

Null texts are empty, and have the end id only.  Rows with a null ``doc_id`` come
first, repeated ids stay rows of their own (by text).  An empty table gives a manifest without
rows.  Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.llm.common import shared_folder, table, written
from churnlab.llm.pieces import piece_ids

# Magic numbers of the public formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
#: a null doc_id in a file
NO_ID = -(2**63)
MANIFEST = "part int, file_no int, path string, n_docs long, n_ids long, first_id long, last_id long"


class FileWriter:
    """Writes documents in order to one file."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held_bytes + len(ids) > self.frame_bytes:
            self.flush()
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids) // 4, len(self.frames)))
        self.held.append(ids)
        self.held_bytes += len(ids)

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zstd.compress(np.array(self.docs, "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        body = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)


@dataclass
class FileReader:
    """Reads documents of one file; ``source`` has seek, read and size."""

    source: pa.NativeFile

    def __post_init__(self) -> None:
        size = self.source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table_at = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(table_at + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        at = int(self.begin[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        if kind != SKIPPABLE_INDEX or at + 8 + length != table_at:
            raise ValueError("no document index before the seek table")
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._at(at + 8, length)), "<i8").reshape(-1, 3)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[i]), int(self.frames[i, 0])))
        if len(raw) != self.frames[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int, int, bytes]]:
        """(doc_id, place in the file, ids before it in the file, ids); decompresses
        only frames that hold wanted documents (None: all)."""
        keep = np.ones(len(self.docs), bool) if wanted is None else np.isin(self.docs[:, 0], list(wanted))
        before = np.concatenate([[0], np.cumsum(self.docs[:, 1])])
        frame_first: dict[int, int] = {}
        for i, f in enumerate(self.docs[:, 2].tolist()):
            frame_first.setdefault(f, i)
        held, raw = -1, b""
        for i in np.flatnonzero(keep).tolist():
            doc_id, n, f = self.docs[i].tolist()
            if f != held:
                held, raw = f, self.frame(f)
            at = 4 * int(before[i] - before[frame_first[f]])
            yield doc_id, i, int(before[i]), raw[at : at + 4 * n]


def opened(path: str, write: bool = False):
    where, local = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    if write:
        where.create_dir(local.rpartition("/")[0], recursive=True)
        return where.open_output_stream(local)
    return where.open_input_file(local)


def write_ids(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int, frame_bytes: int = 1 << 18, file_ids: int = 1 << 25, level: int = 3) -> DataFrame:
    """Writes all documents below ``folder`` and returns the manifest, one row a file."""

    def write(batches):
        from pyspark import TaskContext

        part, encoder, end = TaskContext.get().partitionId(), piece_ids(tokenizer_file), struct.pack("<I", end_id)
        attempt, files, rows, out, ids = uuid.uuid4().hex, 0, [], None, 0

        def closed():
            w.close()
            out.close()
            rows.append((part, files, path, len(w.docs), ids, w.docs[0][0], w.docs[-1][0]))

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(doc_ids), 500):
                for doc_id, body in zip(doc_ids[i : i + 500], encoder.encode(texts[i : i + 500].to_pylist())):
                    if out is None:
                        path = f"{folder}/{part:06d}-{files:04d}-{attempt}.ids"
                        out, ids = opened(path, write=True), 0
                        w = FileWriter(out, frame_bytes, level)
                    w.add(doc_id, body + end)
                    ids += len(body) // 4 + 1
                    if ids >= file_ids:
                        closed()
                        out, files = None, files + 1
        if out is not None:
            closed()
        names = ["part", "file_no", "path", "n_docs", "n_ids", "first_id", "last_id"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(write, MANIFEST))


def read_ids(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path, place) from the files of a manifest;
    start counts the ids of all documents before in all files.  With ``wanted``, only
    files whose range holds one are opened and only frames with one decompressed."""
    # one row a file: the sum over them is small
    order = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    if wanted is not None:
        hit = F.lit(False)
        for w in wanted:
            hit = hit | F.lit(w).between(F.col("first_id"), F.col("last_id"))
        files = files.filter(hit)

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with opened(path) as source:
                    rows = [(None if d == NO_ID else d, base + before, len(ids) // 4, zlib.crc32(ids), place) for d, place, before, ids in FileReader(source).read(wanted)]
                for i in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[i : i + 10_000]))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([path] * len(cols[0]))], names=["doc_id", "start", "n_tokens", "ids_crc32", "place", "path"])

    dealt = files.select("path", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, place long, path string")


def op6_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, tokenizer_file = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return read_ids(write_ids(docs, tokenizer_file, shared_folder(spark), end_id=2))
