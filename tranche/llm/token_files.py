"""Token ids in files of independent zstandard frames, with a seek table at the end.

A file is in zstandard's public seekable form: frames of a fixed number of ids
(little-endian, the narrowest type that holds the vocabulary), then a skippable
frame with the documents' ids and positions, then the seek table: sizes of every
frame, compressed and not, and the low 32 bits of the XXH64 of its content.  A
reader of some documents reads the tail, then decompresses only the frames that
hold them, and checks each against its checksum.

Documents are range-partitioned and sorted by id, one file a partition.  Files
get a name of their own for every attempt, and only files named by finished
tasks enter the manifest, so a lost executor leaves at most an unread file.

Defined cases: a null text is empty, so its ids are the end id alone; null ids
come first; repeated rows are written each, in input order; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tranche.llm import common as C
from tranche.llm.tokens import Encoder, vocabulary_path

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_MAGIC = 0x184D2A50


@dataclass(frozen=True)
class Settings:
    end_id: int = 0
    frame_ids: int = 1 << 17
    level: int = 1
    batch: int = 1024            # texts encoded at once


class FrameError(ValueError):
    """A frame's content differs from its checksum, or a file's tail is no seek table."""


def open_place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI as Spark names it (file:, hdfs:, s3: and others Arrow knows)."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class Writer:
    """Writes one file; memory is one frame and three numbers a document."""

    def __init__(self, out, kind: np.dtype, s: Settings):
        self.out, self.kind, self.s = out, kind, s
        self.zip = zstandard.ZstdCompressor(level=s.level)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list = []
        self.lengths: list[int] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        while self.n_held >= self.s.frame_ids:
            self._frame(self.s.frame_ids)

    def _frame(self, n: int) -> None:
        whole = np.concatenate(self.held) if len(self.held) > 1 else self.held[0]
        self.held, self.n_held = [whole[n:]], len(whole) - n
        raw = np.ascontiguousarray(whole[:n], self.kind).tobytes()
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.n_held:
            self._frame(self.n_held)
        known = np.array([i is not None for i in self.ids], np.uint8)
        index = zstandard.ZstdCompressor(level=3).compress(
            struct.pack("<QI", len(self.ids), self.kind.itemsize) + known.tobytes()
            + np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 8) + index + struct.pack("<Q", len(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + 9) + table
                       + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class Reader:
    """Reads one file by its seek table; holds one frame at a time."""

    def __init__(self, file, size: int):
        self.file = file
        self.unzip = zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9)) if size >= 17 else (0, 0, 0)
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise FrameError("no seek table")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.places = np.cumsum([0, *self.sizes])
        self.raw_starts = np.cumsum([0, *self.raw_sizes])
        end = size - 9 - 12 * n - 8
        (length,) = struct.unpack("<Q", self._at(end - 8, 8))
        index = self.unzip.decompress(self._at(end - 8 - length, length))
        n_docs, width = struct.unpack_from("<QI", index)
        self.kind = np.dtype(f"<u{width}")
        known = np.frombuffer(index, np.uint8, n_docs, 12)
        ids = np.frombuffer(index, "<i8", n_docs, 12 + n_docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.lengths = np.frombuffer(index, "<i8", n_docs, 12 + 9 * n_docs)
        self.starts = np.cumsum([0, *self.lengths])
        self.frame = (-1, b"")
        self.frames_read = 0

    def _at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def _frame(self, k: int) -> bytes:
        if self.frame[0] != k:
            raw = self.unzip.decompress(self._at(int(self.places[k]), int(self.sizes[k])), max_output_size=int(self.raw_sizes[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise FrameError(f"frame {k}: wrong checksum")
            self.frame = (k, raw)
            self.frames_read += 1
        return self.frame[1]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document; decompresses only the frames that hold them."""
        at, end = int(self.starts[k]) * self.kind.itemsize, int(self.starts[k + 1]) * self.kind.itemsize
        out = []
        frame = int(np.searchsorted(self.raw_starts, at, "right")) - 1
        while at < end:
            upto = min(end, int(self.raw_starts[frame + 1]))
            out.append(self._frame(frame)[at - int(self.raw_starts[frame]):upto - int(self.raw_starts[frame])])
            at, frame = upto, frame + 1
        return np.frombuffer(b"".join(out), self.kind)


def write_tokens(documents: DataFrame, folder: str, vocabulary: str | None = None, s: Settings = Settings()) -> DataFrame:
    """Write the documents (doc_id, text) to files in ``folder``; the stored manifest (file, part, docs, ids).

    ``part`` numbers the files in order of doc_id.
    """
    spark = documents.sparkSession
    C.ship(spark)
    path = vocabulary or vocabulary_path()
    fs, place = open_place(folder)
    fs.create_dir(place, recursive=True)

    def run(batches):
        encoder = Encoder.open(path)
        end = np.array([s.end_id], encoder.kind)
        part, name = TaskContext.get().partitionId(), ""
        out = writer = None
        n_ids = 0
        for batch in batches:
            if writer is None and batch.num_rows:
                store, root = open_place(folder)
                name = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = Writer(out, encoder.kind, s)
            for some in C.slices(batch, s.batch):
                for doc_id, got in zip(some.column("doc_id").cast("int64").to_pylist(), encoder(C.texts(some))):
                    writer.add(doc_id, np.concatenate([got, end]))
                    n_ids += len(got) + 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([len(writer.ids)], pa.int64()),
                                              pa.array([n_ids], pa.int64())], names=["file", "part", "docs", "ids"])

    ordered = (documents.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
               .repartitionByRange("doc_id", "__row").sortWithinPartitions("doc_id", "__row").select("doc_id", "text"))
    return C.stored(ordered.mapInArrow(run, "file string, part int, docs long, ids long"), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a bad checksum raises FrameError.

    The driver sees one line for each file, to know where its ids begin.
    """
    C.ship(spark)
    files, before = [], 0
    for r in manifest.orderBy("part").collect():
        files.append((r["file"], before))
        before += r["ids"]

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                store, root = open_place(folder)
                full = f"{root}/{name}"
                with store.open_input_file(full) as f:
                    reader = Reader(f, store.get_file_info(full).size)
                    for i in range(0, len(reader.doc_ids), 10_000):
                        some = range(i, min(i + 10_000, len(reader.doc_ids)))
                        sums = [zlib.crc32(reader.ids(k).astype("<u4")) for k in some]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.doc_ids[i:some.stop], pa.int64()), pa.array(base + reader.starts[i:some.stop]),
                             pa.array(reader.lengths[i:some.stop]), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (spark.createDataFrame(files, "file string, base long").repartition(max(1, len(files)), "file")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
