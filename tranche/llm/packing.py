"""Harmonic packing of token sequences.

Lengths fall into classes by reciprocals of the capacity C: class j holds
lengths over C/(j+1) and up to C/j, and j pieces of a class fill a sequence.
Cutting is free, so a document is cut to whole sequences, then to pieces of
exactly C/j (rounded down); only a last piece of at most C/16 stays as it is, in
the class of its length.  Every worker packs what it reads, with one open
sequence a class, and needs no shuffle; at its end it lays the pieces of its open
sequences end to end, cutting at the capacity, and the last part is written as
sequences of powers of two, which need no padding.

A sequence's id joins the number of the worker's partition and a running
number, so ids are unique and a recomputed partition gives the same ids.

Defined cases: a null text is empty and, as every document, ends with the end
id, so it has one piece; repeated rows are packed each on their own; a null id
stays null; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tranche.llm import common as C
from tranche.llm.tokens import Encoder, vocabulary_path


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    end_id: int = 1
    small: int = 16              # a rest of at most capacity / small is not cut again
    batch: int = 1024            # texts encoded at once
    keep: bool = True            # the parts remembered stay in the worker for its next task


def cuts(length: int, s: Settings) -> list[int]:
    """Lengths of a document's pieces."""
    out = [s.capacity] * (length // s.capacity)
    rest = length % s.capacity
    while rest > s.capacity // s.small:
        out.append(s.capacity // -(-s.capacity // rest))
        rest -= out[-1]
    return [*out, rest] if rest else out


class Packer:
    """Open sequences of one worker; calls give finished sequences, each a list of pieces.

    A piece is (doc_id, start, ids, doc_tokens).
    """

    def __init__(self, s: Settings):
        self.s, self.open = s, {}

    def add(self, doc_id, ids: np.ndarray):
        at = 0
        for n in cuts(len(ids), self.s):
            piece = (doc_id, at, ids[at:at + n], len(ids))
            at += n
            j = self.s.capacity // n
            pieces = self.open.setdefault(j, [])
            pieces.append(piece)
            if len(pieces) == j:
                yield self.open.pop(j)

    def close(self):
        """The rest: end to end, cut at the capacity, then at powers of two."""
        queue = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        left = sum(len(p[2]) for p in queue)
        at = 0                                  # ids of queue[0] already written
        while left:
            room = self.s.capacity if left >= self.s.capacity else 1 << (left.bit_length() - 1)
            left -= room
            sequence = []
            while room:
                d, start, ids, total = queue[0]
                n = min(room, len(ids) - at)
                sequence.append((d, start + at, ids[at:at + n], total))
                at += n
                room -= n
                if at == len(ids):
                    queue.pop(0)
                    at = 0
            yield sequence


_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(documents: DataFrame, vocabulary: str | None = None, s: Settings = Settings(), with_ids: bool = False) -> DataFrame:
    """One row per piece of the documents (doc_id, text); ``with_ids`` adds the piece's ids (array<int>).

    Rows of a sequence are written together, in order of offset.
    """
    C.ship(documents.sparkSession)
    path = vocabulary or vocabulary_path()

    def run(batches):
        encoder, packer = Encoder.open(path), Packer(s)
        number = TaskContext.get().partitionId() << 40
        end = np.array([s.end_id], encoder.kind)

        def batch_of(rows):
            ids = [np.ascontiguousarray(p[2], "<u4") for p, _, _ in rows]
            columns = [pa.array([p[0] for p, _, _ in rows], pa.int64()), pa.array([p[1] for p, _, _ in rows], pa.int64()),
                       pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                       pa.array([p[3] for p, _, _ in rows], pa.int64()), pa.array([q for _, q, _ in rows], pa.int64()),
                       pa.array([o for _, _, o in rows], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        def sequences():
            for batch in batches:
                for some in C.slices(batch, s.batch):
                    for doc_id, ids in zip(some.column("doc_id").cast("int64").to_pylist(), encoder(C.texts(some))):
                        yield from packer.add(doc_id, np.concatenate([ids, end]))
            yield from packer.close()

        rows = []
        for sequence in sequences():
            offset = 0
            for piece in sequence:
                rows.append((piece, number, offset))
                offset += len(piece[2])
            number += 1
            if len(rows) >= 2000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)
        if not s.keep:
            Encoder.forget(path)

    return documents.select("doc_id", "text").mapInArrow(C.tidy(run), _SCHEMA + ", ids array<int>" * with_ids)
