"""Packing documents into training sequences by harmonic classes.

Class k holds pieces of exactly capacity // k tokens, k of them per sequence. A document is cut greedily:
whole sequences first (class 1), then always the largest class that fits what is left. Each step leaves
about r * r / capacity of r tokens, so a document has a handful of pieces. Every task keeps one open
sequence per class and fills it by counting alone; tasks know nothing of each other and no row moves.

When a task ends, what is in its open sequences (less than one sequence per class) is run together into
full sequences, and the last few tokens into sequences whose length is a power of two, which need no
padding. Padding is therefore capacity mod k in a sequence of class k, and nothing elsewhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import strings, text_of
from reviewlens.llm.tokens import vocabulary

WIDTH = 4  # bytes of one id
# Sequence numbers are task number * TASK + count within the task.
TASK = 1 << 36


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(class, tokens) of a document of ``length`` ids, in order."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = -(-capacity // (rest + 1))  # smallest k with capacity // k <= rest
        while capacity // k > rest:
            k += 1
        out.append((k, capacity // k))
        rest -= capacity // k
    return out


class Packer:
    """The open sequences of one task."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open, self.rows = capacity, first, {}, []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // WIDTH
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, ids))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // WIDTH, 0
        for k, n in pieces_of(total, self.capacity):
            piece = (doc, at, ids[at * WIDTH : (at + n) * WIDTH], total)
            at += n
            if k == 1:
                self.close([piece])
                continue
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        """Close what is open: full sequences, then powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        tokens = sum(len(p[2]) for p in left) // WIDTH
        room, held = self.size(tokens), []
        for doc, start, ids, total in left:
            while ids:
                cut = ids[: room * WIDTH]
                held.append((doc, start, cut, total))
                n = len(cut) // WIDTH
                ids, start, room, tokens = ids[n * WIDTH :], start + n, room - n, tokens - n
                if not room:
                    self.close(held)
                    room, held = self.size(tokens), []

    def size(self, tokens: int) -> int:
        return self.capacity if tokens >= self.capacity else 1 << max(tokens.bit_length() - 1, 0)


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with
    ``keep_ids`` also the piece's ids, as little-endian 32-bit numbers.

    A document is its ids and then ``end_id``; null or empty text is ``end_id`` alone. Repeated rows are
    packed each. ``capacity`` must be a power of two. Documents of any length are cut, never dropped. An
    empty table gives no rows. No shuffle.
    """
    few = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = dict(few.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * keep_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 8 if keep_ids else 7]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, "ids")
        end = end_id.to_bytes(WIDTH, "little")
        packer = Packer(capacity, TaskContext.get().partitionId() * TASK)

        def raw(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def ids_of(word: str) -> bytes:
            return raw([i for p in v.pre_tokens(word) for i in v.merged(p)])

        id_type = None

        def drained() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [id_type, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)][: len(names)], names)

        for batch in batches:
            id_type = batch["doc_id"].type
            for doc, t in zip(batch["doc_id"].to_pylist(), strings(batch["text"]), strict=True):
                found = v.look_up(t, ids_of)
                ids = raw(v.encode(t)) if found is None else b"".join(found)
                packer.add(doc, ids + end)
            yield drained()
        packer.finish()
        if packer.rows:
            yield drained()

    return few.mapInArrow(run, schema)
