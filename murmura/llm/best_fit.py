"""Bounded-space online best-fit packing of tokenised documents into sequences of fixed capacity.

Each task packs its own rows as they come; the few sequences that a task leaves open are then merged with the others'."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices, small_batches, texts_of
from .word_tokens import chunk_tokenizer

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """At most ``open_bins`` open sequences, found through a bitset keyed by free space.

    Bit f of ``free`` is set while an open sequence has f free places, so the tightest that takes n tokens is the
    lowest set bit from n on. When a new sequence is needed and all places for open ones are taken, the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.free, self.held, self.open = 0, {}, 0

    def _put(self, sequence: int, free: int) -> None:
        self.held.setdefault(free, []).append(sequence)
        self.free |= 1 << free

    def _take(self, free: int) -> int:
        rest = self.held[free]
        sequence = rest.pop()
        if not rest:
            del self.held[free]
            self.free &= ~(1 << free)
        return sequence

    def add(self, n: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of n tokens, 1 <= n <= capacity."""
        fits = self.free >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            sequence, free = self.next, self.capacity
            self.next += 1
            if n < self.capacity and self.open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            self.open += n < self.capacity
        if free > n:
            self._put(sequence, free - n)
        else:
            self.open -= free < self.capacity
        return sequence, self.capacity - free


#: Of what a task leaves open, sequences less full than this are packed again, about ``LOOSE`` pieces a task. Lists of at
#: most ``BROADCAST_MOVES`` pieces may be broadcast.
FULL, LOOSE, BROADCAST_MOVES = 0.97, 200_000, 500_000


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 256, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed by each task as its rows come, whatever the size or skew.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut. Null and empty texts are the end id
    alone. Rows that repeat a doc_id (or have none) are packed as documents of their own; other columns are ignored.
    What each task leaves open and under-full (at most ``open_bins`` sequences) is taken apart and packed once more with what
    the others left, the longest pieces first: so how many sequences there are hardly depends on the number of tasks. A
    sequence's number is its task's partition
    and its place there. An empty table gives no rows. with_ids adds the piece's ids (array<int>) for a writer.
    """

    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5] + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        tok, bins = chunk_tokenizer(tokenizer), BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), tok.encode(texts_of(part)), strict=True):
                    ids = np.append(ids, [end_id]).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        piece = ids[at : at + capacity]
                        row = (doc, k, at, len(piece), zlib.crc32(piece), *bins.add(len(piece)))
                        rows.append((*row, piece.tolist()) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        # rows with piece -1: what is open and under-full
        left = [(None, -1, 0, capacity - free, 0, sequence, 0, None)[: len(names)] for free, of in bins.held.items() for sequence in of if capacity - free < FULL * capacity]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*left), kinds)], names)

    placed = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids), "packed")
    pieces, loose = placed.where("piece >= 0"), placed.where("piece = -1").select(F.col("sequence_id").alias("__open"))
    some = F.broadcast(loose) if loose.count() <= BROADCAST_MOVES else loose
    again = save(pieces.join(some, F.col("sequence_id") == F.col("__open"), "left_semi").select("sequence_id", "offset", "length"), "loose")
    count = again.count()
    moves = save(_again(again, capacity, max(1, -(-count // LOOSE))), "moves")
    found = F.broadcast(moves) if count <= BROADCAST_MOVES else moves
    out = pieces.join(found, (F.col("sequence_id") == F.col("__from")) & (F.col("offset") == F.col("__at")), "left")
    return out.withColumns({"sequence_id": F.coalesce("__to", "sequence_id"), "offset": F.coalesce("__by", "offset")}).select(*names)


def _again(pieces: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """(__from, __at, __to, __by): pieces named by sequence and offset, the longest first, each put into the fullest new
    sequence that takes it."""

    def run(batches):
        bins = BestFit(capacity, 1 << 40, 1 << 62 | TaskContext.get().partitionId() << 40)
        for batch in batches:
            out = [(*row[:2], *bins.add(row[2])) for row in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["__from", "__at", "__to", "__by"])

    dealt = pieces.repartition(tasks, "sequence_id", "offset").sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    return dealt.mapInArrow(run, "__from long, __at long, __to long, __by long")
