"""Token-id files: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints.

A file is a run of block records in doc_id order, kept in a Parquet container so that every store Spark writes to will
do. A block's record: ``body`` = magic, counts, the documents' ids and lengths, checkpoint bit offsets, then the code
bits (most significant first, 32-bit big-endian words), with a crc32 of all that. Documents without an id come first, and
a block says how many it has. The code lengths of all symbols are
one record of the ``codebook`` beside the blocks. A block needs the code book and nothing else to be decoded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, make_room, new_path, save, shared, slices, small_batches, texts_of
from .word_tokens import chunk_tokenizer

MAGIC = 0x48554631
CHECKPOINT = 64
BLOCK_TOKENS = 1 << 18
#: Symbols encoded at once, a multiple of ``CHECKPOINT``.
PIECE = 1 << 14
BLOCKS = "part int, block long, first_doc long, before long, n_tokens long, body binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Package-merge (at most 26 bits): optimal lengths of at most ``limit`` bits for the symbols with a count; 0 for the others."""
    used = np.flatnonzero(counts)
    if limit > 26:
        raise ValueError("at most 26 bits")
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    n, levels, packs = len(leaf), [], np.empty(0, np.int64)
    for _ in range(limit):
        weights = np.concatenate([leaf, packs])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank)
        weights = weights[rank]
        even = len(weights) // 2 * 2
        packs = weights[0:even:2] + weights[1:even:2]
    # the first 2n - 2 items of the last level are chosen; each chosen package chooses its two items one level earlier
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for rank in reversed(levels):
        chosen = rank[:take]
        out[chosen[chosen < n]] += 1
        take = 2 * int((chosen >= n).sum())
    lengths[order] = out
    return lengths


class Code:
    """Canonical codes (by length, then symbol) and the one-step decoding table over ``limit`` bits."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.width = int(lengths.max(initial=1))
        self.symbols = np.flatnonzero(lengths)
        self.symbols = self.symbols[np.lexsort((self.symbols, lengths[self.symbols]))]
        size = lengths[self.symbols].astype(np.int64)
        span = np.int64(1) << (self.width - size)
        start = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.symbols] = (start >> (self.width - size)).astype(np.uint64)
        #: code * 64 + length, so that a symbol's is one look-up
        self._both = (self.codes << np.uint64(6) | lengths.astype(np.uint64)).astype(np.uint32)
        self._start, self._span = start, span
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """For each window of ``width`` bits: symbol * 64 + length of its code."""
        if self._table is None:
            self._table = np.zeros(1 << self.width, np.int32)
            filled = np.repeat(self.symbols.astype(np.int64) * 64 + self.lengths[self.symbols], self._span)
            self._table[: len(filled)] = filled
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit words, bit offset of every ``CHECKPOINT``-th symbol)."""
        # in pieces that stay in the processor's cache and that the allocator doesn't take from the system each time
        words, marks, bits = np.zeros(len(ids) * self.width // 32 + 3, np.uint64), [np.empty(0, "<u4")], 0
        for i in range(0, len(ids), PIECE):
            both = self._both[ids[i : i + PIECE]]
            size = (both & np.uint32(63)).astype(np.int64)
            end = np.cumsum(size)
            end += bits
            at = end - size
            word = at >> 5
            wide = (both >> np.uint32(6)).astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
            marks.append(at[::CHECKPOINT].astype("<u4"))
            bits = int(end[-1])
        return words[: bits // 32 + 3].astype(">u4"), np.concatenate(marks)

    def decode(self, words: np.ndarray, marks: np.ndarray, count: int) -> np.ndarray:
        """All lanes between checkpoints advance together, one symbol a step."""
        words = np.concatenate([words.astype(np.uint64), np.zeros(2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at, out = marks.astype(np.int64), np.zeros((len(marks), CHECKPOINT), np.int32)
        last = count - (len(marks) - 1) * CHECKPOINT
        shift = 64 - self.width
        table = self.table
        for step in range(min(CHECKPOINT, count)):
            if step == last:
                at = at[:-1]
            got = table[((pairs[at >> 5] << (at & 31).astype(np.uint64)) >> np.uint64(shift)).astype(np.int64)]
            out[: len(at), step] = got >> 6
            at = at + (got & 63)
        return out.reshape(-1)[:count]


def write_block(code: Code, docs: list[int | None], ids: list[np.ndarray]) -> bytes:
    """``docs`` in ascending order, those without an id first."""
    flat = np.concatenate(ids)
    words, marks = code.encode(flat)
    head = np.array([MAGIC, len(docs), docs.count(None), len(flat), len(marks), len(words)], "<i8")
    body = b"".join((head.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([len(x) for x in ids], "<i8").tobytes(), marks.tobytes(), words.tobytes()))
    return body + zlib.crc32(body).to_bytes(4, "little")


def read_block(code: Code, raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, their lengths, all token ids); ValueError on a damaged block."""
    body = memoryview(raw)[:-4]
    if zlib.crc32(body) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("damaged block")
    magic, n_docs, n_null, count, n_marks, n_words = np.frombuffer(body, "<i8", 6).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = 48
    docs = [None] * n_null + np.frombuffer(body, "<i8", n_docs, at).tolist()[n_null:]
    lengths = np.frombuffer(body, "<i8", n_docs, at + 8 * n_docs)
    marks = np.frombuffer(body, "<u4", n_marks, at + 16 * n_docs)
    words = np.frombuffer(body, ">u4", n_words, at + 16 * n_docs + 4 * n_marks)
    return docs, lengths, code.decode(words, marks, count)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids): the ids of each whole text (null: empty) with the end id, as little-endian bytes; and from each
    task a row without doc_id, n = -1, whose ids are its counts of all symbols."""

    small_batches(docs.sparkSession)

    def run(batches):
        tok = chunk_tokenizer(tokenizer)
        end, step = np.array([end_id], tok.dtype).tobytes(), tok.dtype.itemsize
        total = np.zeros(max(tok.tok.get_vocab_size(), end_id + 1), np.int64)
        row = lambda doc, n, ids: pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), ids], ["doc_id", "n", "ids"])
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = tok.encode_column(texts_of(part), end)
                total += np.bincount(np.frombuffer(ids.buffers()[2], tok.dtype), minlength=len(total))
                yield row(part.column(0), np.diff(np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)) // step, ids)
        yield row(pa.array([None], pa.int64()), [-1], pa.array([total.tobytes()], pa.binary()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def count_symbols(tokens: DataFrame, vocab: int) -> np.ndarray:
    """Global counts from the tasks' rows, summed by symbol: what reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py(), np.int64)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has])], ["symbol", "c"])

    counts = np.zeros(vocab, np.int64)
    for r in tokens.where("n = -1").select("ids").mapInArrow(run, "symbol int, c long").groupBy("symbol").agg(F.sum("c").alias("c")).collect():
        counts[r["symbol"]] = r["c"]
    return counts


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, max_bits: int = 20, tokens_per_file: int = 32 << 20) -> str:
    """Write the documents' token ids in ascending doc_id order; returns the folder.

    Null texts are empty (the end id alone); rows without a doc_id come first; rows that repeat a doc_id follow each other
    in the order of their ids' hashes, so that what is written is the same however often it is done. Texts are tokenised
    once, into a table in the shared folder; counts, the order and the files are made from it. Files are ranges of
    (doc_id, hash), so that rows of one doc_id, or without, may be many files.
    """
    spark = docs.sparkSession
    tok = chunk_tokenizer(tokenizer)
    dtype, vocab = tok.dtype.str, max(tok.tok.get_vocab_size(), end_id + 1)
    tokens = save(tokenise(docs, tokenizer, end_id), "token-ids")
    counts = count_symbols(tokens, vocab)
    lengths = code_lengths(counts, max_bits)
    book = shared(spark, "codebook", lengths)

    def run(batches):
        make_room("token files")
        code, ids, names, held, k, before = Code(book.value), [], [], 0, 0, 0
        part = pa.array([TaskContext.get().partitionId()], pa.int32())

        def row():
            nonlocal ids, names, held, k, before
            out = pa.RecordBatch.from_arrays([part, pa.array([k]), pa.array([names[0]], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([write_block(code, names, ids)], pa.binary())], ["part", "block", "first_doc", "before", "n_tokens", "body"])
            ids, names, held, k, before = [], [], 0, k + 1, before + held
            return out

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_py(), dtype)
                names.append(doc)
                ids.append(x)
                held += len(x)
                if held >= BLOCK_TOKENS:
                    yield row()
        if names:
            yield row()

    path = new_path(spark, "huffman")
    files = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // tokens_per_file))
    order = ("doc_id", "hash")
    ordered = tokens.where("n >= 0").select("doc_id", "ids", F.xxhash64("ids").alias("hash")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    drop(tokens)
    return path


def read_ids(spark, path: str, checksums: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary as little-endian unsigned 32-bit): decoded from the files. With ``checksums``
    the ids' crc32 (ids_crc32 long) in their place.

    A block's start is the sum of all tokens in earlier files (``part`` numbers them in order), and of those before it in its
    file, which its row has; only one number a file goes to the driver. Any task can read any block.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    lengths = spark.read.parquet(f"{path}/codebook").first()["lengths"]
    total, base = 0, {}
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r["part"]] = total
        total += r["n"]
    book = shared(spark, "codebook", (np.frombuffer(bytes(lengths), np.uint8), base))

    name = "ids_crc32" if checksums else "ids"

    def run(batches):
        make_room("token files")
        lengths, base = book.value
        code = Code(lengths)
        for batch in batches:
            for part, before, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs, sizes, ids = read_block(code, raw.as_py())
                ends = np.cumsum(sizes)
                starts = base[part] + before + ends - sizes
                ids32 = ids.astype("<u4")
                each = [ids32[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                last = pa.array([*map(zlib.crc32, each)], pa.int64()) if checksums else pa.array(each, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes), last], ["doc_id", "start", "n_tokens", name])

    return blocks.select("part", "before", "body").mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {'long' if checksums else 'binary'}")
