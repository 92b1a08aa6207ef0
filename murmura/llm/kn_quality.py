"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Order 5 with four start marks and an end mark a document, so every position has a full 5-gram; the counts of lower orders
are continuation counts, as the method has it. The model is a table of distinct 5-grams with counts and is sharded by the
two bytes before the predicted one: all higher orders of a 5-gram, their contexts included, lie in its shard, and the two
lowest orders are a table of 256 x 256 probabilities, sent everywhere.

Scoring is a join of counts: documents are written as (compressed) blocks, each block asks the shards for its distinct
5-grams, the shards answer with log probabilities, and the answers meet the block's texts again. So what travels is the
texts once and a block's distinct 5-grams, not one row a position. A shard that is asked for much is dealt over copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import quantiles
from .common import drop, make_room, near_ids, save, shared, slices, small_batches

ORDER = 5
START, END = b"\x02" * (ORDER - 1), b"\x03"
#: Control bytes, the marks among them, read as spaces.
_CLEAN = bytes(0x20 if b < 0x20 or b == 0x7F else b for b in range(256))
BLOCK_BYTES = 8 << 20
#: Bytes of a text that is long enough to set limits by (where a language has any such).
LONG = 200
#: 5-grams of the model that a task holds on average (a shard is at least one two-byte context, whose 5-grams are at most
#: 2 ** 24 whatever the corpus), and 5-grams asked for that one task is to hold.
SHARD_GRAMS, SHARD_ASKED = 250_000, 3_000_000
#: About so many distinct 5-grams are in a block.
BLOCK_GRAMS = 150_000
#: 5-grams that a worker makes or scores in one go, and bytes of texts.
AT_ONCE, TEXT_BYTES = 1 << 18, 1 << 19


def canonical(text: str | None) -> bytes:
    """UTF-8 with runs of white space as one space."""
    return b" ".join((text or "").encode().translate(_CLEAN).split())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(5-grams of all texts in order as integers, how many each text has: its bytes and the end)."""
    raw = np.frombuffer(START + (END + START).join(texts) + END, np.uint8)
    packed = np.zeros(len(raw) - ORDER + 1, np.int64)
    for i in range(0, len(packed), AT_ONCE):
        part = packed[i : i + AT_ONCE]
        for k in range(ORDER):
            part <<= 8
            part |= raw[i + k : i + k + len(part)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return packed[raw[ORDER - 1 :] != START[0]], sizes


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, np.concatenate([p[1] for p in parts]), len(unique)).astype(np.int64)


def count_grams(trusted: DataFrame, hold: int = 2_000_000) -> DataFrame:
    """(gram, c) over all texts; each task adds up its own before the shuffle, at most about ``hold`` at a time."""

    def rows(parts):
        keys, counts = _merge(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "c"])

    small_batches(trusted.sparkSession)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                got = np.unique(grams([canonical(t) for t in part.column(0).to_pylist()])[0], return_counts=True)
                parts.append(got)
                held += len(got[0])
                if held > hold:
                    parts = [_merge(parts)]
                    held = len(parts[0][0])
                    if held > hold // 2:
                        yield rows(parts)
                        parts, held = [], 0
        if parts:
            yield rows(parts)

    return trusted.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of grams counted once to four times; plain values where those are missing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    # kept off 0 (no mass would be left for what is new) and off k
    return [min(max(d, 0.1), k - 0.1) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


class Counts:
    """Probabilities at one order: (key -> count) sorted by key, a key's context being key >> 8."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: list[float]):
        self.keys, self.counts, self.cut = keys, counts, np.array([0.0, *discount])
        self.contexts, first = np.unique(keys >> 8, return_index=True)
        if len(keys):
            self.total = np.add.reduceat(counts, first).astype(np.float64)
            taken = self.cut[np.minimum(counts, 3)]
            self.free = np.add.reduceat(taken, first) / self.total

    def apply(self, asked: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(byte | context) for asked keys, given the lower order's; the lower order's itself in an unseen context."""
        if not len(self.keys):
            return lower
        at = np.minimum(np.searchsorted(self.contexts, asked >> 8), len(self.contexts) - 1)
        known = self.contexts[at] == asked >> 8
        where = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        count = np.where(self.keys[where] == asked, self.counts[where], 0)
        own = (count - self.cut[np.minimum(count, 3)]) / self.total[at]
        return np.where(known, own + self.free[at] * lower, lower)


def lowest(pairs: list[tuple[int, int]]) -> np.ndarray:
    """P(b | a) for all 65,536 pairs from the pairs' continuation counts: orders 2 and 1 over a uniform byte."""
    keys = np.array([p[0] for p in pairs], np.int64)
    counts = np.array([p[1] for p in pairs], np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    single, ones = np.unique(keys & 0xFF, return_counts=True)
    coc = lambda c: [int((c == k).sum()) for k in range(1, 5)]
    base = Counts(single, ones, discounts(coc(ones))).apply(np.arange(256), np.full(256, 1 / 256))
    asked = np.arange(1 << 16)
    return Counts(keys, counts, discounts(coc(counts))).apply(asked, base[asked & 0xFF])


def shard_scores(model_keys: np.ndarray, model_counts: np.ndarray, asked: np.ndarray, cuts: dict[int, list[float]], low: np.ndarray) -> np.ndarray:
    """log P of the asked 5-grams from a shard's part of the model."""
    order = np.argsort(model_keys)
    keys = {5: (model_keys[order], model_counts[order])}
    for n in (4, 3):
        keys[n] = np.unique(keys[n + 1][0] & ((1 << 8 * n) - 1), return_counts=True)
    orders = [(n, Counts(*keys[n], cuts[n])) for n in (3, 4, 5)]
    out = np.empty(len(asked))
    for i in range(0, len(asked), AT_ONCE):
        some = asked[i : i + AT_ONCE]
        p = low[some & 0xFFFF]
        for n, counts in orders:
            p = counts.apply(some & ((1 << 8 * n) - 1), p)
        out[i : i + AT_ONCE] = np.log(p)
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, langs, z): rows of about BLOCK_BYTES of canonical text, compressed together; a saved table, so that
    whatever is made of a block later is made of the same rows."""

    def run(batches):
        make_room("quality")
        place, k = TaskContext.get().partitionId() << 32, 0
        rows, size = [], 0

        def row():
            nonlocal rows, size, k
            z = pa.Codec("zstd", 7).compress(b"\x01".join(r[2] for r in rows), asbytes=True)
            sizes = sum(len(r[2]) for r in rows) + len(rows) - 1
            out = pa.RecordBatch.from_arrays([pa.array([place + k]), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.string())), pa.array([sizes]), pa.array([z], pa.binary())], ["block", "ids", "langs", "size", "z"])
            rows, size, k = [], 0, k + 1
            return out

        for batch in batches:
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = canonical(text)
                if rows and size + len(text) > BLOCK_BYTES:
                    yield row()
                rows.append((doc, lang, text))
                size += len(text)
        if rows:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return save(rows.mapInArrow(run, "block long, ids array<long>, langs array<string>, size long, z binary"), "blocks")


def _runs(texts: list[bytes]):
    """Places [i, j) of runs of texts of about TEXT_BYTES."""
    i = size = 0
    for j, text in enumerate(texts):
        if j > i and size + len(text) > TEXT_BYTES:
            yield i, j
            i, size = j, 0
        size += len(text)
    if i < len(texts):
        yield i, len(texts)


def asked_of(texts: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct 5-grams by shard, ascending in each, and their shards."""
    asked = np.unique(np.concatenate([np.unique(grams(texts[i:j])[0]) for i, j in _runs(texts)]))
    of = ((asked >> 8) & 0xFFFF) * 2654435761 % 4294967296 % shards
    order = np.argsort(of, kind="stable")
    return asked[order], of[order]


def squeeze(keys: np.ndarray) -> bytes:
    """Ascending 5-grams, byte plane by byte plane: of the upper ones most bytes are as the one before."""
    planes = keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :ORDER].T
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unsqueeze(raw: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :ORDER] = np.frombuffer(pa.Codec("zstd").decompress(raw, count * ORDER, asbytes=True), np.uint8).reshape(ORDER, count).T
    return out.view("<i8").ravel().astype(np.int64, copy=False)


def _unpack(z: bytes, size: int) -> list[bytes]:
    return pa.Codec("zstd").decompress(z, size, asbytes=True).split(b"\x01")


def perplexity(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity a byte) of each row's whole text under the saved counts (gram, c)."""
    spark = docs.sparkSession
    coc = lambda df: list(df.agg(*(F.count(F.when(F.col("c") == k, 1)) for k in range(1, 5))).first())
    four = counts.groupBy(F.col("gram").bitwiseAND(0xFFFFFFFF).alias("gram")).agg(F.count("*").alias("c"))
    three = four.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.count("*").alias("c"))
    two = three.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.count("*").alias("c"))
    cuts = {5: discounts(coc(counts)), 4: discounts(coc(four)), 3: discounts(coc(three))}
    low = lowest([(r["gram"], r["c"]) for r in two.collect()])  # at most 65,536 rows
    model = shared(spark, "kn", (cuts, low))

    size = counts.count()
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-size // SHARD_GRAMS))
    shards = min(shards, 1 << 16)

    small_batches(spark)

    payload = blocks(docs)
    total = payload.agg(F.sum("size")).first()[0] or 0
    shard = F.expr(f"((shiftright(gram, 8) & 65535) * 2654435761) % 4294967296 % {shards}")
    # how often a shard is asked is as its part of the model: one number a shard
    per_block = np.zeros(shards)
    for r in counts.groupBy(shard.alias("shard")).count().collect():
        per_block[r["shard"]] = BLOCK_GRAMS * r["count"] / size
    copies = np.maximum(1, np.ceil(per_block * (total / BLOCK_BYTES) / SHARD_ASKED)).astype(np.int64)
    box = shared(spark, "copies", copies)

    def ask(batches):
        make_room("quality")
        for batch in batches:
            for name, size, z in zip(*(batch.column(i).to_pylist() for i in range(3))):
                asked, of = asked_of(_unpack(z, size), shards)
                cut = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(of)]
                out = [(int(of[a]), (name + (name >> 32)) % int(box.value[of[a]]), name, b - a, squeeze(asked[a:b])) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int64()] * 4 + [pa.binary()])], ["shard", "copy", "block", "n", "asked"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        cuts, low = model.value
        lists = [unsqueeze(x, n) for x, n in zip(right["asked"].to_pylist(), right["n"].to_pylist())]
        distinct = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)
        scored = shard_scores(left["gram"].to_numpy(), left["c"].to_numpy(), distinct, cuts, low).astype(np.float32)
        out = [scored[np.searchsorted(distinct, x)].tobytes() for x in lists]
        return pa.table({"block": right["block"], "shard": right["shard"], "logs": pa.array(out, pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows:
            # the answers by shard are in the order in which the block asks
            rows = sorted(zip(right["shard"].to_pylist(), right["logs"].to_pylist()))
            logs = np.concatenate([np.frombuffer(x, np.float32) for _, x in rows]).astype(np.float64)
            for ids, langs, size, z in zip(*(left[c].to_pylist() for c in ("ids", "langs", "size", "z"))):
                data = _unpack(z, size)
                asked, _ = asked_of(data, shards)
                order = np.argsort(asked)
                keys, logs = asked[order], logs[order]
                for i, j in _runs(data):
                    got, sizes = grams(data[i:j])
                    total = np.add.reduceat(logs[np.searchsorted(keys, got)], np.cumsum(sizes) - sizes)
                    out[2] += (sizes - 1).tolist()
                    out[3] += np.exp(-total / sizes).tolist()
                out[0] += ids
                out[1] += langs
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "lang", "n_bytes", "perplexity"), out, (pa.int64(), pa.string(), pa.int64(), pa.float64()))})

    asks = payload.select("block", "size", "z").mapInArrow(ask, "shard long, copy long, block long, n long, asked binary")
    dealt = spark.createDataFrame([(k, int(n)) for k, n in enumerate(copies) if n > 1], "shard long, copies long")  # at most 65,536 rows
    placed = counts.withColumn("shard", shard).join(F.broadcast(dealt), "shard", "left")
    placed = placed.select("gram", "c", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)).alias("copy"))
    answers = placed.groupBy("shard", "copy").cogroup(asks.groupBy("shard", "copy")).applyInArrow(answer, "block long, shard long, logs binary")
    return payload.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, lang string, n_bytes long, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents labelled as good; a document with both labels isn't trusted."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    return good.where("q = 1").select("doc_id")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, evidence: float = 15.0) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, accepted) for each row of docs (doc_id, lang, text).

    Trained on the full texts of the documents that labels (doc_id, quality) call good, but for a fifth of them, by a hash of
    their ids; on those, which the model hasn't seen, the limits are set. A document is accepted if its perplexity is at
    most the ``quantile`` of that fifth in its language (exact, so the same in every run), or its whole text is less than
    ``evidence`` nats beyond that: odds of three million to one, as a few words prove nothing; languages without any take the quantile over all (null
    languages are one language). Null and empty texts are accepted, having nothing to judge
    (their perplexity is that of the bare end mark). Without trusted text everything is accepted. Repeated doc_ids are
    judged row by row; a null doc_id is scored as any. An empty table gives no rows.
    """
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    ids = save(trusted_ids(labels).withColumn("unseen", unseen), "trusted")
    trusted = near_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids.where("NOT unseen"), "doc_id", "left_semi")
    counts = save(count_grams(trusted), "kn-counts")
    if counts.isEmpty():
        drop(ids, counts)
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("accepted"))
    scores = save(perplexity(docs, counts), "perplexity")
    good = save(near_ids(scores.where("n_bytes > 0"), ids.where("unseen"), "doc_id", "left_semi").select("lang", "n_bytes", "perplexity"), "limits")
    # short texts scatter, ``evidence`` is for them: limits come from long ones, where a language has any
    far = good.withColumn("long", F.when(F.col("n_bytes") >= LONG, F.col("perplexity")))
    first = lambda by: [quantiles(far, by, c, [quantile]).select(*by, F.col("value").alias(c)) for c in ("long", "perplexity")]
    long, short = first(["lang"])
    limits = short.select(F.col("lang").alias("__lang"), F.col("perplexity").alias("__short")).join(long.select(F.col("lang").alias("__of"), "long"), F.col("__lang").eqNullSafe(F.col("__of")), "left")
    limits = save(limits.select("__lang", F.coalesce("long", "__short").alias("own")), "language-limits")
    every = [q.first() for q in first([])]
    overall = next((r[0] for r in every if r), float("inf"))
    out = scores.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("threshold", F.coalesce("own", F.lit(overall)))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", ((F.col("n_bytes") == 0) | (F.col("perplexity") <= F.col("threshold")) | ((F.col("n_bytes") + 1) * F.log(F.col("perplexity") / F.col("threshold")) <= evidence)).alias("accepted"))
