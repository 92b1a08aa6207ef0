"""Near-duplicate components: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A signature has 24 chunks of 4 values of 16 bits. Two signatures that differ in at most 47 = 2 * 24 - 1 of the 96 values have, by
pigeonhole, a chunk with at most one difference; so each chunk is indexed four times, each time without one of its values
(the chunk errors allowed), and all pairs up to that distance meet under some key: that is the threshold, and no pair within
it is missed. What is left to chance is whether signatures tell similarity: at the lowest sought (0.75) they differ in more
than 47 values with probability 1e-7. Documents with equal shingle sets are one class from the start.

Pairs within a key are not written out. First each class is compared with one other, its pivot: the smallest of the key
that it shares most keys with. Then only classes that share a key but no component yet are looked at, and of their pairs
only those are compared whose full sets can reach the similarity at all. That is bounded exactly, without the sets: by
their sizes, by how many of their shingles no other such class has, and, for two with one pivot, by which of the pivot's
shingles each has (bits, from the first comparison). So a group of n near copies costs about n comparisons, also where many
of its pairs are just too far apart.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, make_room, near_ids, save, slices, small_batches, texts_of
from .shingles import MinHash, mix, shingle_sets

CHUNKS, WIDTH = 24, 4
#: Signatures are near if at most so many of their values differ: all such pairs share a key.
NEAR = 2 * CHUNKS - 1
#: Members of one key that are compared with each other at once, and how many of them a task has in all.
BLOCK, MEMBERS = 500, 4000


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sig): size of the shingle set, a 128-bit name of the set, its signature (both null if empty)."""

    small_batches(docs.sparkSession)

    def run(batches):
        make_room("shingles")
        minhash = MinHash(CHUNKS * WIDTH)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(texts_of(part))
                keys = [np.array([x.sum(dtype=np.uint64), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes() if len(x) else None for x in sets]
                sigs = [minhash(x).tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n long, key binary, sig binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, id, comp): each signature under all its chunks without one of their values."""

    def run(batches):
        rng = np.random.default_rng(11)
        salt = rng.integers(0, 1 << 63, (CHUNKS, WIDTH), dtype=np.uint64)
        shift = np.arange(WIDTH - 1, dtype=np.uint64) * np.uint64(16)
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            keys = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
            for left in range(WIDTH):
                rest = np.delete(sig, left, axis=2)
                keys[:, :, left] = mix((rest << shift).sum(axis=2, dtype=np.uint64) ^ salt[:, left])
            times = CHUNKS * WIDTH
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(np.repeat(batch.column(i).to_numpy(), times)) for i in (0, 1))], ["key", "id", "comp"])

    return classes.select("id", "comp", "sig").mapInArrow(run, "key long, id long, comp long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows named by the saved ``ids``, picked out of ``docs`` where they are."""
    return near_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id", "left_semi").select("doc_id", "text")


def confirm(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The saved (a, b) compared on their full sets: (a, b, linked, bits, beyond), a saved table.

    linked: 100 * intersection >= percent * union. bits: for each of a's shingles, in order, whether b has it; beyond: how
    many of b's a hasn't. Texts travel compressed.
    """
    ids = save(pairs.selectExpr("explode(array(a, b)) AS id").distinct(), "pair-ids")

    def squeeze(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(t.encode(), 1) for t in texts_of(batch)], pa.binary())], ["id", "z"])

    texts = save(_texts(docs, ids).mapInArrow(squeeze, "id long, z binary"), "pair-texts")

    def compare(batches):
        make_room("shingles")
        a, held = None, None
        for batch in batches:
            out = []
            for x, y, zx, zy in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if held is None or a != x:
                    a, held = x, shingle_sets([zlib.decompress(zx.as_py()).decode()])[0]
                other = shingle_sets([zlib.decompress(zy.as_py()).decode()])[0]
                has = np.isin(held, other, assume_unique=True)
                both = int(has.sum())
                out.append((x, y, 100 * both >= percent * (len(held) + len(other) - both), np.packbits(has).tobytes(), len(other) - both))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["a", "b", "linked", "bits", "beyond"])

    first, second = texts.toDF("a", "za"), texts.toDF("b", "zb")
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "za", "zb")
    found = save(joined.mapInArrow(compare, "a long, b long, linked boolean, bits binary, beyond long"), "compared")
    drop(ids, texts)
    return found


def lonely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own): how many shingles of each of the saved ``ids`` no other of them has."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(texts_of(part))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets).view(np.int64))], ["id", "shingle"])

    each = _texts(docs, ids).mapInArrow(run, "id long, shingle long")
    once = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return once.groupBy("id").agg(F.count("*").alias("own"))


def components(links: DataFrame) -> DataFrame:
    """(id, comp): each linked id with the smallest it is connected to; a saved table.

    Alternating stars: every node's larger neighbours are hung under its smallest one, then its smaller ones, until
    nothing moves. Only two numbers a round go to the driver; a hub's rows are split as skewed join rows are.
    """
    edges = save(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return _renamed(edges)
        seen = now
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = save(both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("explode(array(struct(u AS u, m AS v), struct(v AS u, m AS v))) AS e").select("e.*").where("u <> v").distinct()
        after = save(small, "edges")
        drop(edges, large)
        edges = after


def _renamed(edges: DataFrame) -> DataFrame:
    out = edges.toDF("id", "comp")
    out._murmura_path = edges._murmura_path
    return out


def _near_pairs(t: dict[str, np.ndarray], bits: list[bytes | None], percent: int) -> tuple[list[int], list[int]]:
    """Pairs of different components, near signatures, and sets that may reach the similarity.

    side: 0 and 1 are compared with each other, 2 with all. shared: a set's shingles that others have too; beyond: those
    of them that its pivot lacks.
    """
    out_a, out_b = [], []
    ids, comps, sigs, side, n, shared, pivot, beyond = (t[k] for k in ("id", "comp", "sig", "side", "n", "shared", "pivot", "beyond"))
    # one row a class: packed bits of its pivot's shingles, by pivot
    place, tables = np.zeros(len(ids), np.int64), {}
    for p in np.unique(pivot).tolist():
        rows = np.flatnonzero(pivot == p)
        place[rows] = np.arange(len(rows))
        own = [np.frombuffer(bits[i], np.uint8) if bits[i] is not None else np.packbits(np.ones(n[i], bool)) for i in rows.tolist()]
        tables[p] = np.array(own)
    for i in range(len(ids)):
        other = np.flatnonzero((ids > ids[i]) & (comps != comps[i]) & ((side != side[i]) | (side == 2)))
        both = np.minimum(shared[other], shared[i])
        other = other[100 * both >= percent * (n[other] + n[i] - both)]
        other = other[(sigs[other] != sigs[i]).sum(axis=1) <= NEAR]
        if not len(other):
            continue
        alike = pivot[other] == pivot[i]
        if alike.any():
            table = tables[pivot[i]]
            some = other[alike]
            both = np.bitwise_count(table[place[some]] & table[place[i]]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[some], beyond[i])
            other = np.concatenate([other[~alike], some[100 * both >= percent * (n[some] + n[i] - both)]])
        out_a += [int(ids[i])] * len(other)
        out_b += ids[other].tolist()
    return out_a, out_b


def across(docs: DataFrame, classes: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of classes (id, n, comp, sig) that share a key but no component yet and may be similar enough."""
    keys = index_keys(classes)
    mixed = keys.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("count")).where("low < high").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = save(keys.join(mixed, "key").select("key", "id", "blocks"), "members")
    dealt = members.agg(F.sum("blocks")).first()[0] or 0
    open_ids = members.select("id").distinct()
    known = classes.join(open_ids, "id").join(stars.select(F.col("b").alias("id"), F.col("a").alias("pivot"), "bits", "beyond"), "id", "left")
    known = save(known.withColumn("pivot", F.coalesce("pivot", "id")).withColumn("beyond", F.coalesce("beyond", F.lit(0).cast("long"))), "open")
    ids = save(known.selectExpr("explode(array(id, pivot)) AS id").distinct(), "open-ids")
    # the pivots are among those counted, so a shingle that no other has is never one of the pivot's
    own = save(lonely(docs, ids), "lonely")
    known = known.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    known = known.withColumn("shared", F.col("n") - F.col("own")).withColumn("beyond", F.greatest(F.col("beyond") - F.col("own"), F.lit(0)))
    # a class that no other can be similar enough to is out
    known = known.where(100 * F.col("shared") >= percent * F.col("n")).drop("own")
    members = members.join(known, "id")
    # a key of more than BLOCK members is cut into blocks, and each two blocks meet once
    members = members.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") == low, 0).otherwise(1)
    members = members.select("key", low.alias("i"), high.alias("j"), side.alias("side"), "id", "comp", "sig", "n", "shared", "pivot", "beyond", "bits")

    def run(table: pa.Table) -> pa.Table:
        t = {c: table[c].to_numpy() for c in ("id", "comp", "side", "n", "shared", "pivot", "beyond")}
        t["sig"] = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, CHUNKS * WIDTH)
        a, b = _near_pairs(t, table["bits"].to_pylist(), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # dealt by the number of members, as the work of one isn't told by its bytes
    spark = docs.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-dealt // MEMBERS))
    return members.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts, and those of white space, have no shingles and are alone. Rows that repeat a doc_id are judged
    each by its own text. A null doc_id can't be named: such a row links nothing, its component is null and it is kept.
    An empty table gives no rows. kept marks each component's smallest doc_id.
    """
    rows = save(signatures(docs), "signatures")
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    sets = save(some.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")

    keys = index_keys(sets.withColumn("comp", F.col("id")))
    centres = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("key", "a")
    meets = keys.join(centres, "key").where("id > a").groupBy("id", "a").agg(F.count("*").alias("count"))
    pairs = save(meets.groupBy("id").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", F.col("id").alias("b")), "pairs")
    stars = confirm(docs, pairs, percent)
    comp = components(stars.where("linked"))

    classes = save(sets.join(comp.withColumnRenamed("comp", "c"), "id", "left").select("id", "n", F.coalesce("c", "id").alias("comp"), "sig"), "classes")
    more = save(across(docs, classes, stars, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        rest = confirm(docs, more, percent).where("linked")
        if not rest.isEmpty():
            comp = components(stars.where("linked").select("a", "b").unionByName(rest.select("a", "b")))

    classes = sets.select("key", "id").join(comp, "id", "left").select("key", F.coalesce("comp", "id").alias("comp"))
    named = F.coalesce("comp", "doc_id")
    out = rows.select("doc_id", "n", F.col("key")).join(classes, "key", "left")
    named = F.when(F.col("doc_id").isNotNull(), named)
    return out.select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"), F.coalesce(F.col("doc_id") == named, F.lit(True)).alias("kept"))
