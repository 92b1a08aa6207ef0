"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue over all of them.

The trees are fitted on a bounded sample and every row is sent down them; leaves that then hold more than ``LEAF_ROWS`` rows
are split further by trees of their own, fitted where their rows are. A query pops the nodes of all trees from one queue,
nearest split plane first, until the leaves it has met hold ``budget`` rows. Each leaf met is joined with its rows, and exact
distances decide; so a query costs its budget, whatever the number of rows.

The budget is measured, not guessed: for a bounded number of queries the true neighbours are found among all rows, and the
budget is the number of rows at which the queue has met the wanted share of them (``recall``). For clustered vectors that is a
number that doesn't grow with the table; vectors without clusters, as random ones are, need a large part of it. Of equal
vectors the k + 1 with the smallest ids are searched, which is exact, as the others can't be among any k nearest.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, shared
from .vectors import QUERIES, best, matrix, usable

#: A leaf of more rows is split further; what its own tree is fitted on; the sample's bytes on the driver.
LEAF_ROWS, LEAF_SAMPLE, SAMPLE_BYTES = 4096, 4096, 64 << 20


@dataclass
class Tree:
    """Inner nodes by number: plane, offset, and the children left (below the offset) and right; a child < 0 is leaf ~child."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.zeros(len(x), np.int64) if len(self.planes) else np.full(len(x), -1)
        while (rows := np.flatnonzero(at >= 0)).size:
            node = at[rows]
            right = np.einsum("ij,ij->i", x[rows], self.planes[node]) > self.offsets[node]
            at[rows] = self.children[node, right.astype(np.int64)]
        return ~at


def grow(x: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    """Split at the median of the projection on the difference of two random points' neighbourhoods, until nodes are small."""
    planes, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        if len(rows) > leaf_size:
            for _ in range(4):
                a, b = x[rng.choice(rows, 2, replace=False)]
                some = x[rng.choice(rows, min(len(rows), 64), replace=False)]
                near = ((some - a) ** 2).sum(axis=1) < ((some - b) ** 2).sum(axis=1)
                if not near.any() or near.all():
                    continue
                plane = some[near].mean(axis=0) - some[~near].mean(axis=0)
                if not (size := np.linalg.norm(plane)):
                    continue
                along = x[rows] @ (plane / size)
                offset = np.median(along)
                right = along > offset
                if 0.05 < right.mean() < 0.95:
                    split = plane / size, offset, right
                    break
        if split is None:  # small enough, or (copies) inseparable
            me, leaves = ~leaves, leaves + 1
        else:
            me = len(planes)
            planes.append(split[0])
            offsets.append(split[1])
            children.append([0, 0])
            todo += [(rows[~split[2]], me, 0), (rows[split[2]], me, 1)]
        if parent >= 0:
            children[parent][side] = me
    shape = (-1, x.shape[1])
    return Tree(np.array(planes).reshape(shape), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def probe(forest: list[Tree], sizes: list[np.ndarray], query: np.ndarray, goal: float) -> list[tuple[int, int, float, int]]:
    """(tree, leaf, how far, rows met by then) in the order in which one queue over all trees gives the leaves, until these
    hold ``goal`` rows; ``sizes`` are the leaves' rows by tree, empty leaves are passed over."""
    margins = [(t.planes @ query - t.offsets).tolist() for t in forest]
    queue = [(-np.inf, k, 0 if len(t.planes) else -1) for k, t in enumerate(forest)]
    kids, out, got = [t.children for t in forest], [], 0
    while queue and got < goal:
        far, k, node = heapq.heappop(queue)
        if node < 0:
            if n := int(sizes[k][~node]):
                got += n
                out.append((k, ~node, float(far), got))
        else:
            m, (a, b) = margins[k][node], kids[k][node].tolist()
            heapq.heappush(queue, (max(far, m), k, a))
            heapq.heappush(queue, (max(far, -m), k, b))
    return out


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


PLACE = ("tree", "leaf", "sub")


class Index:
    """The saved rows of one length, dealt to the leaves of a forest."""

    def __init__(self, rows: DataFrame, trees: int, sample: int, leaf_size: int, seed: int):
        spark, total = rows.sparkSession, rows.count()
        self.rows, self.total = rows, total
        width = rows.first()["d"]
        sample = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
        chosen = rows if total <= sample else rows.where(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(seed)), F.lit(1 << 20)) < int(sample / total * (1 << 20)))
        fitted = chosen.select("vec_id", "v").limit(2 * sample).toArrow()
        points = matrix(fitted)[np.lexsort(fitted["vec_id"].to_numpy()[None])] if fitted.num_rows else np.empty((0, width))
        rng = np.random.default_rng(seed)
        self.forest = [grow(points, leaf_size, rng) for _ in range(trees)]
        forest = self.shared = shared(spark, "forest", self.forest)

        def index(batches):
            for batch in batches:
                x = matrix(pa.Table.from_batches([batch]))
                leaves = np.stack([t.leaf(x) for t in forest.value], axis=1).astype(np.int32) if len(x) else np.empty((0, 1), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(leaves.tolist(), pa.list_(pa.int32()))], ["row", "vec_id", "v", "leaves"])

        kind = dict(rows.dtypes)["v"]
        placed = save(rows.select("row", "vec_id", "v").mapInArrow(index, f"row long, vec_id long, v {kind}, leaves array<int>"), "indexed")
        each = placed.select("row", "vec_id", "v", F.posexplode("leaves").alias("tree", "leaf"))
        # a number a leaf of the driver's trees
        self.sizes = [np.zeros(t.leaves, np.int64) for t in self.forest]
        for r in placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
            self.sizes[r["tree"]][r["leaf"]] = r["count"]
        self.split = any((s > LEAF_ROWS).any() for s in self.sizes)
        self.members = each.withColumn("sub", F.lit(0))
        if self.split:
            self._split(each, seed)

    def _split(self, each: DataFrame, seed: int) -> None:
        """Large leaves get trees of their own, fitted on about LEAF_SAMPLE of their rows each; blocks of a leaf's rows are
        sent down them."""
        spark = each.sparkSession
        large = [(k, leaf, int(n)) for k, s in enumerate(self.sizes) for leaf, n in enumerate(s) if n > LEAF_ROWS]
        large = spark.createDataFrame(large, "tree int, leaf int, rows long")  # bounded by the driver's trees
        mine = each.join(F.broadcast(large), ["tree", "leaf"])
        drawn = mine.where(F.pmod(F.xxhash64("row", "tree", F.lit(seed + 1)), F.lit(1 << 20)) < F.ceil(F.lit(LEAF_SAMPLE << 20) / F.col("rows")))

        def fit(table: pa.Table) -> pa.Table:
            tree, leaf, n = (table[c][0].as_py() for c in ("tree", "leaf", "rows"))
            x = matrix(table)[np.argsort(table["row"].to_numpy())]
            made = grow(x, max(8, len(x) * LEAF_ROWS // (2 * n)), np.random.default_rng([seed, tree, leaf]))
            return _rows("tree int, leaf int, blob binary", [(tree, leaf, pickle.dumps(made))])

        subs = drawn.select("tree", "leaf", "rows", "row", "v").groupBy("tree", "leaf").applyInArrow(fit, "tree int, leaf int, blob binary")
        self.subs = save(subs.join(F.broadcast(large), ["tree", "leaf"]), "leaf-trees")
        blocks = F.ceil(F.col("rows") / (8 * LEAF_ROWS))
        mine = mine.withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), blocks))
        down = self.subs.select("tree", "leaf", "blob", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))

        def send(left: pa.Table, right: pa.Table) -> pa.Table:
            x = matrix(left)
            sub = pickle.loads(right["blob"][0].as_py()).leaf(x) if right.num_rows and len(x) else np.zeros(len(x), np.int64)
            return left.select(["row", "vec_id", "v", "tree", "leaf"]).append_column("sub", pa.array(sub.astype(np.int32)))

        keys, kind = ("tree", "leaf", "block"), dict(each.dtypes)["v"]
        sent = mine.select("row", "vec_id", "v", *keys).groupBy(*keys).cogroup(down.groupBy(*keys)).applyInArrow(send, f"row long, vec_id long, v {kind}, tree int, leaf int, sub int")
        small = each.join(F.broadcast(large.select("tree", "leaf")), ["tree", "leaf"], "left_anti").withColumn("sub", F.lit(0))
        self.members = save(small.unionByName(sent), "members")
        self.counts = save(self.members.groupBy(*PLACE).agg(F.count("*").alias("held")), "leaf-rows")

    def order(self, queries: DataFrame, goal: float) -> DataFrame:
        """(query, query_id, q, tree, leaf, sub, met): the leaves that each query (row, vec_id, v) pops until they hold
        ``goal`` rows, and the rows met by then."""
        forest, sizes, kind = self.shared, shared(queries.sparkSession, "sizes", self.sizes), dict(queries.dtypes)["v"]

        def ask(batches):
            for batch in batches:
                x, parts = matrix(pa.Table.from_batches([batch])), []
                for i, q in enumerate(x):
                    parts += [(i, *p) for p in probe(forest.value, sizes.value, q, goal)]
                if parts:
                    at, tree, leaf, far, met = map(np.array, zip(*parts))
                    some = [batch.column(c).take(pa.array(at)) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*some, pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(far), pa.array(met)], ["query", "query_id", "q", "tree", "leaf", "far", "met"])

        found = queries.select("row", "vec_id", "v").mapInArrow(ask, f"query long, query_id long, q {kind}, tree int, leaf int, far double, met long").withColumn("sub", F.lit(0))
        if not self.split:
            return found.drop("far")
        known = self.subs.select("tree", "leaf")
        plain = found.join(F.broadcast(known), ["tree", "leaf"], "left_anti").drop("met")
        asked = found.join(F.broadcast(known), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(64)))
        down = self.subs.select("tree", "leaf", "blob", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("block"))

        def expand(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = []
            if left.num_rows and right.num_rows:
                tree = pickle.loads(right["blob"][0].as_py())
                ones = [np.ones(tree.leaves, np.int64)]
                for i, (q, far) in enumerate(zip(matrix(left, "q"), left["far"].to_pylist())):
                    parts += [(i, sub, max(far, f)) for _, sub, f, _ in probe([tree], ones, q, goal / LEAF_ROWS * 8 + 8)]
            at, sub, far = map(list, zip(*parts)) if parts else ([], [], [])
            some = left.select(["query", "query_id", "q", "tree", "leaf"]).take(pa.array(at, pa.int64()))
            return some.append_column("sub", pa.array(sub, pa.int32())).append_column("far", pa.array(far, pa.float64()))

        keys = ("tree", "leaf", "block")
        split = asked.select("query", "query_id", "q", "far", *keys).groupBy(*keys).cogroup(down.groupBy(*keys)).applyInArrow(expand, f"query long, query_id long, q {kind}, tree int, leaf int, sub int, far double")
        every = plain.unionByName(split).join(self.counts, list(PLACE))
        met = F.sum("held").over(W.partitionBy("query").orderBy("far", *PLACE).rowsBetween(W.unboundedPreceding, 0))
        return every.withColumn("met", met).where(F.col("met") - F.col("held") < goal).drop("far", "held")

    def search(self, queries: DataFrame, goal: float, k: int) -> DataFrame:
        """(query, query_id, row, vec_id, score): the k nearest (and what is as near) of each leaf that a query meets."""
        blocks = max(1, -(-queries.count() // QUERIES))
        asked = self.order(queries, goal).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).drop("met")
        held = self.members.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))) if blocks > 1 else self.members.withColumn("block", F.lit(0).cast("long"))

        def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
            parts: list[list] = [[], [], []]
            if left.num_rows and right.num_rows:
                x, q, numbers, of = matrix(left), matrix(right, "q"), left["row"].to_numpy(), right["query"].to_numpy()
                step = max(1, (1 << 21) // x.size)
                for at in range(0, len(q), step):
                    far = np.sqrt(((x - q[at : at + step, None]) ** 2).sum(axis=2))
                    far[of[at : at + step, None] == numbers] = np.inf
                    edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.inf
                    asked, some = np.nonzero((far <= edge) & (far < np.inf))  # ties included
                    for out, values in zip(parts, (asked + at, some, far[asked, some])):
                        out.append(values)
            asked, some, far = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
            near = right.select(["query", "query_id"]).take(pa.array(asked)) if len(asked) else right.select(["query", "query_id"]).slice(0, 0)
            found = left.select(["row", "vec_id"]).take(pa.array(some)) if len(asked) else left.select(["row", "vec_id"]).slice(0, 0)
            return pa.table({"query": near["query"], "query_id": near["query_id"], "row": found["row"], "vec_id": found["vec_id"], "score": pa.array(far, pa.float64())})

        keys = (*PLACE, "block")
        met = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rerank, "query long, query_id long, row long, vec_id long, score double")
        return met.groupBy("query", "row").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))


def exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, row): the true k nearest of a bounded number of queries among all rows; each task keeps its own k a query."""
    asked = queries.select("row", "v").toArrow()
    box = shared(rows.sparkSession, "checks", (asked["row"].to_numpy(), matrix(asked)))

    def scan(batches):
        of, q = box.value
        held = [[] for _ in of]
        for batch in batches:
            x = matrix(pa.Table.from_batches([batch]))
            numbers, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(len(of) if len(x) else 0):
                far = ((x - q[i]) ** 2).sum(axis=1)
                far[numbers == of[i]] = np.inf
                some = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
                held[i] = sorted(held[i] + list(zip(far[some].tolist(), ids[some].tolist(), numbers[some].tolist())))[:k]
        out = [(int(of[i]), *r) for i, rs in enumerate(held) for r in rs if r[0] < np.inf]
        yield from _rows("query long, far double, vec_id long, row long", out).to_batches()

    near = rows.select("row", "vec_id", "v").mapInArrow(scan, "query long, far double, vec_id long, row long")
    return near.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("far", "vec_id", "row"))).where(F.col("r") <= k).select("query", "row")


def measured_budget(index: Index, queries: DataFrame, k: int, recall: float, checks: int, seed: int) -> int:
    """The rows a query must meet so that ``recall`` of the true neighbours of about ``checks`` queries are met."""
    n = queries.count()
    some = queries if n <= checks else queries.where(F.pmod(F.xxhash64("row", F.lit(seed + 2)), F.lit(1 << 20)) < -(-(checks << 20) // n))
    some = save(some.limit(2 * checks), "checks")
    true = save(exact(index.rows, some, k), "true")
    placed = index.members.join(F.broadcast(true.select("row").distinct()), "row").select("row", *PLACE)  # at most 2 * checks * k rows
    met = index.order(some, float("inf")).select("query", "met", *PLACE).join(F.broadcast(placed), list(PLACE)).join(F.broadcast(true), ["query", "row"])
    needed = sorted(r["met"] for r in met.groupBy("query", "row").agg(F.min("met").alias("met")).collect())
    return needed[min(len(needed) - 1, int(recall * len(needed)))] if needed else 1


def nearest(table: DataFrame, k: int = 10, every: int = 100, trees: int = 8, sample: int = 20_000, leaf_size: int = 64, recall: float = 0.96, checks: int = 48, budget: int | None = None, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of table (vec_id, embedding) whose id ``every`` divides, the k nearest
    rows found by Euclidean distance, without itself.

    See ``vectors.usable`` for the rows that take part; zero vectors don't. Rows that repeat a vec_id are queries and
    candidates of their own; vectors of different lengths are never compared, each length has its own forest. Ties go to the
    smaller vec_id. No rows, or a single one, give no result. The forest is fitted on at most ``sample`` rows (and
    SAMPLE_BYTES). A query meets ``budget`` rows; if that is None, as many as ``recall`` of the true neighbours of ``checks``
    queries need; a recall of 1 or more is an exact search, of all leaves of one tree."""
    every_row = save(usable(table, zero=False), "vectors")
    copy = F.row_number().over(W.partitionBy("v").orderBy("vec_id", "row"))
    rows = save(every_row.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "searched")
    out = None
    for d in sorted(r["d"] for r in rows.select("d").distinct().collect()):  # lengths, usually one
        queries = every_row.where((F.col("d") == d) & (F.col("vec_id") % every == 0))
        if queries.isEmpty():
            continue
        index = Index(save(rows.where(F.col("d") == d), "of-length"), 1 if recall >= 1 else trees, sample, leaf_size, seed)
        goal = float("inf") if recall >= 1 else budget or measured_budget(index, queries, k, recall, checks, seed)
        found = best(index.search(queries, goal, k), k, F.col("score").asc())
        out = found if out is None else out.unionByName(found)
    return out if out is not None else table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
