"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Rows are dealt into blocks; a block sorts its rows by each dimension once. A query goes down all lists from their ends that
favour it, some places a step, scores each row that it meets for the first time on the whole vector, and stops when the
bound, the score of a row that would have the last value seen in every list, is below its k-th best. The queries search a
few rows first and take the k-th best score among those along, so that they stop sooner in every block; as scores below it
can't be among the k best of all, the result stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save
from .vectors import best, in_blocks, matrix, usable

#: Places a list is gone down in the first step; each later step doubles the depth.
STEP = 16
#: Scores beyond this are alike.
MOST = 10**38 - 1


def _wide(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


class SortedLists:
    """A block of integer vectors with the order of its rows by each dimension, ascending."""

    def __init__(self, x: np.ndarray):
        self.ints, self.most = x, _wide(x)
        self.exact = self.most < 2**20
        self.x = x.astype(np.float64) if self.exact else x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, self.order, axis=0)

    def top(self, q: np.ndarray, k: int, ids: np.ndarray, skip: np.ndarray, least: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, depth reached): the k best by (score descending, id), without the rows marked in ``skip``; of rows
        that score less than ``least`` any may be missing."""
        n, most = len(self.x), _wide(q)
        if self.exact and most < 2**20:  # sums are then exact in doubles
            kind = np.float64
        else:  # in 64 bits, or in Python's integers
            kind = np.int64 if self.most * most * max(1, len(q)) < 2**62 else object
        x, values, q = self.x.astype(kind, copy=False), self.values, q.astype(kind)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = skip.copy()
        rows, scores = np.empty(0, np.int64), np.empty(0, kind)
        depth = 0
        while depth < n:
            to = min(n, max(STEP, 2 * depth))
            fresh = np.zeros(n, bool)
            fresh[self.order[n - to : n - depth, up]] = True
            fresh[self.order[depth:to, down]] = True
            if not len(up) and not len(down):
                fresh[:] = True  # a zero query: every row scores 0
                to = n
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, x[new] @ q])
            first = np.lexsort((ids[rows], -scores))[:k] if kind is not object else np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k], np.int64)
            rows, scores = rows[first], scores[first]
            depth = to
            if seen.all():
                break
            edge = max((s for s in (least, scores[-1] if len(rows) == k else None) if s is not None), default=None)
            if edge is not None:
                bound = q[up] @ values[n - depth, up].astype(kind) + q[down] @ values[depth - 1, down].astype(kind)
                if bound < edge:  # a tie could still go to a smaller id
                    break
        return rows, scores, depth


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """Components as floor(scale * x), in 64-bit integers (the nearest such where that doesn't fit)."""
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * float(scale))))


def top_products(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, ahead: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score long): for each row of table (vec_id, embedding) whose id ``every`` divides, the k rows
    with the highest integer inner product, without itself; exact. See ``vectors.usable`` for the rows that take part (zero
    vectors do): rows that repeat a vec_id are queries and candidates of their own, and vectors of different lengths are
    never compared. Ties go to the smaller vec_id. No rows, or a single one, give no result. Scores that don't fit 64 bits
    are ranked by what they are and shown as the nearest that does. ``ahead``: about so many rows are searched first."""
    rows = save(integers(usable(table), scale), "integers")
    queries = save(rows.where(F.col("vec_id") % every == 0), "queries")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if left.num_rows:
            ids, numbers, lists = left["vec_id"].to_numpy(), left["row"].to_numpy(), SortedLists(matrix(left))
            for number, q, v, least in zip(right["row"].to_pylist(), right["vec_id"].to_pylist(), matrix(right), right["least"].to_pylist()):
                found, scores, _ = lists.top(v, k, ids, numbers == number, None if least is None else int(least))
                out[0] += [number] * len(found)
                out[1] += [q] * len(found)
                out[2] += numbers[found].tolist()
                out[3] += ids[found].tolist()
                out[4] += [str(min(max(int(s), -MOST), MOST)) for s in scores]
        kinds = {"query": pa.int64(), "query_id": pa.int64(), "row": pa.int64(), "vec_id": pa.int64(), "score": pa.string()}
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), out)})

    schema = "query long, query_id long, row long, vec_id long, score string"
    exact = F.col("score").cast("decimal(38,0)")
    total = rows.count()
    least = F.lit(None).cast("string").alias("least")
    if total > 2 * ahead:
        some = rows.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(total)) < ahead)
        first = in_blocks(save(some, "ahead"), queries.select("*", least), search, schema).withColumn("score", exact)
        place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc()))
        edges = save(first.withColumn("r", place).where(F.col("r") == k).select(F.col("query").alias("row"), F.col("score").cast("string").alias("least")), "edges")
        asked = save(queries.join(edges, "row", "left"), "asked")
    else:
        asked = queries.select("*", least)
    found = in_blocks(rows, asked, search, schema).withColumn("score", exact)
    top, ends = best(found, k, F.col("score").desc()), [F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1)]
    return top.withColumn("score", F.greatest(ends[0], F.least(ends[1], "score")).cast("long"))
