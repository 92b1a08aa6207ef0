"""Shared by the vector searches: the rows that take part, and a query set against all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and queries of one block: what a task holds at once.
ROWS, QUERIES = 8192, 16_384


def usable(table: DataFrame, vec: str = "embedding", zero: bool = True) -> DataFrame:
    """(row, vec_id, d, v): vectors without null or non-finite components, with a number for each row and their length; to
    be saved before use, as the numbers are made while it runs.

    Rows without a vec_id or vector, with an empty vector and, unless ``zero``, with a zero vector take no part. Rows that
    repeat a vec_id are rows of their own. Vectors of different lengths are never compared. Other columns are ignored.
    """
    kind = "array<float>" if dict(table.dtypes)[vec] == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast(kind).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("d"), "v")


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """A list column of equal lengths as rows; single precision is widened."""
    if not table.num_rows:
        return np.empty((0, 0))
    values = table[column].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return values.astype(np.float64) if values.dtype == np.float32 else values


def in_blocks(rows: DataFrame, queries: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``compare`` on every block of the saved rows with every block of the saved queries of the same length (both have row
    and d)."""
    n, m = rows.count(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = max(1024, min(ROWS, -(-n // (2 * cores))))
    across, down = max(1, -(-n // size)), max(1, -(-m // QUERIES))
    left = rows.withColumn("row_block", F.pmod(F.xxhash64("row"), F.lit(across))).withColumn("query_block", F.explode(F.expr(f"sequence(0L, {down - 1}L)")))
    right = queries.withColumn("query_block", F.pmod(F.xxhash64("row"), F.lit(down))).withColumn("row_block", F.explode(F.expr(f"sequence(0L, {across - 1}L)")))
    keys = ("d", "row_block", "query_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the first k of each query row, ties to the smaller vec_id."""
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(order, "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
