"""What searches over vectors share: rows that take part, shards compared in blocks, the best of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Rows of a shard, and queries that ask it, that one task compares.
BLOCK, ASKED = 4096, 2048


def complete(v: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column `row` that names its rows, written, so that the names stay."""
    return written(df.withColumn("row", F.monotonically_increasing_id()), name)


def first_of_equals(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of rows alike in keys the first `most` by id, nulls last: no query needs more of them. Each task limits its own before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("id").asc_nulls_last(), "row")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def matrix(raw: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of `size` doubles from a column of bytes."""
    return np.frombuffer(b"".join(raw.to_pylist()), float).reshape(len(raw), size)


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(x, float)], pa.binary())


def lists_of(column: pa.Array, rows: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return np.array(column.flatten(), float).reshape(rows, -1)


def in_order(members: pa.Table) -> pa.Table:
    """Members by id, nulls last, then row: a smaller position wins a tie."""
    return members.sort_by([("id", "ascending"), ("row", "ascending")])


class Best:
    """The k best of each query so far: larger scores first, ties to smaller positions."""

    def __init__(self, queries: int, k: int, kind: type, floor: float | int):
        self.k, self.floor = k, floor
        self.score, self.at = np.full((queries, k), floor, kind), np.full((queries, k), -1, np.int64)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        if not len(query):
            return
        own = np.unique(query)
        q, s, p = (np.concatenate(x) for x in ((np.repeat(own, self.k), query), (self.score[own].ravel(), score), (self.at[own].ravel(), at)))
        there = p >= 0
        q, s, p = q[there], s[there], p[there]
        order = np.lexsort((p, -s, q))
        q, s, p = q[order], s[order], p[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.score[own], self.at[own] = self.floor, -1
        self.score[q[top], rank[top]], self.at[q[top], rank[top]] = s[top], p[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, position) of all that is held."""
        q, j = np.nonzero(self.at >= 0)
        return q, self.score[q, j], self.at[q, j]


def visits(order: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], ends: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(part, queries that go there): each query takes its parts in its own order, for as long as wanted(queries, parts) says.

    order: a row of parts for each query. All queries take a step together, so that each part is compared with a block of them.
    With `ends` a query stops at the first part that isn't wanted, else it passes on to the next.
    """
    going = np.arange(len(order))
    for step in range(order.shape[1]):
        part = order[going, step]
        yes = wanted(going, part)
        if ends:
            going, part = going[yes], part[yes]
            yes = np.ones(len(going), bool)
        if not len(going):
            return
        for p in np.unique(part[yes]):
            yield int(p), going[yes & (part == p)]


def paired(members: DataFrame, asks: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """compare(members, queries) for each block of a shard's members with each block of the queries that ask it.

    members: shard, row, ...; asks: q, shards (an array), ... (both written). A shard with many rows, or asked by many
    queries, is dealt to as many tasks as it takes. There is a row of numbers for each shard, of which there are a bounded number.
    """
    flat = asks.select(*[c for c in asks.columns if c != "shards"], F.explode("shards").alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("m")).join(flat.groupBy("shard").agg(F.count("*").alias("n")), "shard")
    sizes = F.broadcast(written(sizes.select("shard", F.ceil(F.col("m") / block).cast("int").alias("pieces"), F.ceil(F.col("n") / asked).cast("int").alias("parts")), "shards"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n, x: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    keys = ("shard", "piece", "part")
    left = members.join(sizes, "shard").withColumn("piece", of("pieces", "row")).withColumn("part", every("parts")).drop("pieces", "parts")
    right = flat.join(sizes, "shard").withColumn("part", of("parts", "q")).withColumn("piece", every("pieces")).drop("pieces", "parts")
    empty = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in schema]).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return compare(in_order(a), b) if a.num_rows and b.num_rows else empty

    fresh = lambda df: df.select(*[F.col(c).alias(f"{c}_") for c in df.columns]).toDF(*df.columns)
    return fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInArrow(run, schema)
