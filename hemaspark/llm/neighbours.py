"""Approximate nearest neighbours by inner product: low-dimensional stable projections in a kd-tree, verified in projected order until a chi-square test holds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, written
from .search import ASKED, BLOCK, Best, complete, first_of_equals, lists_of, matrix, numbered, packed, paired, visits

NEAREST = 20
#: Directions of the projection (even, so that the chi-square distribution has a closed form).
DIRECTIONS = 12
#: The search stops when a point as near as the kth so far would have been projected nearer with this probability.
CERTAIN = 0.98
#: Projected points that the kd-tree's upper levels are fitted on, cells of these levels at most, points of a leaf below.
SAMPLE, MOST_CELLS, LEAF = 16384, 4096, 128
SEED = 11
SLACK = 1e-9


def chi_square(x: float, m: int) -> float:
    """Probability that a chi-square variable with an even number m of degrees is at most x."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio(certain: float, m: int) -> float:
    """The squared projected distance, as a multiple of the squared distance of the kth, from which the test holds."""
    low, high = 0.0, 1000.0 + 10 * m
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < certain else (low, mid)
    return high


def directions(size: int, m: int, seed: int = SEED) -> np.ndarray:
    """Normal (2-stable) directions for vectors of `size` components and one more."""
    return np.random.default_rng(seed).normal(size=(size + 1, m))


def project(x: np.ndarray, longest: float | None, way: np.ndarray) -> np.ndarray:
    """Members (longest given) are lifted onto a sphere: one more component makes all as long as the longest, so that the nearest by
    inner product are the nearest by distance. Queries are scaled to that sphere, their further component being zero."""
    if longest is None:
        big = np.abs(x).max(axis=1, keepdims=True)
        x = x / big
        unit, more = x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))
    else:
        unit = x / longest
        more = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))
    return unit @ way[:-1] + more[:, None] * way[-1]


def split(p: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """(direction, value) of the inner nodes of a kd-tree, in heap order, for a power of two of cells: medians of the widest direction."""
    parts, nodes = [p], []
    while len(parts) < cells:
        halves = []
        for x in parts:
            j = int(np.ptp(x, axis=0).argmax()) if len(x) else 0
            at = float(np.median(x[:, j])) if len(x) else 0.0
            nodes.append((j, at))
            halves += [x[x[:, j] <= at], x[x[:, j] > at]]
        parts = halves
    return nodes


def cell_of(p: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(p), np.int64)
    way, value = np.array([j for j, _ in nodes], int), np.array([v for _, v in nodes], float)
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (p[np.arange(len(p)), way[at]] > value[at])
    return at - len(nodes)


def leaves(p: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Positions of the points in each leaf of a kd-tree: halves by rank in the widest direction."""
    done, open_ = [], [np.arange(len(p))]
    while open_:
        x = open_.pop()
        if len(x) <= most:
            done.append(np.sort(x))
            continue
        j, half = int(np.ptp(p[x], axis=0).argmax()), len(x) // 2
        order = np.argpartition(p[x, j], half)
        open_ += [x[order[:half]], x[order[half:]]]
    return done


def to_box(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    return np.stack([(np.maximum(0, np.maximum(a - q, q - b)) ** 2).sum(1) for a, b in zip(low, high, strict=True)], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed up in order of components, so that equal vectors have equal scores anywhere."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return np.where(np.isnan(out), -np.inf, out)


def squared(score: np.ndarray, norm: np.ndarray, longest: float) -> np.ndarray:
    """Squared distance on the sphere of radius one for an inner product of originals; without a score: infinite."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(score), np.inf, np.maximum(0, 2 - 2 * score / (norm * longest)))


FOUND = T.StructType([T.StructField("q", T.LongType()), T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])


def nearest(df: DataFrame, asks: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, certain: float = CERTAIN, m: int = DIRECTIONS, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """The k nearest of each row for which `asks` (a column, or SQL) holds, among all other rows: query_id, rank, vec_id, score (inner product, in double precision).

    All if there are fewer; ties to smaller ids. Null and zero vectors and those with null or non-finite components take no part,
    vectors of another length are no candidates, a row without an id asks nothing and comes last among ties; repeated rows are rows
    of their own (each is the other's candidate). Scores beyond a double's range are infinite, those that are no number come last.
    An empty table gives an empty result.

    Members are projected to m normal directions and dealt to the cells of a kd-tree, whose upper levels are fitted on SAMPLE
    projected points and whose lower ones are built by the task that holds a cell. A query first searches its own cell, leaf by leaf in order of
    projected distance, and then, with the kth score found, every cell whose box the chi-square test doesn't rule out: a
    neighbour nearer than the kth has been verified with probability `certain` when the test holds. Of equal vectors the first
    k + 1 ids are members, and equal queries search once. Cells with many points, and those asked by many queries,
    are dealt to several tasks. The driver holds the cells' boxes, MOST_CELLS at most.
    """
    spark = df.sparkSession
    bound_arrow(spark)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(F.expr(asks) if isinstance(asks, str) else asks, F.lit(False)).alias("asks"))
    base = base.where(complete("v") & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = numbered(base.withColumn("h", F.xxhash64("v")), "vectors")
    members = written(first_of_equals(rows, ["h", "v"], k + 1).select("v", "id", "row", F.size("v").alias("size")), "members")
    asking = rows.where("asks and id is not null").select("h", "v", "id", "row")
    classes = numbered(asking.select("h", "v").distinct(), "queries").withColumnRenamed("row", "q")
    # The largest component comes off first, so that no square leaves a double's range.
    lengths = members.withColumn("big", F.array_max(F.transform("v", F.abs))).withColumn("norm", F.col("big") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("big")) * (x / F.col("big")))))
    found = None
    for size, count, longest in sorted(tuple(r) for r in lengths.groupBy("size").agg(F.count("*"), F.max("norm")).collect()):
        part = _search(members.where(F.col("size") == size), classes.where(F.size("v") == size).select("q", "v"), size, count, longest * (1 + 1e-12), k + 1, certain, m, block, asked)
        found = part if found is None else found.unionByName(part)
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if found is None:
        return spark.createDataFrame([], result)
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))).where(F.col("n") <= k + 1).drop("n")
    asking = asking.join(classes, ["h", "v"]).select("q", F.col("id").alias("query_id"), F.col("row").alias("own"))
    each = asking.join(best, "q").where("own <> row")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _search(members: DataFrame, queries: DataFrame, size: int, count: int, longest: float, k: int, certain: float, m: int, block: int, asked: int) -> DataFrame:
    """FOUND: the k best members that queries (q, v) find, some of them in each cell."""
    way, limit = directions(size, m), stop_ratio(certain, m)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([packed(project(lists_of(b.column(0), b.num_rows), longest, way)) if b.num_rows else pa.array([], pa.binary())], names=["p"])

    share = members.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "row"), 11) <= int(min(1.0, 2 * SAMPLE / count) * (1 << 53)))
    few = share.orderBy(F.xxhash64(F.lit(SEED + 1), "row"), "row").limit(SAMPLE).select("v").mapInArrow(projected, "p binary")
    fitted = np.frombuffer(b"".join(bytes(r[0]) for r in few.collect()), float).reshape(-1, m)
    cells = min(MOST_CELLS, 1 << max(0, math.ceil(count / block) - 1).bit_length())
    nodes = split(fitted, cells)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = lists_of(b.column(0), b.num_rows)
                p = project(v, longest, way)
                yield pa.RecordBatch.from_arrays([pa.array(cell_of(p, nodes).astype(np.int32)), b.column(1), b.column(2), packed(v), pa.array(list(p), pa.list_(pa.float64()))], names=["shard", "id", "row", "v", "p"])

    index = written(members.select("v", "id", "row").mapInArrow(dealt, "shard int, id long, row long, v binary, p array<double>"), "cells")
    sides = index.groupBy("shard").agg(F.array(*[F.min(F.col("p")[j]) for j in range(m)]).alias("low"), F.array(*[F.max(F.col("p")[j]) for j in range(m)]).alias("high"))
    boxes = sorted(sides.collect())
    number, low, high = np.array([b[0] for b in boxes], np.int32), np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])

    def plan(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = lists_of(b.column(1), b.num_rows)
            q = project(v, None, way)
            far = to_box(q, low, high)
            home = far.argmin(1)
            if first:
                kth, go = np.full(len(q), -np.inf), [number[[h]] for h in home]
            else:
                kth = b.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                ok = far <= limit * squared(kth, np.linalg.norm(v, axis=1), longest)[:, None] + SLACK
                ok[np.arange(len(q)), home] = False
                go = [number[x] for x in ok]
            yield pa.RecordBatch.from_arrays([b.column(0), packed(v), packed(q), pa.array(kth), pa.array(go, pa.list_(pa.int32()))], names=["q", "v", "p", "kth", "shards"])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = matrix(a["v"], size), matrix(b["v"], size)
        p, r = np.array(a["p"].combine_chunks().flatten(), float).reshape(-1, m), matrix(b["p"], m)
        norm, prior = np.linalg.norm(y, axis=1), b["kth"].to_numpy()
        error = 8 * size * 2.0**-53 * norm * longest
        best = Best(len(y), k, float, -np.inf)
        parts = leaves(p)
        far = to_box(r, [p[i].min(0) for i in parts], [p[i].max(0) for i in parts])
        reach = lambda i: limit * squared(np.maximum(prior[i], best.kth()[i]), norm[i], longest) + SLACK
        for part, ask in visits(np.argsort(far, axis=1, kind="stable"), lambda i, j: far[i, j] <= reach(i)):
            at = parts[part]
            apart = (r[ask] ** 2).sum(1)[:, None] + (p[at] ** 2).sum(1) - 2 * r[ask] @ p[at].T
            with np.errstate(over="ignore", invalid="ignore"):
                score = y[ask] @ x[at].T
            score[np.isnan(score)] = np.inf
            i, j = np.nonzero((apart <= reach(ask)[:, None]) & (score >= (np.maximum(prior[ask], best.kth()[ask]) - error[ask])[:, None]))
            best.add(ask[i], products(y[ask[i]], x[at[j]]), at[j])
        i, score, at = best.found()
        return pa.table({"q": b["q"].take(pa.array(i)), "row": a["row"].take(pa.array(at)), "id": a["id"].take(pa.array(at)), "score": pa.array(score)})

    shape = "q long, v binary, p binary, kth double, shards array<int>"
    begun = written(queries.mapInArrow(lambda x: plan(x, True), shape), "plan")
    one = written(paired(index.select("shard", "row", "id", "v", "p"), begun, compare, FOUND, block, asked), "found")
    kth = one.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("q", F.when(F.size("s") >= k, F.col("s")[k - 1]).alias("kth"))
    rest = written(queries.join(kth, "q", "left").select("q", "v", "kth").mapInArrow(lambda x: plan(x, False), shape), "plan")
    return one.unionByName(paired(index.select("shard", "row", "id", "v", "p"), rest, compare, FOUND, block, asked))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: queries are rows whose vec_id is divisible by 20, candidates all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
