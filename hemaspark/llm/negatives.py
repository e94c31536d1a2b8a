"""Hard-negative mining: k-means inverted lists with stored radii, visited by their Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, written
from .embeddings import _kmeans, _nearest
from .search import ASKED, BLOCK, Best, complete, first_of_equals, lists_of, matrix, numbered, packed, paired, visits

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Components become floor(SCALE * x).
SCALE = 256
#: Vectors that centroids are fitted on, and lists at most.
SAMPLE, MOST_LISTS = 16384, 4096
SEED = 13
NONE = np.iinfo(np.int64).min


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers held as doubles, exactly, as integers: products of doubles where all sums stay below 2^53, else of longs."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def window(positive: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) integer scores s with low * positive <= 100 * s <= high * positive."""
    whole, rest = positive // 100, positive % 100  # no product leaves a long's range
    return low * whole - (-low * rest) // 100, high * whole + high * rest // 100


POSITIVE = T.StructType([T.StructField("q", T.LongType()), T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
NEGATIVE = T.StructType([T.StructField("q", T.LongType()), T.StructField("positive", T.LongType()), *POSITIVE.fields[1:]])


def hard_negatives(
    df: DataFrame, anchors: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, lists: int | None = None, block: int = BLOCK, asked: int = ASKED,
) -> DataFrame:
    """For each row for which `anchors` (a column, or SQL) holds and each of its positives, the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(scale * x), scores are exact integer inner products with the anchor; higher ones come first, ties by
    smaller id (nulls last). Positives: the first `positives` other rows of the anchor's label. Negatives: the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Rows with a null
    label or vector or a null or non-finite component take no part, nor do vectors whose squared length is no long; those of
    other lengths have no score with an anchor. A row without an id is no anchor; repeated rows are rows of their own. An empty table, or
    anchors without positives or negatives, give no rows.

    Every row is in the list of its nearest centroid, and each list has its radius, the largest distance of a row to its centroid; so
    no score exceeds anchor * centroid + |anchor| * radius. An anchor visits lists by that bound and stops where it falls
    strictly below its kth score; for negatives a list whose scores lie outside of the window is passed over. Lists are kept in
    shards of about `block` rows: an anchor first searches the shard that holds its best bound and then, with the kth score found,
    all those that its bounds don't rule out. Results are exact. Of equal rows the first `positives` + 1 ids are members, equal anchors
    search once, and long lists are dealt to several tasks. The driver holds centroids and radii, MOST_LISTS at most.
    """
    spark = df.sparkSession
    bound_arrow(spark)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"), F.coalesce(F.expr(anchors) if isinstance(anchors, str) else anchors, F.lit(False)).alias("asks"))
    base = base.where(F.col("label").isNotNull() & complete("v")).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    rows = numbered(base.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) < 2.0**62).withColumn("h", F.xxhash64("v", "label")), "vectors")
    keys = ["h", "v", "label"]
    members = written(first_of_equals(rows, keys, positives + 1).select("v", "id", "row", "label", F.size("v").alias("size")), "members")
    asking = rows.where("asks and id is not null").select(*keys, "id", "row")
    classes = numbered(asking.select(*keys).distinct(), "queries").withColumnRenamed("row", "q")
    near = far = None
    for size, count in sorted((r[0], r[1]) for r in members.groupBy("size").count().collect()):
        pair = _search(members.where(F.col("size") == size), classes.where(F.size("v") == size).select("q", "v", "label"), size, count, positives + 1, negatives, low, high, lists or int(min(MOST_LISTS, 1 + count**0.5 / 2)), block, asked)
        near, far = pair if near is None else (near.unionByName(pair[0]), far.unionByName(pair[1]))
    names = (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))
    if near is None:
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in names))
    first = lambda df, keys, most: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))).where(F.col("rank") <= most)
    own = asking.join(classes, keys).select("q", F.col("id").alias("anchor_id"), F.col("row").alias("anchor"))
    chosen = first(own.join(near, "q").where("anchor <> row"), ["anchor"], positives).select("q", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    against = first(far, ["q", "positive"], negatives).select("q", F.col("positive").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(against, ["q", "positive_score"]).select(*[n for n, _ in names])


def _shards(sizes: np.ndarray, centroids: np.ndarray, block: int) -> np.ndarray:
    """The shard of each list: lists that are near each other (in the order of a two-level clustering) share one until it holds `block` rows."""
    rng = np.random.default_rng(SEED)
    groups = max(1, int(np.ceil(sizes.sum() / block)))
    group = _nearest(centroids, _kmeans(centroids, groups, rng, 8))
    shard, out, held, before = -1, np.empty(len(sizes), np.int32), 0, None
    for j in np.lexsort((np.arange(len(sizes)), group)):
        if before != group[j] or held + sizes[j] > block:
            shard, held, before = shard + 1, 0, group[j]
        out[j], held = shard, held + sizes[j]
    return out


def _search(members: DataFrame, queries: DataFrame, size: int, count: int, k: int, negatives: int, low: int, high: int, lists: int, block: int, asked: int) -> tuple[DataFrame, DataFrame]:
    """(POSITIVE rows, the k best of each query's label; NEGATIVE rows for each positive score), some of them from each shard."""
    share = members.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "row"), 11) <= int(min(1.0, 2 * SAMPLE / count) * (1 << 53)))
    few = share.orderBy(F.xxhash64(F.lit(SEED + 1), "row"), "row").limit(SAMPLE).select("v").mapInArrow(lambda x: (pa.RecordBatch.from_arrays([packed(lists_of(b.column(0), b.num_rows)) if b.num_rows else pa.array([], pa.binary())], names=["v"]) for b in x), "v binary")
    taken = few.collect()
    fitted = np.frombuffer(b"".join(bytes(r[0]) for r in taken), float).reshape(len(taken), size)
    centroids = _kmeans(fitted, lists, np.random.default_rng(SEED), 8)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = lists_of(b.column(0), b.num_rows)
                own = _nearest(v, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(1), b.column(2), b.column(3), packed(v), pa.array(np.linalg.norm(v - centroids[own], axis=1))], names=["list", "id", "row", "label", "v", "away"])

    index = written(members.select("v", "id", "row", "label").mapInArrow(dealt, "list int, id long, row long, label string, v binary, away double"), "lists")
    stored = np.array(sorted(tuple(r) for r in index.groupBy("list").agg(F.count("*"), F.max("away")).collect()), float)
    number = stored[:, 0].astype(int)
    centre, radius = centroids[number], stored[:, 2]
    shard_of = _shards(stored[:, 1], centre, block)
    place = np.full(len(centroids), -1)
    place[number] = np.arange(len(number))
    first_of = np.array([np.flatnonzero(shard_of == s)[0] for s in range(shard_of.max() + 1)]) if len(number) else np.zeros(0, int)
    names = members.sparkSession.createDataFrame([(int(n), int(s)) for n, s in zip(number, shard_of, strict=True)], "list int, shard int")
    held = index.join(F.broadcast(names), "list").select("shard", "list", "row", "id", "label", "v")  # a row for each list

    def bounds(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score that a row of each list can have, with room for rounding."""
        middle, reach = q @ centre.T, np.linalg.norm(q, axis=1)[:, None] * radius
        room = 1e-9 * (np.linalg.norm(q, axis=1)[:, None] * (np.linalg.norm(centre, axis=1) + radius)) + 1
        return middle - reach - room, middle + reach + room

    def by_shard(x: np.ndarray) -> np.ndarray:
        return np.stack([x[:, shard_of == s].any(1) for s in range(len(first_of))], axis=1)

    def plan(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = lists_of(b.column(1), b.num_rows)
                most = bounds(v)[1]
                home = shard_of[most.argmax(1)]
                kth = np.full(len(v), NONE) if first else b.column(3).fill_null(NONE).to_numpy(zero_copy_only=False)
                ok = by_shard(most >= kth[:, None])
                other = np.arange(len(first_of)) != home[:, None]
                yield pa.RecordBatch.from_arrays([b.column(0), packed(v), b.column(2), pa.array(kth), pa.array([np.flatnonzero(x).astype(np.int32) for x in (~other if first else ok & other)], pa.list_(pa.int32()))], names=["q", "v", "label", "kth", "shards"])

    def unpacked(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """(members, queries, whether a member has a query's label, positions of the members of each list)."""
        x, y = matrix(a["v"], size), matrix(b["v"], size)
        _, codes = np.unique(np.array(a["label"].to_pylist() + b["label"].to_pylist(), object).astype(str), return_inverse=True)
        at = place[a["list"].to_numpy()]
        return x, y, codes[None, : len(x)] == codes[len(x) :, None], {int(j): np.flatnonzero(at == j) for j in np.unique(at)}

    def alike(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, same, own = unpacked(a, b)
        parts = np.array(sorted(own))
        most, prior, best = bounds(y)[1][:, parts], b["kth"].to_numpy(), Best(len(y), k, np.int64, NONE)
        kth = lambda i: np.maximum(prior[i], best.kth()[i])
        for part, ask in visits(np.argsort(-most, axis=1, kind="stable"), lambda i, j: most[i, j] >= kth(i)):
            at = own[int(parts[part])]
            score = integer_products(y[ask], x[at])
            i, j = np.nonzero(same[np.ix_(ask, at)] & (score >= kth(ask)[:, None]))
            best.add(ask[i], score[i, j], at[j])
        i, score, at = best.found()
        return pa.table({"q": b["q"].take(pa.array(i)), "row": a["row"].take(pa.array(at)), "id": a["id"].take(pa.array(at)), "score": pa.array(score)})

    def plan_far(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = lists_of(b.column(1), b.num_rows)
            least, most = bounds(v)
            scores = [np.array(x, np.int64) for x in b.column(3).to_pylist()]
            kths = [np.array(x, np.int64) for x in b.column(4).to_pylist()]
            go = []
            for i, (s, kth) in enumerate(zip(scores, kths, strict=True)):
                a, z = window(s, low, high)
                reached = (most[i][:, None] >= np.maximum(a, kth)) & (least[i][:, None] <= z) & (a <= z)
                some = reached.any(1)
                home = shard_of[np.where(some, most[i], -np.inf).argmax()] if some.any() else -1  # best bound of a list that can hold some
                shards = np.unique(shard_of[some])
                if first:
                    go.append((int(home), [home] if home >= 0 else []))
                else:
                    at = b.column(5)[i].as_py()
                    go.append((at, shards[shards != at]))
            yield pa.RecordBatch.from_arrays([b.column(0), packed(v), b.column(2), b.column(3), b.column(4), pa.array([h for h, _ in go], pa.int32()), pa.array([np.asarray(x, np.int32) for _, x in go], pa.list_(pa.int32()))], names=["q", "v", "label", "scores", "kths", "home", "shards"])

    def unlike(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, same, own = unpacked(a, b)
        parts = np.array(sorted(own))
        least, most = (m[:, parts] for m in bounds(y))
        scores, kths = b["scores"].to_pylist(), b["kths"].to_pylist()
        wide = max(len(s) for s in scores)
        positive, prior, there = np.zeros((len(y), wide), np.int64), np.full((len(y), wide), NONE), np.zeros((len(y), wide), bool)
        for i, (s, z) in enumerate(zip(scores, kths, strict=True)):
            positive[i, : len(s)], prior[i, : len(s)], there[i, : len(s)] = s, z, True
        floor, ceiling = window(positive, low, high)
        there &= floor <= ceiling
        best = Best(len(y) * wide, negatives, np.int64, NONE)
        from_ = lambda i: np.maximum(np.maximum(floor[i], prior[i]), best.kth().reshape(-1, wide)[i])
        reached = lambda i, j: (there[i] & (most[i, j][:, None] >= from_(i)) & (least[i, j][:, None] <= ceiling[i])).any(1)
        for part, ask in visits(np.argsort(-most, axis=1, kind="stable"), reached, ends=False):
            at = own[int(parts[part])]
            score = integer_products(y[ask], x[at])
            other = ~same[np.ix_(ask, at)]
            start = from_(ask)
            for c in range(wide):
                i, j = np.nonzero(other & there[ask, c][:, None] & (score >= start[:, c][:, None]) & (score <= ceiling[ask, c][:, None]))
                best.add(ask[i] * wide + c, score[i, j], at[j])
        i, score, at = best.found()
        return pa.table({"q": b["q"].take(pa.array(i // wide)), "positive": pa.array(positive.ravel()[i]), "row": a["row"].take(pa.array(at)), "id": a["id"].take(pa.array(at)), "score": pa.array(score)})

    kth_of = lambda n: F.when(F.size("s") >= n, F.col("s")[n - 1])
    falling = F.sort_array(F.collect_list("score"), asc=False).alias("s")
    shape = "q long, v binary, label string, kth long, shards array<int>"
    begun = written(queries.select("q", "v", "label").mapInArrow(lambda x: plan(x, True), shape), "plan")
    one = written(paired(held, begun, alike, POSITIVE, block, asked), "found")
    kth = one.groupBy("q").agg(falling).select("q", kth_of(k).alias("kth"))
    rest = written(queries.join(kth, "q", "left").select("q", "v", "label", "kth").mapInArrow(lambda x: plan(x, False), shape), "plan")
    every = one.unionByName(paired(held, rest, alike, POSITIVE, block, asked))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    near = written(every.withColumn("n", rank).where(F.col("n") <= k).drop("n"), "positives")

    scores = near.groupBy("q").agg(F.sort_array(F.collect_set("score")).alias("scores"))  # k at most
    wanted = written(queries.join(scores, "q").select("q", "v", "label", "scores"), "queries")
    shape = "q long, v binary, label string, scores array<long>, kths array<long>, home int, shards array<int>"
    none = F.transform("scores", lambda _: F.lit(int(NONE)).cast("long"))
    begun = written(wanted.withColumn("kths", none).withColumn("home", F.lit(-1)).mapInArrow(lambda x: plan_far(x, True), shape), "plan")
    one = written(paired(held, begun, unlike, NEGATIVE, block, asked), "found")
    kths = one.groupBy("q", "positive").agg(falling).where(F.size("s") >= negatives).select("q", "positive", kth_of(negatives).alias("kth")).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("positive", "kth"))).alias("m"))
    again = wanted.join(kths, "q", "left").join(begun.select("q", "home"), "q").select("q", "v", "label", "scores", F.transform("scores", lambda s: F.coalesce(F.col("m")[s], F.lit(int(NONE)).cast("long"))).alias("kths"), "home")
    rest = written(again.mapInArrow(lambda x: plan_far(x, False), shape), "plan")
    return near, one.unionByName(paired(held, rest, unlike, NEGATIVE, block, asked))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: anchors are rows whose vec_id is divisible by 50; where it is divisible by 7, the label first becomes (label + 1) % 10."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


#: The same over all pairs, for DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""
