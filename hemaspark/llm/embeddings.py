"""Embedding near-duplicates by product quantisation: inverted lists with residual codes, asymmetric distances, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, components, written

COSINE = 0.9
#: Vectors that centroids and codebooks are fitted on (16 for each list where that is more); every vector is indexed.
SAMPLE = 16384
SUBSPACES, CODES, MOST_LISTS = 8, 64, 16384
#: A vector probes as many lists as find this share of partners that stand just at the threshold (see sufficient); a pair is
#: found from either side, so more of such pairs are found, and more still of closer ones.
REACH = 0.98
#: Vectors of the sample whose partners are looked at, real partners drawn for each at most, and how many are enough to count.
ASKED, DRAWN, ENOUGH = 2048, 32, 50
#: Deviations of the distance to a code, beyond which a pair is ruled out without an exact comparison.
DEVIATIONS = 5.0
#: Members of an inverted list that one task compares, and for each of them so many probes of the list.
BLOCK, PROBES_EACH = 4096, 4
SEED = 7


#: Beyond so many lists centroids are fitted in two levels.
TWO_LEVELS = 1024


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(16, (1 << 24) // max(1, len(c)))
    return np.concatenate([np.argmin((c * c).sum(1) - 2 * x[a : a + step] @ c.T, axis=1) for a in range(0, len(x), step)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return c


def train(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = SEED) -> tuple[np.ndarray, list[np.ndarray]]:
    """(coarse centroids, a codebook of residuals for each subspace) of unit vectors."""
    rng = np.random.default_rng(seed)
    if lists <= TWO_LEVELS:
        coarse = _kmeans(sample, lists, rng)
    else:  # by groups: centroids of a group come from its own vectors, in number as many as they are
        top = _kmeans(sample, int(lists**0.5), rng)
        group = _nearest(sample, top)
        share = np.bincount(group, minlength=len(top)) * lists / len(sample)
        coarse = np.concatenate([_kmeans(sample[group == g], max(1, round(share[g])), rng, 8) for g in range(len(top)) if (group == g).any()])
    own = _nearest(sample, coarse)
    rest = sample - coarse[own]
    return coarse, [_kmeans(np.ascontiguousarray(part), codes, rng, 8) for part in np.array_split(rest, min(subspaces, sample.shape[1]), axis=1)]


def _index(unit: np.ndarray, coarse: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, distance to what the codes stand for, distances to all centroids) of unit vectors."""
    far = np.sqrt(np.maximum(0, (unit * unit).sum(1)[:, None] + (coarse * coarse).sum(1) - 2 * unit @ coarse.T))
    own = np.argmin(far, axis=1)
    rest = unit - coarse[own]
    code, error = np.empty((len(unit), len(books)), np.uint8), np.zeros(len(unit))
    for m, (part, book) in enumerate(zip(np.array_split(rest, len(books), axis=1), books, strict=True)):
        d = (part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T
        code[:, m] = np.argmin(d, axis=1)
        error += ((part - book[code[:, m]]) ** 2).sum(1)
    return own, code, np.sqrt(error), far


def sufficient(sample: np.ndarray, coarse: np.ndarray, cosine: float, reach: float = REACH, seed: int = SEED) -> int:
    """How many lists to probe: the rank of a partner's list among the vector's own order of lists that covers the share `reach`, for unit
    vectors of the sample and whichever partners need most lists.

    Partners are made at exactly `cosine` in directions of two kinds: any, and those in which vectors of the sample differ from
    their centroids, as lists are cut where the data vary; and they are real ones of the sample, those nearest to the
    threshold, where it holds enough.
    """
    rng = np.random.default_rng(seed)
    x = sample[:ASKED]
    distance = lambda v: (coarse * coarse).sum(1) - 2 * v @ coarse.T
    d, home = distance(x), _nearest(sample, coarse)

    def lists(rank: np.ndarray) -> int:
        return int(np.quantile(rank, reach, method="higher")) + 1

    def made(g: np.ndarray) -> int:
        g = g - (g * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        return lists((d < d[np.arange(len(x)), distance(y).argmin(1)][:, None]).sum(1))

    rest = sample - coarse[home]
    rest = rest[np.linalg.norm(rest, axis=1) > 1e-9]
    most = max(made(rng.normal(size=x.shape)), made(rest[rng.integers(len(rest), size=len(x))]) if len(rest) else 1)
    # Of a vector with very many partners a few are drawn: dense data take no longer and no more memory.
    pairs = []
    for a in range(0, len(x), 64):
        close = x[a : a + 64] @ sample.T
        for i, row in enumerate(close):
            j = np.flatnonzero((row >= cosine) & (row < 1 - 1e-9))
            j = rng.choice(j, DRAWN, replace=False) if len(j) > DRAWN else j
            pairs.append(np.column_stack([row[j], np.full(len(j), a + i), j]))
    near = np.concatenate(pairs) if pairs else np.zeros((0, 3))
    if len(near) >= ENOUGH:
        near = near[np.argsort(near[:, 0], kind="stable")][: max(ENOUGH, len(near) // 4)]
        i, j = near[:, 1].astype(int), near[:, 2].astype(int)
        most = max(most, lists(np.concatenate([(d[i[b : b + 256]] < d[i[b : b + 256], home[j[b : b + 256]]][:, None]).sum(1) for b in range(0, len(i), 256)])))
    return min(len(coarse), most)


def _vector(v: np.ndarray) -> bytes:
    """Four bytes a component where they hold it exactly, else eight."""
    short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes()


def _matrix(raw: pd.Series, size: int) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * size else np.float64) for x in raw], float).reshape(-1, size)


def _compare(query: np.ndarray, member: np.ndarray, cosine: float, coarse: np.ndarray, books: list[np.ndarray], code: np.ndarray, error: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, member) positions whose cosine is at least `cosine`.

    Asymmetric distances are sums of table entries by code. For a linked pair the squared distance to the member's code is
    the squared radius plus the squared coding error, but for their inner product, which is near zero unless the two happen
    to point the same way: a pair beyond DEVIATIONS of that is ruled out. What is left is computed exactly.
    """
    radius = np.sqrt(max(0.0, 2 - 2 * cosine))
    unit = query / np.linalg.norm(query, axis=1, keepdims=True)
    norm = np.linalg.norm(member, axis=1)
    parts = np.array_split(unit - coarse, len(books), axis=1)
    limit = radius**2 + error**2 + 2 * radius * error * min(1.0, DEVIATIONS / np.sqrt(member.shape[1])) + 1e-6
    for a in range(0, len(query), 256):
        near = np.zeros((min(256, len(query) - a), len(member)), np.float32)
        for m, book in enumerate(books):
            part = parts[m][a : a + 256]
            table = ((part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T).astype(np.float32)
            near += table[:, code[:, m]]
        i, j = np.nonzero(near <= limit + 1e-4)
        for b in range(0, len(i), 1 << 17):
            p, q = i[b : b + (1 << 17)] + a, j[b : b + (1 << 17)]
            exact = np.einsum("ij,ij->i", query[p], member[q]) / (np.linalg.norm(query[p], axis=1) * norm[q])
            yield p[exact >= cosine], q[exact >= cosine]


PROBES = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("own", T.IntegerType()), T.StructField("reach", T.BinaryType()), T.StructField("vector", T.BinaryType())])
FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("other", T.LongType()), T.StructField("n", T.LongType())])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE, lists: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each vector: id_col, n_links (other rows linked directly), component_id (smallest id reachable), kept (id is component_id).

    Pairs link from `cosine` on, in double precision. Equal vectors are one class: they link with each other and count in
    links, but are compared once. Lists and codes rule pairs out (see sufficient and _compare); measured recall is above 0.97 of links
    (README). Where vectors lie so densely that most are within the threshold of each other, all lists are probed and
    every pair is compared. Null and zero vectors
    and those with null or non-finite components link with nothing; vectors of different lengths don't link. Null ids and
    repeated rows are rows of their own; a component without an id has null. The index is fitted on at most
    max(`sample`, 16 * lists) vectors by hash, and holds all. A list's members are dealt to tasks by `block`, its probes by
    PROBES_EACH times as many; a task answers with the
    number of links of each probe and a forest of edges, never with all pairs. An empty table gives an empty result.
    """
    spark = df.sparkSession
    bound_arrow(spark)
    base = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    fine = F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = written(base.withColumn("_ok", F.coalesce(fine, F.lit(False))).withColumn("_v", F.when(F.col("_ok"), F.transform("_v", lambda x: x + F.lit(0.0)))), "vectors")
    # Copies meet by value, minus zero being zero; the hash only names the class.
    classes = rows.where("_ok").groupBy("_v").agg(F.min("_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.xxhash64("_v", F.size("_v"))), "classes")
    results = None
    for size, n in sorted((r[0], r[1]) for r in classes.groupBy(F.size("_v")).count().collect()):
        found = _links(classes.where(F.size("_v") == size), n, cosine, sample, lists or int(min(MOST_LISTS, 1 + n**0.5 / 5)), block)
        results = found if results is None else results.unionByName(found)
    if results is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(results, "found")
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("n = 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = written(components(ends, edges).join(classes.select("node", "least"), "node"), "labels")
    least = labels.groupBy("component").agg(F.min("least").alias("id"))
    named = classes.join(labels.join(least, "component").select("node", "id"), "node", "left").join(counts, "node", "left")
    named = named.select("_v", F.coalesce("n", F.lit(0)).alias("n"), "copies", F.coalesce("id", "least").alias("component_id"))
    joined = rows.where("_ok").join(named, "_v").select("_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    every = joined.unionByName(rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return every.select(F.col("_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, n: int, cosine: float, sample: int, lists: int, block: int) -> DataFrame:
    """FOUND rows of one length of vectors: (node, 0, links with other classes' rows) and edges (node, other, 0)."""
    spark = classes.sparkSession
    most = max(sample, 16 * lists)
    few = classes.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "node"), 11) <= int(min(1.0, 2 * most / n) * (1 << 53)))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(v, float).tobytes() for v in batch.column(0).to_pylist()], pa.binary())], names=["v"])

    taken = few.orderBy(F.xxhash64(F.lit(SEED), "node"), "node").limit(most).select("_v").mapInArrow(flat, "v binary").collect()
    seen = np.frombuffer(b"".join(bytes(r[0]) for r in taken), float).reshape(len(taken), -1).copy()
    del taken
    seen /= np.linalg.norm(seen, axis=1, keepdims=True)
    coarse, books = train(seen, lists)
    reach = sufficient(seen, coarse, cosine)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column(2).flatten(), float).reshape(batch.num_rows, -1)
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            j = np.empty((len(v), reach), "<i2")
            for a in range(0, len(v), 256):  # nearest lists first, ties by number
                far = (coarse * coarse).sum(1) - 2 * unit[a : a + 256] @ coarse.T
                j[a : a + 256] = np.argsort(far, axis=1, kind="stable")[:, :reach]
            own = j[:, 0]
            at = pa.array(np.repeat(np.arange(len(v)), reach))
            columns = [batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array([x.tobytes() for x in j], pa.binary()), pa.array([_vector(x) for x in v], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(j.ravel().astype(np.int32)), *[c.take(at) for c in columns]], names=PROBES.names)

    probes = classes.select("node", "copies", "_v").mapInArrow(probe, PROBES)
    # Blocks of members and of probes: each pair of blocks of a list is compared in one task.
    sizes = probes.groupBy("list").agg(F.count_if(F.expr("list = own")).alias("m"), F.count("*").alias("q"))
    blocks = written(sizes.where("m > 0").select("list", F.ceil(F.col("m") / block).cast("int").alias("blocks"), F.ceil(F.col("q") / (PROBES_EACH * block)).cast("int").alias("asked")), "lists")
    dealt = probes.join(F.broadcast(blocks), "list")  # at most MOST_LISTS rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    members = dealt.where("list = own").withColumn("mine", of("blocks", 1)).withColumn("theirs", every("asked"))
    asking = dealt.withColumn("theirs", of("asked", 2)).withColumn("mine", every("blocks"))

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(left) and len(right):
            mine, ask = (_matrix(x["vector"], coarse.shape[1]) for x in (left, right))
            own = left["node"].to_numpy()
            names = right["node"].to_numpy()
            centre = coarse[key[0]]
            _, code, error, _ = _index(mine / np.linalg.norm(mine, axis=1, keepdims=True), centre[None], books)
            copies, asked = left["copies"].to_numpy(np.int64), right["copies"].to_numpy(np.int64)
            links, back = np.zeros(len(right), np.int64), np.zeros(len(left), np.int64)
            reaches = np.array([np.frombuffer(x, "<i2") for x in left["reach"]])
            home = right["own"].to_numpy()
            nodes, at = np.unique(np.concatenate([names, own]), return_inverse=True)
            ask_at, own_at = at[: len(names)], at[len(names) :]
            label = np.arange(len(nodes))
            for p, q in _compare(ask, mine, cosine, centre, books, code, error):
                other = names[p] != own[q]
                p, q = p[other], q[other]
                np.add.at(links, p, copies[q])
                alone = (reaches[q] != home[p][:, None]).all(axis=1)  # the member doesn't probe the query's list
                np.add.at(back, q[alone], asked[p[alone]])
                a, b = ask_at[p], own_at[q]
                while True:  # labels of the forest so far fall to the least of what a pair joins
                    x, y = label[a], label[b]
                    if (x == y).all():
                        break
                    low, high = np.minimum(x, y), np.maximum(x, y)
                    np.minimum.at(label, high, low)
                    while (label[label] != label).any():
                        label = label[label]
            rows = [(int(names[k]), 0, int(links[k])) for k in np.flatnonzero(links)]
            rows += [(int(own[k]), 0, int(back[k])) for k in np.flatnonzero(back)]
            rows += [(int(nodes[k]), int(nodes[label[k]]), 0) for k in np.flatnonzero(label != np.arange(len(nodes)))]
        return pd.DataFrame(np.array(rows, np.int64).reshape(-1, 3), columns=FOUND.names)

    fresh = lambda df, *names: df.select(*[F.col(c).alias(f"{c}_") for c in names]).toDF(*names)
    left = fresh(members, "list", "mine", "theirs", "node", "copies", "reach", "vector")
    right = fresh(asking, "list", "mine", "theirs", "node", "copies", "own", "vector")
    keys = ("list", "mine", "theirs")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all vectors, production parameters."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same over all pairs, for DuckDB.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
