"""SimHash near-duplicates by the generalised pigeonhole principle: correlated bits share a partition, partitions have
thresholds of their own, found by dynamic programming on estimated candidate counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, components, rows_of, written

BITS = 64
MAX_DISTANCE = 4
SHINGLE = 4
HASH_SEED = 42
#: Fingerprints that the plan of partitions and thresholds is fitted on (not the search itself).
SAMPLE = 2048
#: A bucket with more entries is dealt out anew by a second set of partitions.
HOT_BUCKET = 1 << 16
#: Cost of comparing two fingerprints, against that of shuffling one entry.
COMPARE_COST = 0.01


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: A-Z lower-cased, shingles of `shingle` words with repeats, XXH64; 0 without words."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not raw:
        return 0
    line = b" ".join(raw)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    n = max(1, len(raw) - shingle + 1)
    ends = (starts + sizes)[min(shingle, len(raw)) - 1 :]
    digest, ones, step = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 1 << 15
    for a in range(0, n, step):  # a slice at a time: memory doesn't follow the text
        h = np.array([digest(line[i:j], HASH_SEED) for i, j in zip(starts[a : a + step][: n - a].tolist(), ends[a : a + step].tolist(), strict=False)], np.uint64)
        ones += bit_counts(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def bit_majority(h: np.ndarray) -> int:
    """The fingerprint of a text's hashes, repeats included; 0 of none."""
    ones = sum((bit_counts(h[a : a + (1 << 15)]) for a in range(0, len(h), 1 << 15)), np.zeros(BITS, np.int64))
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, _th, fp): the fingerprint of each row as a long, and xxhash64 of its text. Rows stay where they are."""
    bound_arrow(docs.sparkSession)
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_th", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(2).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=schema.names)

    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("_t")).mapInArrow(run, schema)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of about equal size, correlated ones together: each group grows by the bit that correlates most with it."""
    if len(sample) < 3:
        return [list(range(k, BITS, parts)) for k in range(parts)]
    with np.errstate(all="ignore"):
        c = np.abs(np.nan_to_num(np.corrcoef(_bits(sample), rowvar=False)))
    np.fill_diagonal(c, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        rest = sorted(left)
        group = [rest[int(np.argmax(c[np.ix_(rest, rest)].sum(axis=1)))]]
        left.discard(group[0])
        while len(group) < size:
            rest = sorted(left)
            b = rest[int(np.argmax(c[np.ix_(rest, group)].sum(axis=1)))]
            group.append(b)
            left.discard(b)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 and least total cost; costs[i][t + 1] is that of t in partition i.

    If two fingerprints differed by more than t_i in every partition i, they would differ by sum(t_i + 1) > distance bits,
    so one partition at least finds each pair.
    """
    need = distance + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
    for cost in costs:
        best = [min(((best[used][0] + cost[total - used], [*best[used][1], total - used - 1]) for used in range(total + 1)), key=lambda x: x[0]) for total in range(need + 1)]
    return best[need][1]


def plan(sample: np.ndarray, n: int, distance: int = MAX_DISTANCE) -> list[tuple[int, list[int]]]:
    """[(mask, flips)] of the partitions that are probed: flips are the masks to try, up to the partition's threshold.

    Tries every number of partitions up to distance + 1 and takes the cheapest: entries (probes for n fingerprints), and
    pairs that meet, estimated from the sample's pairs and from independent bits.
    """
    best, n = None, max(n, 1000)  # below that any plan will do: the one with few entries
    a, b = np.triu_indices(min(len(sample), SAMPLE // 2), 1)
    differ = sample[a] ^ sample[b] if len(sample) > 1 else np.zeros(0, np.uint64)
    for parts in range(2, distance + 2):
        groups = group_bits(sample, parts)
        costs = []
        for g in groups:
            d = np.bitwise_count(differ & np.uint64(mask_of(g)))
            row = [0.0]
            for t in range(distance + 1):
                tries = sum(comb(len(g), r) for r in range(t + 1))
                near = sum(comb(len(g), r) for r in range(min(2 * t, len(g)) + 1)) / 2 ** len(g)
                meet = max(near, float((d <= 2 * t).mean()) if len(d) else 0.0)
                row.append(n * tries + COMPARE_COST * n * n * meet / 2)
            costs.append(row)
        found = allocate(costs, distance)
        cost = sum(c[t + 1] for c, t in zip(costs, found, strict=True))
        if best is None or cost < best[0]:
            best = (cost, [(mask_of(g), [mask_of(list(x)) for r in range(t + 1) for x in combinations(g, r)]) for g, t in zip(groups, found, strict=True) if t >= 0])
    return best[1]


def _roots(x: np.ndarray, distance: int, depth: int = 0) -> np.ndarray:
    """For distinct fingerprints: the index of a linked one that stands for the connected part within x."""
    n = len(x)
    parent = np.arange(n)
    if n < 2:
        return parent

    def join(own: np.ndarray, other: np.ndarray) -> None:
        for i, j in zip(own.tolist(), other.tolist(), strict=True):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            while parent[j] != j:
                parent[j] = parent[parent[j]]
                j = parent[j]
            if i != j:
                parent[max(i, j)] = min(i, j)

    if n > 1024 and depth < 2:
        # Pairs within a large bucket agree in one of distance + 1 parts at least: smaller buckets, all of them needed.
        for k in range(distance + 1):
            own = np.uint64(mask_of([b for b in range(BITS) if (b * 7 + depth * 3 + b // 5) % (distance + 1) == k]))
            key = x & own
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    r = _roots(x[group], distance, depth + 1)
                    moved = r != np.arange(len(group))
                    join(group[moved], group[r[moved]])
    else:
        for a in range(0, n, 512):
            block = x[a : a + 512]
            i, j = np.nonzero(np.bitwise_count(block[:, None] ^ x[None, a:]) <= distance)
            i, j = i[i < j], j[i < j]
            join(i + a, j + a)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _star_edges(bucket: np.ndarray, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within each bucket (equal, adjacent values): at most one for each entry."""
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(start, len(bucket)))
    left, right = [], []
    for s in np.unique(size[size > 1]).tolist():
        at = start[size == s]
        if s <= 8:  # all buckets of one size at a time
            for i in range(s):
                for j in range(i + 1, s):
                    a, b = x[at + i], x[at + j]
                    near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
                    left.append(a[near])
                    right.append(b[near])
        else:
            for k in at.tolist():
                own = np.unique(x[k : k + s])
                r = _roots(own, distance)
                moved = r != np.arange(len(own))
                left.append(own[moved])
                right.append(own[r[moved]])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def links(distinct: DataFrame, distance: int = MAX_DISTANCE, hot: int = HOT_BUCKET, sample: int = SAMPLE) -> DataFrame:
    """(a, b): edges between fingerprints whose connected parts are those of all pairs at most `distance` bits apart.

    distinct: (fp) without repeats. Entries of all fingerprints are dealt by (partition, bits); a bucket is compared in
    one task, by blocks, holding eight bytes a fingerprint and giving at most one edge an entry, so pairs are never
    emitted. A bucket beyond `hot` entries is dealt anew by distance + 1 parts of all bits, of which a linked pair shares
    one: the exact way for the rest.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    few = distinct.where(F.shiftrightunsigned(F.xxhash64(F.lit(8), "fp"), 11) <= int(min(1.0, 2 * sample / max(1, n)) * (1 << 53)))
    seen = np.array([r[0] for r in few.orderBy(F.xxhash64(F.lit(7), "fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    parts = plan(seen, n, distance)
    entries = None
    for k, (mask, flips) in enumerate(parts):
        sig = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        one = distinct.select("fp", F.lit(k).alias("part"), F.explode(F.transform(F.lit([_signed(f) for f in flips]).cast("array<bigint>"), lambda f, sig=sig: sig.bitwiseXOR(f))).alias("sig") if len(flips) > 1 else sig.alias("sig"))
        entries = one if entries is None else entries.unionByName(one)
    large = written(entries.groupBy("part", "sig").count().where(F.col("count") > hot).select("part", "sig", F.lit(True).alias("hot")), "hot")
    entries = entries.withColumn("more", F.lit(0)).withColumn("bits", F.lit(0).cast("long"))
    if not large.isEmpty():
        second = [mask_of(list(range(k, BITS, distance + 1))) for k in range(distance + 1)]
        anew = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("more"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(second)]))
        marked = entries.join(large, ["part", "sig"], "left")
        entries = marked.where("hot is null").drop("hot").unionByName(marked.where("hot").drop("hot", "more", "bits").withColumn("_x", anew).select("fp", "part", "sig", "_x.*"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            key = [table.column(c).to_numpy() for c in ("part", "sig", "more", "bits")]
            new = np.zeros(table.num_rows, bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            a, b = _star_edges(np.cumsum(new), table.column("fp").to_numpy().view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < 100_000:
                continue
            table = pa.concat_tables(held)
            last = [table.column(c)[-1].as_py() for c in ("part", "sig", "more", "bits")]
            same = np.ones(rows, bool)
            for c, v in zip(("part", "sig", "more", "bits"), last, strict=True):
                same &= table.column(c).to_numpy() == v
            cut = int(np.argmax(same))  # the bucket that may go on in the next batch waits
            if cut:
                yield out(table.slice(0, cut))
                held, rows = [table.slice(cut)], rows - cut
        if rows:
            yield out(pa.concat_tables(held))

    dealt = entries.repartition("part", "sig", "more", "bits").sortWithinPartitions("part", "sig", "more", "bits")
    return dealt.mapInArrow(compare, schema).distinct()


def classes_of(distinct: DataFrame, distance: int = MAX_DISTANCE, hot: int = HOT_BUCKET) -> DataFrame:
    """(fp, root) for each of the fingerprints (fp, without repeats): the component over links of at most `distance` bits, named by
    its smallest fingerprint."""
    distinct = written(distinct, "distinct")
    edges = written(links(distinct, distance, hot), "links")
    linked = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = components(linked, edges).toDF("fp", "component")
    return written(distinct.join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, shingle: int = SHINGLE, hot: int = HOT_BUCKET) -> DataFrame:
    """One row for each document: id_col, _th (xxhash64 of the text), fp (long), root (the component's smallest
    fingerprint), component_id: the smallest id reachable over links.

    Fingerprints at most `distance` bits apart link, equal ones too. Copies meet as one fingerprint before anything is
    compared. Null and empty texts have fingerprint 0, linked like any other. Null ids never name a component unless it
    has no other id; repeated rows are in one component. An empty table gives an empty result; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("_id").alias("least")), "classes")
    named = written(classes_of(classes.select("fp"), distance, hot).join(classes, "fp"), "labels")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.drop("least").join(least, "root")
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), "_th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of docs less all but one of each component of near-duplicates; see keep_first. With `similarity` the links are those of
    shingles.near_copies: classes of fingerprints are verified by the Jaccard similarity of whole sets of shingles, and completed."""
    if similarity is None:
        return keep_first(docs, near_duplicates(docs, id_col, text_col, distance, shingle), id_col, text_col)
    from .shingles import near_copies

    return keep_first(docs, near_copies(docs, id_col, text_col, shingle, similarity, distance), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs less all but one of each component (root in found): the one with the smallest id (then text hash) stays.

    A row without an id stays only where its component has no row with one; of rows that repeat id and text one stays; all
    columns, whatever their names, are kept as they were; an empty table gives an empty result. Texts are shuffled once, to be told which stay.
    """
    found = written(found, "found")
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("_id"), F.col("_th")))
    kept = written(found.groupBy("root").agg(first.alias("x")).select("x._id", "x._th"), "kept")
    same = found[id_col].eqNullSafe(kept["_id"]) & (found["_th"] == kept["_th"])
    repeats = found.join(kept, same, "left_semi").groupBy(id_col, "_th").count().where("count > 1")
    rows = rows_of(docs, id_col, text_col).join(kept, F.expr("id <=> _id and th = _th"), "left_semi")
    if not repeats.isEmpty():
        rows = rows.dropDuplicates(["id", "th"])
    return rows.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents, production parameters."""
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
