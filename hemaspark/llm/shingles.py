"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash classes bring sets together first; what bits can't tell is completed by bands of minimum hashes; every link is decided
on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, components, written
from .simhash import HASH_SEED, MAX_DISTANCE, bit_majority, classes_of, keep_first

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of so many minimum hashes. A pair at the threshold of 0.8 meets in none of them with a chance of (1 - 0.8 ** 4) ** 24, three
#: in a million; a pair at 0.3 meets with 0.18.
BANDS, ROWS = 24, 4
#: Shingles of a part of a bucket: a task holds two parts at a time.
PART = 1 << 18
#: Texts that a bitmap is made for.
BITMAP = 1 << 24
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 1 << 13


def hashes(text: str | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included: A-Z lower-cased, a shorter text is one shingle, one without words none."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not raw:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(raw), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = (starts + sizes)[min(shingle, len(raw)) - 1 :]
    n = len(ends)
    return np.fromiter((digest(line[i:j], HASH_SEED) for i, j in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)


def shingles(text: str | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The text's set: distinct hashes, ascending."""
    return np.unique(hashes(text, shingle).view(np.int64))


def _node(own: np.ndarray) -> int:
    """The name of a set: equal sets have the same."""
    return int(np.array(xxhash.xxh64_intdigest(own.tobytes(), HASH_SEED), np.uint64).view(np.int64))


_RNG = np.random.default_rng(HASH_SEED)
_FACTORS = _RNG.integers(1 << 31, size=(BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(1 << 32, size=(BANDS * ROWS, 1), dtype=np.uint64).astype(np.uint32)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its minimum hashes over the set."""
    x = (own.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):  # a slice at a time: memory doesn't follow the text
        least = np.minimum(least, (x[None, a : a + 4096] * _FACTORS + _SHIFTS).min(axis=1))
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def named(docs: DataFrame, shingle: int) -> DataFrame:
    """(_id, _th, node, fp, size, keys) of each row of docs (_id, _th, _text): one pass over whole texts."""
    bound_arrow(docs.sparkSession)
    schema = T.StructType([docs.schema["_id"], docs.schema["_th"], T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, keys = [], [], [], [np.zeros(0, np.int64)]
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                h = hashes(text, shingle)
                own = np.unique(h.view(np.int64))
                nodes.append(_node(own))
                fps.append(bit_majority(h))
                sizes.append(len(own))
                keys.append(band_keys(own) if len(own) else keys[0])
            ends = pa.array(np.cumsum([0, *map(len, keys[1:])]), pa.int32())
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), fp, pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))], names=schema.names)

    return docs.select("_id", "_th", "_text").mapInArrow(run, schema)


def bitmap(texts: DataFrame, size: int) -> bytes:
    """The bits of all hashes (_th) modulo size, a power of two, little-endian: words of 64 bits are put together by all tasks."""
    at = F.col("_th").bitwiseAND(F.lit(size - 1))
    words = texts.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(_th & {min(63, size - 1)} as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(max(1, size >> 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.tobytes()


def wanted(docs: DataFrame, texts: DataFrame, shingle: int, most: int = BITMAP) -> DataFrame:
    """(node, x): the sets of the texts (_th) asked for, made anew from docs, as they are larger than texts.

    Up to `most` texts, a bitmap of their hashes, 16 bits each (32 MB), goes to every task and drops nearly all other texts before
    anything is cut or shuffled; what it lets through needlessly finds no partner. More texts are joined by hash.
    """
    n = texts.count()
    size = 1 << max(10, (16 * n).bit_length())
    if n > most:
        docs, shared = docs.join(texts.select("_th"), "_th", "left_semi"), None
    else:
        shared = docs.sparkSession.sparkContext.broadcast(bitmap(texts, size))
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(shared.value, np.int64) if shared else None, set()
        for batch in batches:
            nodes, sets = [], []
            th, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            asked = np.ones(len(th), bool) if bits is None else bits[(th & (size - 1)) >> 6] >> (th & 63) & 1
            for k in np.flatnonzero(asked).tolist():
                if int(th[k]) not in seen:  # copies within a task are sent once
                    seen.add(int(th[k]))
                    own = shingles(texts[k].as_py(), shingle)
                    nodes.append(_node(own))
                    sets.append(own.tobytes())
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=schema.names)

    bound_arrow(docs.sparkSession)
    return docs.select("_th", "_text").mapInArrow(run, schema).groupBy("node").agg(F.first("x").alias("x"))


def linked_sets(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked among the sets, and isn't of one label already: at most one for each set.

    Overlaps are products of the incidence matrix of the shingles that two sets or more hold, some columns at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # of shingles that more than one set holds
    held = count[inverse] > 1
    at, row = column[inverse[held]], owner[held]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        lo, hi = np.searchsorted(at, (a, a + COLUMNS))
        m = np.zeros((len(sets), int(min(COLUMNS, at[hi - 1] - a + 1)) if hi > lo else 0), np.float32)
        m[row[lo:hi], at[lo:hi] - a] = 1
        shared += m @ m.T
    union = sizes[:, None] + sizes[None, :] - shared
    i, j = np.nonzero(np.triu((shared >= similarity * union - 1e-9) & (labels[:, None] != labels[None, :]), 1))
    _, tree = np.unique(labels, return_inverse=True)
    left, right = [], []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        if tree[p] != tree[q]:
            tree[tree == tree[q]] = tree[p]
            left.append(nodes[p])
            right.append(nodes[q])
    return np.array(left, np.int64), np.array(right, np.int64)


def compared(entries: DataFrame, facts: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): edges between sets of a bucket (key) that link and aren't of one component yet.

    entries: (key, node, component). facts: (node, _th, size). Buckets of one component, or one set, go. The others' sets are dealt to
    parts of some PART shingles; a task compares two parts, or one with itself, and answers with a forest of edges, never
    with pairs, so a bucket that holds a third of all sets is work for many tasks with bounded memory.
    """
    open_ = entries.groupBy("key").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u <> v").select("key")
    open_ = written(entries.join(open_, "key", "left_semi").join(facts, "node"), "open")
    parts = open_.groupBy("key").agg(F.ceil(F.sum("size") / PART).cast("int").alias("parts"))
    sets = wanted(docs, written(open_.select("_th").distinct(), "texts"), shingle)
    dealt = open_.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = dealt.select("node", "component", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("node", "component", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    keys = ("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            cols = [table.column(c).to_numpy() for c in keys]
            new = np.ones(table.num_rows + 1, bool)
            new[1:-1] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            cuts = np.flatnonzero(new)
            node, label, raw = table.column("node").to_numpy(), table.column("component").to_numpy(), table.column("x").combine_chunks()
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1 and (label[a:b] != label[a]).any():
                    p, q = linked_sets(node[a:b], label[a:b], [np.frombuffer(raw[k].as_py(), np.int64) for k in range(a, b)], similarity)
                    left.append(p)
                    right.append(q)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 4096 and sum(b.nbytes for b in held) < 1 << 26:
                continue
            table = pa.Table.from_batches(held)
            same = np.all([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in keys], axis=0)
            cut = int(np.argmax(same))  # the tile that may go on in the next batch waits
            if cut:
                yield out(table.slice(0, cut))
                rest = table.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield out(pa.Table.from_batches(held))

    rows = tiles.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys, "node")
    return written(rows.select(*keys, "node", "component", "x").mapInArrow(run, schema), "links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row for each document: id_col, _th (xxhash64 of the text), node (of its shingle set), root (of the component).

    Sets (known by 64-bit hashes) link from a Jaccard similarity of `similarity` on. They are compared where they meet: in a SimHash class
    (fingerprints linked at `distance` or fewer of 64 bits), then, where they aren't connected yet, in a band of minimum
    hashes; see BANDS for what that misses. Copies of a set meet as one row before that. Texts without words are
    alike. Null ids and repeated rows are rows of their own; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("_text"))
    rows = written(named(docs, shingle), "named")
    sets = rows.groupBy("node").agg(F.min("_th").alias("_th"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    sets = written(sets, "sets")
    facts = sets.select("node", "_th", "size")
    alone = F.col("node").alias("component")
    roots = classes_of(sets.select("fp").distinct(), distance)
    meet = sets.join(roots, "fp").select(F.col("root").alias("key"), "node", alone)
    edges = compared(meet, facts, docs, shingle, similarity)
    for bands in (range(BANDS // 3), range(BANDS // 3, BANDS)):  # the first bands connect what would meet in all of them
        ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        labels = written(components(ends, edges), "labels")
        keyed = sets.select("node", F.explode(F.slice("keys", bands[0] + 1, len(bands))).alias("key"))
        several = keyed.groupBy("key").count().where("count > 1").select("key")
        meet = keyed.join(several, "key", "left_semi").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        edges = edges.union(compared(meet, facts, docs, shingle, similarity))
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = written(components(ends, edges), "labels")
    return rows.select("_id", "_th", "node").join(labels, "node", "left").select(F.col("_id").alias(id_col), "_th", "node", F.coalesce("component", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less all but one of each component of near copies; see simhash.keep_first."""
    return keep_first(docs, near_copies(docs, id_col, text_col), id_col, text_col)
