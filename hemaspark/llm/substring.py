"""Exact repeated passages by fixed-block anchors: blocks are indexed, every rolling window probes, hits extend to full windows.

Documents are packed into chunks of some hundred thousand words, which keep their number. A window of 20 words holds a
whole block of 10 of any grid, so where a passage of 20 words or more stands twice, the rolling 10-word windows of either
place meet a block of the other. Hashes go to groups by value, as packed bytes; a group answers with a bit for each. Then
only windows of 20 words that hold a hit are looked at: they go to groups with their places, and a group answers which
of them start earlier elsewhere. What equals within a chunk is settled there and sent once, so a passage that a third of
all documents share costs a group one entry for each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, written

WINDOW = 20
SEED = 5
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
CHUNK_WORDS = 1 << 18
#: Words for each group of hashes: what one task holds.
GROUP_WORDS = 1 << 20
MOST_TASKS = 20_000
#: Hashes, on average, that a chunk sends to a group at least: beyond some ten billion words groups, then chunks grow with the
#: square root of the input, and so do their tasks' memory.
ROW_ENTRIES = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NULL = -(1 << 63)
_SIGN = np.uint64(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts one behind the other, number of words of each text), without splitting them.

    Eight bytes of all words are taken in at a time: words of up to eight bytes and equal length never share a hash.
    """
    raw = np.frombuffer(b"\n".join([b"", *texts, b"\0" * 8]), np.uint8)  # every text lies between white space
    body = raw[:-8]
    space = (body == 32) | (body - np.uint8(9) < 5)
    bounds = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = bounds[::2], bounds[1::2] - bounds[::2]
    eight = np.ndarray(len(body), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = sizes.astype(np.uint64) * _FACTOR
    left, at, which = sizes, starts, None
    for _ in range(LONG_WORD // 8):
        own = eight[at] & mask[np.minimum(left, 8)]
        own ^= h if which is None else h[which]
        if which is None:
            h = _mixed(own)
        else:
            h[which] = _mixed(own)
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        if not len(which):
            break
        left, at = left[more] - 8, at[more] + 8
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + sizes[k]], SEED)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def rolling(words: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A 64-bit hash of every `size` consecutive word hashes."""
    n = max(0, len(words) - size + 1)
    out = words[:n].copy()
    for k in range(1, size):
        out *= factor
        out += words[k : k + n]
    return _mixed(out)


def _packed(a: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned integers."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _planes(*columns: np.ndarray) -> bytes:
    """Integer columns byte by byte, compressed: bytes that hardly change cost nothing."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 1)


def _columns(raw: bytes, n: int, count: int) -> list[np.ndarray]:
    b = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(count, 8, n)
    return [np.ascontiguousarray(x.T).reshape(-1).view("<u8") for x in b]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


CHUNKS = T.StructType([T.StructField("part", T.LongType()), T.StructField("n_docs", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("texts", T.BinaryType())])
SENT = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("grp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("more", T.BinaryType())])
ANSWERS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("grp", T.LongType()), T.StructField("bits", T.BinaryType())])


def chunked(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """Documents of a task packed into rows of CHUNKS: compressed texts behind their lengths. A longer document is a chunk of its own."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[int, bytes]] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def row(n_words: int) -> pa.RecordBatch:
            ids = np.array([i for i, _ in held], "<i8").tobytes()
            texts = np.array([len(t) for _, t in held], "<u8").tobytes() + b"".join(t for _, t in held)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([n_words], pa.int64()), pa.array([ids], pa.binary()), pa.array([zstandard.compress(texts, 3)], pa.binary())], names=CHUNKS.names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                held.append((_NULL if i is None else i, text))
                size += len(text) // 6 + 1
                if size >= most:
                    yield row(size)
                    held, size, number = [], 0, number + 1
        if held:
            yield row(size)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's words and what it sends; the same each time it is unpacked."""

    def __init__(self, rows: pd.DataFrame, window: int) -> None:
        self.texts: list[bytes] = []
        rows = rows.sort_values("part")
        for n_docs, texts in zip(rows["n_docs"], rows["texts"], strict=True):
            raw = zstandard.decompress(texts)
            sizes = np.frombuffer(raw[: 8 * n_docs], "<u8").astype(np.int64)
            ends = 8 * n_docs + np.cumsum(sizes)
            self.texts += [raw[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        self.ids = np.frombuffer(b"".join(rows["ids"]), "<i8")
        order = np.argsort(self.ids, kind="stable")  # windows then come in the order of their places
        self.ids, self.texts = self.ids[order], [self.texts[i] for i in order.tolist()]
        self.words, self.lengths = word_hashes(self.texts)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.window, self.block = window, window // 2
        self.halves = rolling(self.words, self.block, _FACTOR)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, first word within it) of every window of `size` words."""
        n = np.maximum(self.lengths - size + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return doc, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes by value, whether one is a block, whether it is sent)."""
        doc, at = self.windows(self.block)
        h = self.halves[self.starts[doc] + at]
        own, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        is_block = np.zeros(len(own), bool)
        is_block[inverse[at % self.block == 0]] = True
        self.inverse, self.twice = inverse, count > 1
        return own, is_block, is_block | ~self.twice

    def candidates(self, hit: np.ndarray) -> None:
        """Windows that hold a hit; equal ones as one, the earliest, in order of their hashes."""
        doc, at = self.windows(self.block)
        held = np.zeros(len(self.words) + 1, np.int64)
        held[1:][(self.starts[doc] + at)[hit]] = 1
        held = np.cumsum(held)
        doc, at = self.windows(self.window)
        first = self.starts[doc] + at
        near = held[first + self.window - self.block + 1] > held[first]
        doc, at, first = doc[near], at[near], first[near]
        # A window by the hashes of its halves, mixed in two ways.
        one, two = self.halves[first], self.halves[first + self.block]
        high, low = _mixed(one * _FACTOR + two), _mixed(two * _FACTOR + one) & np.uint64(0xFFFFFFFF)
        where = self.ids[doc].view(np.uint64) ^ _SIGN
        # Equal ones stay in the order of their places, which is that of the documents unless ids repeat.
        order = np.argsort(high, kind="stable") if (self.ids[1:] != self.ids[:-1]).all() else np.lexsort((at, where, high))
        self.first, high, low, where, at = first[order], high[order], low[order], where[order], at[order].astype(np.uint64)
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        self.which = np.cumsum(new) - 1
        lead = np.flatnonzero(new)[self.which] if len(order) else self.which
        self.later = (where > where[lead]) | (at > at[lead])  # places are sorted, so later in either is later
        self.high, self.low, self.where, self.at = high[new], low[new], where[new], at[new]


def _by_group(h: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    grp = (h % np.uint64(groups)).astype(np.uint16 if groups <= 1 << 16 else np.int64)  # short integers sort by radix
    order = np.argsort(grp, kind="stable")
    for part in np.split(order, np.flatnonzero(grp[order][1:] != grp[order][:-1]) + 1):
        if len(part):
            yield int(grp[part[0]]), part


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names)


def _sent_anchors(chunk: int, c: Chunk, groups: int) -> list[tuple]:
    own, is_block, sent = c.anchors()
    at = np.flatnonzero(sent)
    return [(chunk, g, len(p), _packed(own[at[p]] // np.uint64(groups), 4), _bits(is_block[at[p]])) for g, p in _by_group(own[at], groups)]


def _hits(c: Chunk, answers: dict[int, bytes], groups: int) -> np.ndarray:
    """Which anchors are hits: those found elsewhere by the groups' answers, and those found twice in the chunk."""
    own, _, sent = c.anchors()
    at, got = np.flatnonzero(sent), c.twice.copy()
    for g, p in _by_group(own[at], groups):
        if g in answers:
            got[at[p]] |= _flags(answers[g], len(p))
    return got[c.inverse]


def _meet_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """A probe is a hit if another entry is a block of the same hash."""
    key = np.concatenate([_unpacked(x, 4) for x in pdf["hashes"]])
    block = np.concatenate([_flags(x, n) for x, n in zip(pdf["more"], pdf["n"], strict=True)])
    indexed, count = np.unique(key[block], return_counts=True)
    at = np.minimum(np.searchsorted(indexed, key), max(0, len(indexed) - 1))
    hit = (np.where(indexed[at] == key, count[at], 0) - block > 0) if len(indexed) else np.zeros(len(key), bool)
    return _answered(pdf, hit)


def _meet_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """A window is repeated if an equal one starts earlier: at a smaller (document, word). A chunk's own state passes."""
    if pdf["grp"].iloc[0] < 0:
        return _frame(list(zip(pdf["chunk"], pdf["grp"], pdf["more"], strict=True)), ANSWERS)
    high = np.concatenate([_unpacked(x[: 5 * n], 5) for x, n in zip(pdf["hashes"], pdf["n"], strict=True)])
    low = np.concatenate([_unpacked(x[5 * n :], 4) for x, n in zip(pdf["hashes"], pdf["n"], strict=True)])
    places = [_columns(x, n, 2) for x, n in zip(pdf["more"], pdf["n"], strict=True)]
    where, at = (np.concatenate([p[k] for p in places]) for k in (0, 1))
    order = np.lexsort((at, where, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(order), bool)
    later[order] = (where[order] > where[lead]) | (at[order] > at[lead])
    return _answered(pdf, later)


def _answered(pdf: pd.DataFrame, flags: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(pdf["n"].to_numpy())
    rows = [(c, g, _bits(flags[b - n : b])) for c, g, n, b in zip(pdf["chunk"], pdf["grp"], pdf["n"], ends, strict=True) if flags[b - n : b].any()]
    return _frame(rows, ANSWERS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS, group_words: int = GROUP_WORDS, row_entries: int = ROW_ENTRIES, with_text: bool = False) -> DataFrame:
    """One row for each document: id_col (long), n_words, n_removed, kept_sha256 (of the kept words, joined by a space) and, if asked for, kept_text.

    A word is removed if a window of `window` (even) consecutive words covers it whose words also start earlier: in a
    document with a smaller id, or in the same one before. Windows are judged on the input. A null text has no words. Null
    ids come before all others; rows that share an id are one document's copies: of windows at the same word of them
    neither is earlier. An empty table gives an empty result; other columns are ignored. Windows are compared by 72 bits
    of their hashes and those that the group implies: fewer than 0.01 false matches are expected at 100 TB.
    """
    table = written(chunked(docs, id_col, text_col, chunk_words), "chunks")
    total, n_chunks = table.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    side = int((row_entries * total) ** 0.5)
    groups, parts = max(1, -(-total // max(group_words, side))), max(1, -(-side // chunk_words))
    # Neighbours of a task's parts make a chunk.
    table = table.withColumn("chunk", F.expr(f"shiftleft(shiftright(part, 32), 32) + (part & 4294967295L) div {parts}"))
    n_chunks = -(-n_chunks // parts)
    # Few chunks and groups for each task, as many tasks as that takes.
    by_chunk = lambda df: df.repartition(min(MOST_TASKS, max(1, n_chunks // 2)), "chunk").groupBy("chunk")
    by_group = lambda df: df.repartition(min(MOST_TASKS, groups), "grp").groupBy("grp")

    def send(chunk: int, rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(_sent_anchors(chunk, Chunk(rows, window), groups), SENT).astype({"n": "int32"})

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pandas()
                if len(out := send(int(row["chunk"].iloc[0]), row)):
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    # A chunk of one part is sent from where it is.
    first = table.mapInArrow(anchors, SENT) if parts == 1 else by_chunk(table).applyInPandas(lambda key, rows: send(key[0], rows), SENT)
    found = written(by_group(first).applyInPandas(_meet_anchors, ANSWERS), "anchors")
    none = _frame([], SENT)

    def extend(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return none
        c = Chunk(left, window)
        hit = _hits(c, dict(zip(right["grp"], right["bits"], strict=True)), groups)
        c.candidates(hit)
        # The hits go along, in a group of their own, so that the last step needn't find them again.
        rows = [(key[0], -1 - key[0], len(hit), b"", zstandard.compress(_bits(hit), 1))] if len(c.high) else []
        rows += [(key[0], g, len(p), _packed(c.high[p] // np.uint64(groups), 5) + _packed(c.low[p], 4), _planes(c.where[p], c.at[p])) for g, p in _by_group(c.high, groups)]
        return _frame(rows, SENT)

    sent = by_chunk(table).cogroup(by_chunk(found)).applyInPandas(extend, SENT)
    later = written(by_group(sent).applyInPandas(_meet_windows, ANSWERS), "repeats")
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType())] * with_text)

    def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return _frame([], schema)
        c = Chunk(left, window)
        answers = dict(zip(right["grp"], right["bits"], strict=True))
        state = answers.pop(-1 - key[0], None)
        n = int(np.maximum(c.lengths - c.block + 1, 0).sum())
        c.candidates(_flags(zstandard.decompress(state), n) if state is not None else np.zeros(n, bool))
        got = np.zeros(len(c.high), bool)
        for g, p in _by_group(c.high, groups):
            if g in answers:
                got[p] = _flags(answers[g], len(p))
        first = c.first[c.later | got[c.which]]
        change = np.zeros(len(c.words) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + window, -1)
        gone = np.cumsum(change)[:-1] > 0
        rows = []
        for i, text, a, n in zip(c.ids.tolist(), c.texts, c.starts.tolist(), c.lengths.tolist(), strict=True):
            out, words = gone[a : a + n], text.split()
            if removed := int(out.sum()):
                words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
            kept = b" ".join(words)
            rows.append((None if i == _NULL else i, n, removed, hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
        out = _frame(rows, schema)
        out[id_col] = pd.array([r[0] for r in rows], dtype="Int64")
        return out

    return by_chunk(table).cogroup(by_chunk(later)).applyInPandas(finish, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents, production parameters."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same by definition, for DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), g AS (
  SELECT doc_id, i, CASE WHEN i + 19 <= n THEN sha256(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) END AS h, word
  FROM w
), f AS (
  SELECT h, min((doc_id, i)) AS first FROM g WHERE h IS NOT NULL GROUP BY h
), late AS (
  SELECT g.doc_id, g.i, g.word, CASE WHEN f.first < (g.doc_id, g.i) THEN 1 ELSE 0 END AS late FROM g LEFT JOIN f ON g.h = f.h
), cover AS (
  SELECT doc_id, i, word, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM late
)
SELECT d.doc_id, count(c.word) AS n_words, coalesce(sum(c.gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (WHERE c.gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN cover c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""
