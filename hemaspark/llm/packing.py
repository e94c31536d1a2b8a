"""Best-fit packing of token pieces into sequences under several capacities (vector best-fit)."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEQUENCE = 1024
GROUP = 8192
#: Rows that are alike and that one task makes of one.
ALIKE = 4096

#: Letters on whose classes all Unicode versions of the tokenizer libraries agree.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞€]*")
_LONG_WORD = re.compile(r"\S{2000}")


@functools.cache
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


@functools.cache
def _special(name: str) -> re.Pattern[str] | None:
    """Strings in a text that the tokenizer file turns into ids of their own."""
    strings = [t.content for t in _tokenizer(name).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, strings))) if strings else None


@functools.cache
def _ranks(name: str):
    """The same vocabulary as ranks for a faster encoder, or None where there is none."""
    if name != TOKENIZER:
        return None
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, name: str = TOKENIZER) -> np.ndarray:
    """Ids of a text. Plain texts go through the rank encoder, which yields the same ids some four times as fast;
    texts with other letters, very long words or special tokens' strings go through the tokenizer file itself."""
    ranks, special = _ranks(name), _special(name)
    if ranks is not None and (text.isascii() or _PLAIN.fullmatch(text)) and not _LONG_WORD.search(text) and not (special and special.search(text)):
        return np.asarray(ranks.encode_ordinary(text), dtype="<u4")
    return np.asarray(_tokenizer(name).encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of at most `limit`.

    Only longer documents are cut, into pieces of `limit` ids of which the first may be shorter. Returns id_col, piece
    (int from 0), start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and, if asked for, ids. A null text
    counts as empty: one piece that holds the end id. Null and repeated ids are kept row by row; other columns are
    ignored. Texts are read whole, one at a time.
    """
    bound_arrow(docs.sparkSession)
    fields = [T.StructField("_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            source: list[int] = []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or "", tokenizer), np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[a:b]
                    rows.append((k, a, b - a, zlib.crc32(part.tobytes())) + ((part.astype("i4"),) if with_ids else ()))
                    source.append(i)
            if rows:
                columns = [batch.column(0).take(pa.array(source, pa.int64()))]
                for values, kind in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=False):
                    columns.append(pa.array(list(values), kind))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, T.StructType(fields)).withColumnRenamed("_id", id_col)


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item, items taken in the order given.

    sizes: items x dimensions; an item goes to an open bin that holds it in every dimension, by the least weighted
    norm of what is left (rule "norm") or the greatest weighted dot-product of item and room (rule "dot"); ties go to
    the oldest bin. An item larger than the capacity raises ValueError.
    """
    if len(sizes) and (sizes > capacity).any():
        raise ValueError("an item exceeds the capacity")
    unit, room_of = sizes / capacity, np.empty((64, len(capacity)))
    label = np.empty(64, np.int64)
    out, n_open, n_bins = np.empty(len(sizes), np.int64), 0, 0
    least = np.minimum.accumulate(unit[::-1], axis=0)[::-1] if len(unit) else unit
    for i, item in enumerate(unit):
        if i % 256 == 0 and n_open:  # bins too full for any item to come are closed
            stay = (room_of[:n_open] >= least[i] - 1e-12).all(axis=1)
            k = int(stay.sum())
            room_of[:k], label[:k], n_open = room_of[:n_open][stay], label[:n_open][stay], k
        room = room_of[:n_open]
        fits = (room >= item - 1e-12).all(axis=1)
        if fits.any():
            if rule == "norm":
                score = np.where(fits, ((room - item) ** 2) @ weights, np.inf)
            else:
                score = np.where(fits, -(room * item) @ weights, np.inf)
            b = int(np.argmin(score))
        else:
            if n_open == len(label):
                room_of, label = np.concatenate([room_of, np.empty_like(room_of)]), np.concatenate([label, np.empty_like(label)])
            b, room_of[n_open], label[n_open] = n_open, 1.0, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        room_of[b] -= item
        out[i] = label[b]
    return out


def pack(pieces: DataFrame, capacity: int = SEQUENCE, max_documents: int = SEQUENCE, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.001, 0.05), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (see token_pieces): vector best-fit, longest pieces first.

    Three capacities hold in every sequence: tokens, number of pieces, and attention cost (the sum of squared lengths;
    by default capacity squared, which the tokens bound anyway). The pieces are dealt by hash to groups of about
    `group` rows, each packed by one task, so that memory doesn't depend on the input; a group costs about one
    sequence that isn't full. Rows that are alike are counted and dealt by their numbers, so they don't meet in one group, and
    the result depends on neither files nor partitions. Sequence ids are unique, not consecutive. A piece beyond a capacity
    raises ValueError. Empty input gives an empty result.
    """
    most = np.array([capacity, max_documents, max_attention or capacity * capacity], float)
    w = np.array(weights, float)
    table = written(pieces, "pieces")
    n_groups = max(1, -(-table.count() // group))
    id_col, names = pieces.columns[0], [F.col(f"`{c}`") for c in pieces.columns]
    facts = [F.col(f"piece.`{c}`") for c in pieces.columns[:5]]
    alike = table.select(F.struct(*names).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    # Numbers of rows that are alike, in two steps: so many copies of one row are made by many tasks.
    alike = alike.select("piece", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {ALIKE}"))).alias("run"))
    alike = alike.repartition(F.xxhash64(*facts, "run"))
    alike = alike.select("piece", F.explode(F.expr(f"sequence(run * {ALIKE}, least(n, (run + 1) * {ALIKE}) - 1)")).alias("number"))
    dealt = alike.select("piece.*", F.pmod(F.xxhash64(*facts, "number"), F.lit(n_groups)).cast("long").alias("_group"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        length = pdf["length"].to_numpy(float)
        bins = best_fit(np.column_stack([length, np.ones(len(pdf)), length * length]), most, w, rule)
        pdf["sequence_id"] = pdf["_group"] * (1 << 32) + bins
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="_group")

    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.repartition(F.col("_group")).groupBy("_group").applyInPandas(place, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents, production parameters."""
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
