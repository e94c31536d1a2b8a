"""What several operators share: words, written tables in the shared folder, batches of documents, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, shared_dir, written

__all__ = ["bound_arrow", "components", "n_words", "rows_of", "shared_dir", "trimmed", "words", "written"]

#: White space between words: space and U+0009 to U+000D (bytes.split() splits at the same six).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def bound_arrow(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that a batch of long documents fits into a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def trimmed(text: str | Column) -> Column:
    """A text without white space at its ends; null becomes empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))


def words(text: str | Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def n_words(text: str | Column) -> Column:
    """The number of words (long), without keeping them."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, th): whole rows of docs as a struct, so that no name of theirs can clash, and what tells them apart: their id
    and xxhash64 of their text. `select("row.*")` gives the rows back."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*quoted).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node reachable.

    nodes: a column `node` (long, distinct); edges: `a`, `b` (long). Nodes without edges are their own component.
    Alternates large-star and small-star steps; each round is two shuffles over the edges that are left, is written to
    the shared folder (a lost executor repeats one round), and the number of rounds grows with the logarithm of the
    longest path. A node with very many neighbours is no hot key: the steps need the minimum of each
    neighbourhood, which is aggregated before the shuffle, and the join that carries it back can be split by AQE.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        # large-star: each larger neighbour of a node goes to the least of the node and its neighbours
        sym = both(edges)
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small-star: each smaller neighbour, and the node, go to the least neighbour
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        old, edges = edges, written(small.distinct(), "edges")
        dropped(old)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: not settled in {rounds} rounds")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
