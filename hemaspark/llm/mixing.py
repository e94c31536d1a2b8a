"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, rows_of, written

SHARE = 1.5
MOST_EPOCHS = 2
CYCLE = (3.0, 1.0, 2.0)
BLOCK = 256
SEED = 20
#: Fractional part of the golden ratio as a fraction of 2**62: slot i stands at (i * STEP mod 2**62) / 2**62.
POINTS = 1 << 62
STEP = (math.isqrt(5 * POINTS * POINTS) - POINTS) // 2 | 1


def source_targets(sizes: DataFrame, share: float = SHARE, epochs: int = MOST_EPOCHS, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from (source, size) rows.

    Sources by code point, null last, weigh as in `cycle`, again and again, and share `share` times all words; a target
    stops at `epochs` times its source's size, and the excess is shared out by weight until none is above. That is one
    level for all sources: target = min(cap, level * weight), found from running sums over the sources by cap/weight.
    The windows run over one row for each source (an aggregate), not over documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weights = F.array(*[F.lit(w) for w in cycle])
    ranked = by.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))))
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    # The level if this source and those with a larger ratio are not at their caps.
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("weight") <= epochs * F.col("source_size"))
    final = filled.withColumn("_level", F.max(F.when(F.col("_open"), F.col("_level"))).over(everything))
    cap = (epochs * F.col("source_size")).cast("double")
    return final.select("source", "source_size", "n_docs", "weight", F.coalesce(F.least(cap, F.col("_level") * F.col("weight")), cap).alias("target"))


def _point(slot: str | Column) -> Column:
    """The golden-ratio point of a slot in [0, 1): exact integer arithmetic in decimals, so that slots far on don't lose digits."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    high, low = F.shiftright(F.lit(STEP), 31), F.lit(STEP & ((1 << 31) - 1))
    # slot * STEP mod 2**62 with slot < 2**31 * 2**31, by halves: every product stays below 2**63
    a, b = F.shiftright(slot, 31), slot.bitwiseAND(F.lit((1 << 31) - 1))
    half = (1 << 31) - 1
    cross = (a.bitwiseAND(F.lit(half)) * low).bitwiseAND(F.lit(half)) + (b * high).bitwiseAND(F.lit(half))
    total = b * low
    upper = (F.shiftright(total, 31) + cross).bitwiseAND(F.lit(half))
    return (F.shiftleft(upper, 31) + total.bitwiseAND(F.lit(half))).cast("double") / F.lit(float(POINTS))


def _key(name: str = "source") -> Column:
    """Null sources are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots of the mix: (slot, source, rank, block, epoch, words).

    Slot i stands at the golden-ratio point frac(i * phi), mapped through the sources' cumulative targets; a source's
    slots are ranked by slot, rank r taking block r mod n_blocks of the source in epoch r div n_blocks. A source gets
    as many slots as its target needs: later ones are dropped, missing ones (a few, the discrepancy) follow at the end,
    and the last one is cut, so that a source's words are its target, rounded down. Ranks come from counts by run of
    slots and a window within the run, so no window holds a whole source.
    """
    spark = targets.sparkSession
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("key"))
    t = targets.withColumn("key", _key()).withColumn("words", F.floor("target").cast("long")).where("words > 0")
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("full", F.floor(F.col("words") / F.col("source_size")).cast("long"))
    t = t.withColumn("quota", F.col("full") * F.col("n_blocks") + F.ceil((F.col("words") - F.col("full") * F.col("source_size")) / block).cast("long"))
    t = t.withColumn("_to", F.sum("quota").over(line)).withColumn("_all", F.sum("quota").over(Window.partitionBy(F.lit(0))))
    t = t.withColumn("_from", (F.col("_to") - F.col("quota")) / F.col("_all")).withColumn("_to", F.col("_to") / F.col("_all"))
    t = written(t.select("key", "source", "source_size", "words", "n_blocks", "quota", "_from", "_to", "_all"), "targets")
    total, n = t.agg(F.coalesce(F.max("_all"), F.lit(0)), F.count("*")).first()
    run, bins = 1 << 14, max(1024, 4 * n)
    # A slot's source by the cumulative targets: an interval join by bins of the unit line. Slots are spread evenly over
    # the bins; Spark broadcasts the intervals only where it finds them small.
    spans = t.select("key", "_from", "_to", F.explode(F.expr(f"sequence(cast(floor(_from * {bins}) as bigint), cast(least(floor(_to * {bins}), {bins} - 1) as bigint))")).alias("bin"))
    slots = spark.range(0, total).select(F.col("id").alias("slot"), _point("id").alias("x"), F.floor(F.col("id") / run).cast("long").alias("run"))
    slots = slots.withColumn("bin", F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)).cast("long"))
    placed = slots.join(spans, (slots["bin"] == spans["bin"]) & (F.col("x") >= F.col("_from")) & (F.col("x") < F.col("_to"))).select("slot", "run", "key")
    counts = placed.groupBy("key", "run").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    ranked = placed.withColumn("in_run", F.row_number().over(Window.partitionBy("key", "run").orderBy("slot")) - 1).join(ahead, ["key", "run"])
    ranked = ranked.select("slot", "key", (F.coalesce("ahead", F.lit(0)) + F.col("in_run")).cast("long").alias("rank"))
    have = counts.groupBy("key").agg(F.sum("n").alias("have"))
    rest = t.join(have, "key", "left").where("quota > coalesce(have, 0)").select("key", F.explode(F.expr("sequence(coalesce(have, 0L), quota - 1)")).alias("rank"))
    rest = rest.select((F.lit(total) + F.col("rank")).alias("slot"), "key", "rank")
    every = ranked.select("slot", "key", "rank").unionByName(rest).join(t, "key").where("rank < quota")
    block_no, epoch = F.pmod(F.col("rank"), F.col("n_blocks")), F.floor(F.col("rank") / F.col("n_blocks")).cast("long")
    left = F.col("words") - epoch * F.col("source_size") - block_no * block
    return every.select("slot", "source", "key", "rank", block_no.alias("block"), epoch.alias("epoch"), F.least(F.lit(block), left, F.col("source_size") - block_no * block).cast("long").alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, epochs: int = MOST_EPOCHS, cycle: tuple[float, ...] = CYCLE, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: id_col, _th (xxhash64 of the text), row_key, size (words; null text: 0), source, source_size, target, taken (words the mix takes of
    the row, repeats counted, never above `epochs` times its size). pieces: slot, rank, epoch, source, id_col, row_key,
    first (word of the document the piece begins at), words: what each slot reads, in order.

    A source's documents lie on a line in hashed order and the line is cut into blocks of `block` words (less where
    all the words are few); slots name blocks. A document's place on the line comes from sums by bucket of the hash and
    a window within the bucket, so a source that holds a third of the rows is spread over many tasks. Rows that repeat
    are told apart by number within (id, text hash). Null sources form the last source; texts without words are in no
    block and have taken = 0; an empty table gives empty results.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("_text"))
    sized = written(sized.withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_text")), "sizes")
    targets = written(source_targets(sized, share, epochs, cycle), "targets")
    stats = targets.agg(F.sum("target").alias("words"), F.count("*").alias("n"), F.sum("n_docs").alias("rows")).first()
    block = max(1, min(block, int((stats["words"] or 0) / (400 * max(1, stats["n"])))))
    buckets = max(1, -(-(stats["rows"] or 0) // 1024))
    line = sized.withColumn("key", _key()).withColumn("bucket", F.pmod(F.shiftright(F.col("_h"), 8), F.lit(buckets)))
    sums = line.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    ahead = sums.select("key", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("key", "bucket").orderBy("_h", "_id", "_text")
    placed = line.withColumn("_in", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.row_number().over(within))
    placed = placed.join(ahead, ["key", "bucket"]).select("_id", F.col("_text").alias("_th"), "source", "key", "size", F.struct("bucket", "_h", "_n").alias("row_key"), (F.col("ahead") + F.col("_in")).alias("at"))
    placed = written(placed, "line")
    slots = written(schedule(targets, block), "schedule")
    parts = placed.where("size > 0").select("*", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    parts = parts.select("_id", "row_key", "key", "block", F.greatest(F.col("block") * block, F.col("at")).alias("lo"), F.least((F.col("block") + 1) * block, F.col("at") + F.col("size")).alias("hi"), "at")
    taken = parts.join(slots, ["key", "block"]).where(F.col("lo") - F.col("block") * block < F.col("words"))
    pieces = taken.select("slot", "rank", "epoch", "source", F.col("_id").alias(id_col), "row_key", "key", (F.col("lo") - F.col("at")).alias("first"), (F.least(F.col("hi"), F.col("block") * block + F.col("words")) - F.col("lo")).alias("words"))
    per_row = pieces.groupBy("key", "row_key").agg(F.sum("words").alias("taken"))
    documents = placed.join(per_row, ["key", "row_key"], "left").join(targets.withColumn("key", _key()).select("key", "source_size", "target"), "key")
    return documents.select(F.col("_id").alias(id_col), "_th", "row_key", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")), pieces.drop("key")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them: words taken by size, rounded, so whole documents go on; slots, which order
    pieces of documents, are for who reads the pieces of `mix`. Rows that are not taken go; texts
    without words are never taken. Rows that repeat an id and text share what is taken of them evenly."""
    rows, _ = mix(docs, id_col, text_col, source_col)
    share = rows.where("size > 0").groupBy(F.col(id_col).alias("_id"), "_th").agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int").alias("copies")).where("copies > 0")
    every = rows_of(docs, id_col, text_col).join(share, F.expr("id <=> _id and th = _th"))
    return every.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents, production parameters."""
    rows, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")
