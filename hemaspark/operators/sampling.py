"""Samples that depend on keys and a seed only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c
from ..storage import written


def _draw(df: DataFrame, keys: list[str] | None, seed: int) -> list[Column]:
    """An order by hash of the keys (all columns by default), ties by the columns themselves."""
    names = keys or df.columns
    kinds = dict(df.dtypes)
    plain = [c(n) for n in names if not kinds.get(n, "").startswith("map")]
    return [F.xxhash64(F.lit(seed), *plain), *plain]


def exact_sample(df: DataFrame, n: int, keys: list[str] | None = None, seed: int = 0) -> DataFrame:
    """n rows (or all), without replacement: the least hashes. A share of the rows by hash, somewhat larger than n, goes on to be
    ordered, so tasks don't each keep n rows of a large table."""
    rows = df.count()
    if rows > 2 * n:
        share = (n + 10 * (n + 25) ** 0.5) / rows
        df = df.where(F.shiftrightunsigned(_draw(df, keys, seed)[0], 1) <= int(min(1.0, share) * ((1 << 63) - 1)))
    first, *rest = _draw(df, keys, seed)
    return df.orderBy(F.shiftrightunsigned(first, 1), *rest).limit(n)


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds _rank, from 0, by order: a range-partitioned sort, and the sizes of the partitions before."""
    sized = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()}), "ranked")
    counts = sized.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    ahead = counts.select("_p", "_first", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return sized.join(ahead, "_p").withColumn("_rank", F.col("_k") - F.col("_first") + F.col("_ahead")).drop("_p", "_k", "_first", "_ahead")


def quotas(counts: dict[int, int], target: int, least: int, balance: str = "sqrt") -> dict[int, int]:
    """Rows to take of each label: shares by the square root of its size, equal or proportional, at least `least` of
    each gate (label -1 is outside all gates), at most what there is."""
    if balance not in ("sqrt", "equal", "proportional"):
        raise ValueError(f"unknown balance {balance!r}")
    weight = {k: {"sqrt": math.sqrt(n), "equal": 1.0, "proportional": float(n)}[balance] for k, n in counts.items()}
    total = sum(weight.values()) or 1.0
    return {k: min(n, max(int(weight[k] / total * target), 0 if k == -1 else least)) for k, n in counts.items()}


def _first_by_hash(df: DataFrame, label: Column, quota: Column, keys: list[str] | None, seed: int, counts: dict) -> DataFrame:
    """Rows whose hash rank within their label is below the quota.

    Ranks within a label would meet in one task for a label with most rows: a threshold on the hash, with room to
    spare, first leaves little more than the quota, and only that is ranked.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[c(n) for n in keys or df.columns]), 1)
    rows = df.withColumns({"_label": label, "_draw": draw}).withColumn("_quota", quota)
    spare = F.lit(float(1 << 63)) * F.least(F.lit(1.0), (F.col("_quota") + 10 * F.sqrt(F.col("_quota") + 25.0)) / F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(max(n, 1)))])[F.col("_label")])
    near = rows.where((F.col("_quota") > 0) & (F.col("_draw") <= spare))
    window = Window.partitionBy("_label").orderBy("_draw", *[c(n) for n in keys or df.columns])
    return near.withColumn("_rn", F.row_number().over(window)).where("_rn <= _quota").drop("_label", "_draw", "_quota", "_rn")


def stratified_sample(df: DataFrame, label: Column, target: int = 1_000_000, least: int = 50_000, balance: str = "sqrt", keys: list[str] | None = None, seed: int = 0) -> DataFrame:
    """A sample by label (integers; see quotas). Labels are few; their counts are an aggregate."""
    counts = {r["k"]: r["n"] for r in df.groupBy(label.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return df
    q = quotas(counts, target, least, balance)
    quota = F.create_map(*[F.lit(x) for k, n in q.items() for x in (k, n)])[F.col("_label")]
    return _first_by_hash(df, label, quota, keys, seed, counts)


def stratified_split(df: DataFrame, strata: list[str], fraction: float, keys: list[str] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each stratum floor(fraction * size + 0.5) rows are test, by hash rank within the stratum and a hash range, so a
    large stratum is ranked by many tasks."""
    names = keys or df.columns
    rows = df.withColumn("_draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[c(n) for n in names]), 1)).withColumn("_cell", F.shiftrightunsigned("_draw", 55))
    by = [c(s) for s in strata]
    cells = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_k"))
    whole = Window.partitionBy(*by)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_k").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_size", F.sum("_k").over(whole))
    cells = cells.toDF(*[f"_s{i}" for i in range(len(strata))], "_c", "_k", "_ahead", "_size")
    inner = Window.partitionBy(*by, "_cell").orderBy("_draw", *[c(n) for n in names])
    on = F.col("_cell") == F.col("_c")
    for i, s in enumerate(strata):
        on = on & c(s).eqNullSafe(F.col(f"_s{i}"))
    ranked = rows.withColumn("_rn", F.row_number().over(inner)).join(cells, on).withColumn("_test", F.col("_ahead") + F.col("_rn") <= F.floor(F.col("_size") * fraction + 0.5))
    return tuple(ranked.where(F.col("_test") == t).select(*[c(n) for n in df.columns]) for t in (False, True))
