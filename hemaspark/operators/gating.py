"""Gates: polygons on two channels as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, gate_first, gate_last, inside, num


def label_gates(df: DataFrame, gates: dict[str, list], x: str, y: str, priority: str = "first", name: str = "gate") -> DataFrame:
    """Adds the gate of each row: the first that holds it by name (null outside), or the last by number (-1 outside)."""
    f = {"first": gate_first, "last": gate_last}[priority]
    return df.withColumn(name, f(c(x), c(y), gates))


def label_all_gates(df: DataFrame, gates: dict[str, tuple[str, str, list]], name: str = "gate") -> DataFrame:
    """As label_gates by first, for gates with axes of their own: {gate: (x, y, polygon)}; gates whose axes are missing are left out."""
    fits = [F.when(inside(c(x), c(y), p), F.lit(g)) for g, (x, y, p) in gates.items() if x in df.columns and y in df.columns and len(p) >= 3]
    return df.withColumn(name, F.coalesce(*fits) if fits else F.lit(None).cast("string"))


def in_gate(df: DataFrame, polygon: list, x: str, y: str) -> DataFrame:
    return df.where(inside(c(x), c(y), polygon))


def gate_counts(df: DataFrame, gate: str = "gate", by: list[str] | None = None) -> DataFrame:
    """(by..., gate, n, proportion) in one aggregate; proportions of all rows of the same `by`."""
    keys = by or []
    counts = df.groupBy(*[c(k) for k in keys], c(gate)).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*[c(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))  # over a row for each gate
    return counts.withColumn("proportion", F.col("n") / F.sum("n").over(whole))


def gate_gaussians(df: DataFrame, columns: list[str], gate: str = "gate", by: list[str] | None = None, least: int = 10, reg: float = 1e-6, low: float = 0, high: float = 255) -> DataFrame:
    """(by..., gate, n, mean_<c>, cov_<a>_<b>): count of all rows, mean and covariance (population, `reg` on the diagonal) of
    rows off the ends of the scale. Gates with fewer than `least` such rows have -1 everywhere. One aggregate for all."""
    keys = [*(by or []), gate]
    fine = reduce(lambda a, b: a & b, [(c(n) != low) & (c(n) != high) for n in columns])
    v = {n: F.when(fine, num(df, n)) for n in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    stats = df.where(c(gate).isNotNull()).groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.count_if(fine).alias("_u"), *[F.avg(v[n]).alias(f"mean_{n}") for n in columns], *[F.covar_pop(v[a], v[b]).alias(f"cov_{a}_{b}") for a, b in pairs])
    few = F.col("_u") < least
    minus = F.lit(-1.0)
    return stats.select(*[c(k) for k in keys], "n", *[F.when(few, minus).otherwise(F.col(f"`mean_{n}`")).alias(f"mean_{n}") for n in columns], *[F.when(few, minus).otherwise(F.col(f"`cov_{a}_{b}`") + (reg if a == b else 0.0)).alias(f"cov_{a}_{b}") for a, b in pairs])


def component_coverage(means: DataFrame, gates: dict[str, list], x: str, y: str, weight: str) -> DataFrame:
    """(gate, n_components, weight): mixture components whose mean is in a gate."""
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.when(inside(c(x), c(y), p), 1).otherwise(0).alias("hit")) for g, p in gates.items()])).alias("r")
    return means.select(c(weight).alias("w"), rows).select("w", "r.*").groupBy("gate").agg(F.sum("hit").alias("n_components"), F.sum(F.col("w") * F.col("hit")).alias("weight"))
