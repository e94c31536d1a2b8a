"""Transport of event tables and histograms between mixtures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import affine, all_of, argmax, c, clip, digest_uniform, gaussian_log_density, num
from . import gmm
from .arrow import map_arrow

BINS = 128


def transport_max(df: DataFrame, columns: list[str], t: gmm.Transport) -> DataFrame:
    """Method max as Catalyst arithmetic: most probable component, its greatest target, affine map, clip. Rows with a null channel stay as they are."""
    x = [num(df, n) for n in columns]
    scores = [gaussian_log_density(x, t.source.means[k], t.source.covariances[k]) + F.lit(float(np.log(max(t.source.weights[k], 1e-300)))) for k in range(t.source.k)]
    return _mapped(df, columns, x, scores, lambda k: [(int(t.omega[k].argmax()), 1.0)], t)


def _shares(t: gmm.Transport, threshold: float) -> list[list[tuple[int, float]]]:
    """For each source component its targets with at least `threshold`, or else the greatest, and their shares."""
    out = []
    for row in t.omega:
        at = np.flatnonzero(row >= threshold)
        at = at if len(at) else [int(row.argmax())]
        total = sum(row[j] for j in at)
        out.append([(int(j), float(row[j] / total)) if total else (int(j), 1.0 / len(at)) for j in at])
    return out


def transport_weight(df: DataFrame, columns: list[str], t: gmm.Transport, threshold: float = 0.05, rare: float | None = None, u: Column | None = None) -> DataFrame:
    """Method weight as Catalyst arithmetic. With `rare`, points that no component is that dense at go to one target by u."""
    x = [num(df, n) for n in columns]
    scores = [gaussian_log_density(x, t.source.means[k], t.source.covariances[k]) for k in range(t.source.k)]
    shares = _shares(t, threshold)
    if rare is None:
        return _mapped(df, columns, x, scores, lambda k: shares[k], t)
    known = df.columns
    df = df.withColumn("_rare", F.when(F.exp(F.greatest(*scores) if len(scores) > 1 else scores[0]) < rare, u))
    return _mapped(df, columns, x, scores, lambda k: shares[k], t, lambda i: _one(x, t, shares, i, F.col("_rare"), F.col("_rare").isNotNull())).select(*[c(n) for n in known])


def _one(x: list[Column], t: gmm.Transport, shares: list[list[tuple[int, float]]], i: Column, r: Column, when: Column | None = None) -> list[Column]:
    """The points moved by the map of source component i to the target that r, a number in [0, 1), is in by the shares of i."""
    d = len(x)
    pairs = [(k, j) for k, row in enumerate(shares) for j, _ in row]
    first = np.cumsum([0, *[len(row) for row in shares[:-1]]])
    ends = [np.cumsum([w for _, w in row]).tolist() for row in shares]
    maps = [[*t.maps[k, j].ravel().tolist(), *(t.target.means[j] - t.maps[k, j] @ t.source.means[k]).tolist()] for k, j in pairs]
    const = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  folded to one literal
    row = F.get(const(ends, "array<array<double>>"), i)
    at = F.get(const(first.tolist(), "array<int>"), i) + F.least(F.size(F.filter(row, lambda e: e <= r)), F.size(row) - 1)
    own = F.get(const(maps, "array<array<double>>"), at)
    own = own if when is None else F.when(when, own)
    return [sum((F.get(own, F.lit(a * d + b)) * x[b] for b in range(1, d)), F.get(own, F.lit(a * d)) * x[0]) + F.get(own, F.lit(d * d + a)) for a in range(d)]


def transport_rand(df: DataFrame, columns: list[str], t: gmm.Transport, u: Column) -> DataFrame:
    """Method rand as Catalyst expressions: a pair of components at random by its probability at the point, u in [0, 1) for each.

    The pairs' probabilities are densities of source components times the plan's rows; u is looked up in their running sum, which is a fold
    over the source components and then over the targets of the one that is found. The plan of an optimal transport has at most
    as many targets as there are components on both sides, so its maps are a small constant.
    """
    x = [num(df, n) for n in columns]
    rows = t.omega.sum(axis=1)
    keep = [k for k in range(t.source.k) if rows[k] > 0]
    scores = [gaussian_log_density(x, t.source.means[k], t.source.covariances[k]) + F.lit(float(np.log(rows[k]))) for k in keep]
    shares = [[(int(j), float(t.omega[k, j] / rows[k])) for j in np.flatnonzero(t.omega[k] > 0)] if rows[k] > 0 else [(0, 1.0)] for k in range(t.source.k)]
    fine = all_of([v.isNotNull() for v in x])
    names = df.columns
    staged = df.withColumns({"_u": u, "_s": F.when(fine, F.array(*scores))})
    staged = staged.withColumn("_top", F.array_max("_s")).withColumn("_s", F.transform("_s", lambda s: F.exp(s - F.col("_top"))))
    staged = staged.withColumn("_u", F.col("_u") * F.aggregate("_s", F.lit(0.0), lambda a, s: a + s))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("next"), F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("rest"))

    def fold(a: Column, s: Column) -> Column:
        """The first component whose running sum exceeds u (the last, if rounding leaves none), and how far u is in it."""
        open_ = a["at"].isNull()
        here = open_ & ((a["sum"] + s > F.col("_u")) | (a["next"] == len(keep) - 1))
        return F.struct((a["sum"] + s).alias("sum"), (a["next"] + 1).alias("next"), F.when(here, a["next"]).otherwise(a["at"]).alias("at"), F.when(here, F.when(s > 0, (F.col("_u") - a["sum"]) / s).otherwise(0.0)).otherwise(a["rest"]).alias("rest"))

    staged = staged.withColumn("_f", F.when(F.col("_s").isNotNull(), F.aggregate("_s", start, fold)))
    i = F.get(F.array(*[F.lit(k) for k in keep]), F.col("_f.at"))
    moved = _one(x, t, shares, i, F.col("_f.rest"))
    out = {n: F.when(F.col("_f").isNotNull(), clip(moved[a])).otherwise(x[a]) for a, n in enumerate(columns)}
    return staged.select(*[out[n].alias(n) if n in out else c(n) for n in names])


def _mapped(df, columns, x, scores, shares, t, other=None) -> DataFrame:
    """One projection decides the component, a second one applies its (averaged, so again affine) map. other: a function of the
    component that says where points go instead, null for those that don't."""
    staged = df.withColumn("_k", F.when(all_of([v.isNotNull() for v in x]), argmax(scores)))
    out = {}
    maps = []
    for k in range(t.source.k):
        a = sum(w * t.maps[k, j] for j, w in shares(k))
        b = sum(w * (t.target.means[j] - t.maps[k, j] @ t.source.means[k]) for j, w in shares(k))
        maps.append(affine(x, np.zeros(len(columns)), b, a))
    instead = other(F.col("_k")) if other else None
    for i, n in enumerate(columns):
        value = F.coalesce(*([clip(instead[i])] if instead else []), *[F.when(F.col("_k") == k, clip(maps[k][i])) for k in range(t.source.k)], x[i])
        out[n] = value
    return staged.select(*[out[n].alias(n) if n in out else c(n) for n in df.columns])


def transport_events(df: DataFrame, columns: list[str], t: gmm.Transport, method: str = "rand", threshold: float = 0.05, preserve_rare: bool = True, rare: float = 0.01, keys: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Any method, as Catalyst expressions: rows stay in place, no Python runs. Chance comes from an MD5 of the seed and `keys` (all
    columns by default), so results don't depend on partitions; rows with a null channel are unchanged."""
    u = digest_uniform(*[c(n) for n in keys or df.columns], seed=seed)
    if method == "max":
        return transport_max(df, columns, t)
    if method == "weight":
        return transport_weight(df, columns, t, threshold, rare if preserve_rare else None, u)
    if method == "rand":
        return transport_rand(df, columns, t, u)
    raise ValueError(f"unknown method {method!r}")


def validate(source: DataFrame, target: DataFrame, moved: DataFrame, columns: list[str], model: gmm.Mixture) -> dict:
    """Wasserstein distances of all three pairs by column, and mean log-likelihoods under the target's mixture."""
    from .stats import ecdf_distances

    def mean(df: DataFrame) -> float:
        x = [num(df, n) for n in columns]
        parts = [F.exp(gaussian_log_density(x, model.means[k], model.covariances[k])) * float(model.weights[k]) for k in range(model.k)]
        return df.agg(F.avg(F.log(F.greatest(sum(parts[1:], parts[0]), F.lit(1e-300))))).first()[0]

    out = {f"mean_{k}_likelihood": mean(df) for k, df in (("source", source), ("target", target), ("transformed", moved))}
    for k, (a, b) in {"source_transformed": (source, moved), "source_target": (source, target), "transformed_target": (moved, target)}.items():
        found = {r["column"]: r["wasserstein"] for r in ecdf_distances(a, b, columns).collect()}
        out[f"wasserstein_{k}"] = [found.get(n) for n in columns]
    return out | {"likelihood_improvement": out["mean_transformed_likelihood"] - out["mean_source_likelihood"]}


def histogram_columns(df: DataFrame, prefix: str) -> list[str]:
    return [n for n in df.columns if f"{prefix}_RAW_" in n]


def histogram_sum(df: DataFrame, prefix: str) -> DataFrame:
    """(bin, count): the bins of all rows added, in one aggregate."""
    names = histogram_columns(df, prefix)
    wide = df.agg(*[F.coalesce(F.sum(num(df, n)), F.lit(0.0)).alias(f"_{i}") for i, n in enumerate(names)])
    return wide.select(F.posexplode(F.array(*[F.col(f"_{i}") for i in range(len(names))])).alias("bin", "count"))


def histogram_mean(df: DataFrame, prefix: str) -> DataFrame:
    names = histogram_columns(df, prefix)
    wide = df.agg(*[F.avg(num(df, n)).alias(f"_{i}") for i, n in enumerate(names)])
    return wide.select(F.posexplode(F.array(*[F.col(f"_{i}") for i in range(len(names))])).alias("bin", "count"))


def rebin(df: DataFrame, value: str, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(by..., bin, n): unit bins centred on 0 to bins - 1; the last is closed on the right; what is outside isn't counted."""
    keys = by or []
    x = num(df, value)
    rows = df.where(x.between(-0.5, bins - 0.5)).withColumn("bin", F.least(F.floor(x + 0.5), F.lit(bins - 1)).cast("int"))
    return rows.groupBy(*[c(k) for k in keys], "bin").agg(F.count(F.lit(1)).alias("n"))


def weighted_bins(counts: np.ndarray, most: int, log: bool) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights) of a histogram, scaled down to `most` points in all: fractional weights, of which random rounding is
    the sampled version."""
    counts = np.nan_to_num(np.asarray(counts, float))
    x = np.arange(len(counts), dtype=float)
    return (np.log(x + 1) if log else x)[:, None], counts * min(1.0, most / max(counts.sum(), 1e-300))


def rounded_bins(counts: np.ndarray, most: int, u: np.ndarray) -> np.ndarray:
    """Whole counts with the same expectation: the fraction is the chance of one more."""
    scaled = np.nan_to_num(np.asarray(counts, float))
    scaled = scaled * min(1.0, most / max(scaled.sum(), 1e-300))
    return (np.floor(scaled) + (u < scaled - np.floor(scaled))).astype(np.int64)


def transport_histograms(df: DataFrame, prefix: str, t: gmm.Transport, most: int, log: bool, keys: list[str], seed: int = 0) -> DataFrame:
    """Every row's histogram moved point by point (method rand) and binned anew; a row without counts is zeros. Chance is a
    function of `keys` and the seed."""
    names = histogram_columns(df, prefix)
    wide = df.select(*[num(df, n).alias(n) if n in names else c(n) for n in df.columns], F.xxhash64(F.lit(seed), *[c(k) for k in keys]).alias("_h"))
    schema = T.StructType([f for f in wide.schema.fields if f.name != "_h"])
    shared, at, all_names = df.sparkSession.sparkContext.broadcast(t), [df.columns.index(n) for n in names], df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at])
            out = np.zeros_like(x)
            for r, h in enumerate(batch.column(len(all_names)).to_pylist()):
                rng = np.random.default_rng(h & 0xFFFFFFFFFFFFFFFF)
                points = np.repeat(np.arange(len(at), dtype=float), rounded_bins(x[r], most, rng.random(len(at))))
                if len(points):
                    moved = model.apply(np.log(points + 1)[:, None] if log else points[:, None], "rand", rng.random(len(points)))[:, 0]
                    out[r] = np.histogram(np.exp(moved) - 1 if log else moved, np.arange(-0.5, len(at) + 0.5))[0]
            yield pa.RecordBatch.from_arrays([pa.array(out[:, at.index(i)]) if i in at else batch.column(i) for i in range(len(all_names))], names=all_names)

    return map_arrow(wide, run, schema)
