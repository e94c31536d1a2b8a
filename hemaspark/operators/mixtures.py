"""Mixtures fitted on all rows: expectation-maximisation whose rounds are aggregates on the cluster."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import num
from ..storage import dropped, written
from .arrow import map_arrow
from .gmm import REG, Mixture, constrained

#: Rows of a batch that are looked at together.
TOGETHER = 4096
SUMS = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("component", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])


def features(x: np.ndarray) -> np.ndarray:
    """1, all x, all products x_i x_j with i <= j: log-densities are linear in them, and their sums are all that a round needs."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def density_weights(m: Mixture, centre: np.ndarray) -> np.ndarray:
    """W with features(x - centre) @ W = log(weight * density) of each component."""
    d = len(centre)
    i, j = np.triu_indices(d)
    out = np.empty((1 + d + len(i), m.k))
    for k in range(m.k):
        precision, (_, logdet) = np.linalg.inv(m.covariances[k]), np.linalg.slogdet(m.covariances[k])
        mean = m.means[k] - centre
        out[0, k] = np.log(max(m.weights[k], 1e-300)) - 0.5 * (d * np.log(2 * np.pi) + logdet + mean @ precision @ mean)
        out[1 : 1 + d, k] = precision @ mean
        out[1 + d :, k] = -0.5 * precision[i, j] * np.where(i == j, 1, 2)
    return out


def expectation(df: DataFrame, columns: list[str], models: list[Mixture], centre: np.ndarray | None = None, weight: str | None = None) -> DataFrame:
    """(model, component, sums): sums over all rows of posterior * features(x - centre), in one pass for all models; the component -1
    has (weighted log-likelihood, weight). Rows with a null column count nowhere.

    Each task adds its own rows up and sends a row for each component; those are added by component.
    """
    d = len(columns)
    centre = np.zeros(d) if centre is None else np.asarray(centre, float)
    planes = [density_weights(m, centre) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ends, rows = [np.zeros((w.shape[1], len(w))) for w in planes], [np.zeros(2) for _ in planes], 0
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if batch.num_rows else np.zeros((0, d + 1))
            data = data[~np.isnan(data).any(axis=1)]
            rows += len(data)
            for a in range(0, len(data), TOGETHER):
                part, own = features(data[a : a + TOGETHER, :d] - centre), data[a : a + TOGETHER, d]
                for w, s, e in zip(planes, sums, ends, strict=True):
                    log = part @ w
                    top = log.max(axis=1, keepdims=True)
                    r = np.exp(log - top)
                    total = r.sum(axis=1, keepdims=True)
                    e += [own @ (top + np.log(total))[:, 0], own.sum()]
                    s += (r * (own[:, None] / total)).T @ part
        if rows:
            out = [(i, k, x) for i, (s, e) in enumerate(zip(sums, ends, strict=True)) for k, x in [(-1, e), *enumerate(s)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2].tolist() for r in out], pa.list_(pa.float64()))], names=SUMS.names)

    wide = df.select(*[num(df, n).alias(f"x{i}") for i, n in enumerate(columns)], (num(df, weight) if weight else F.lit(1.0)).alias("w"))
    size = 1 + d + d * (d + 1) // 2
    parts = map_arrow(wide, run, SUMS).groupBy("model", "component")
    added = parts.agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)])
    every = F.array(*[F.col(f"s{i}") for i in range(size)])
    return added.select("model", "component", F.when(F.col("component") < 0, F.slice(every, 1, 2)).otherwise(every).alias("sums"))


def maximisation(sums: np.ndarray, centre: np.ndarray, base: np.ndarray, covariance: str = "full", reg: float = REG) -> Mixture:
    """The mixture of a round's sums, a row for each component. base: the covariance of components that have nothing."""
    d = len(centre)
    i, j = np.triu_indices(d)
    n = sums[:, 0] + 1e-12
    means = sums[:, 1 : 1 + d] / n[:, None]
    cov = np.empty((len(n), d, d))
    for k in range(len(n)):
        if n[k] > 1e-9:
            cov[k][i, j] = cov[k][j, i] = sums[k, 1 + d :] / n[k]
            cov[k] -= np.outer(means[k], means[k])
        else:
            cov[k] = base
    weights = n / n.sum()
    return Mixture(weights, means + centre, constrained(cov, covariance, weights) + reg * np.eye(d))


def moments(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(weight, mean, covariance) of all complete rows."""
    d = len(columns)
    x = [num(df, n) for n in columns]
    w = num(df, weight) if weight else F.lit(1.0)
    fine = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], w.alias("w")).dropna()
    row = fine.agg(F.sum("w").alias("n"), *[(F.sum(F.col("w") * F.col(f"x{i}")) / F.sum("w")).alias(f"m{i}") for i in range(d)]).first()
    if not row["n"]:
        raise ValueError("no complete rows")
    mean = np.array([row[f"m{i}"] for i in range(d)])
    part = [F.sum(F.col("w") * (F.col(f"x{i}") - mean[i]) * (F.col(f"x{j}") - mean[j])).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    second = fine.agg(*part).first()
    cov = np.array([[second[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / row["n"]
    return float(row["n"]), mean, cov


class Rounds:
    """The state of each round as a row of JSON in a folder that all machines reach, so that fitting goes on where it was."""

    def __init__(self, df: DataFrame, folder: str | None) -> None:
        self.spark, self.folder = df.sparkSession, folder

    def last(self) -> dict | None:
        if not self.folder:
            return None
        try:
            row = self.spark.read.schema("round int, state string").json(self.folder).orderBy(F.desc("round")).first()
        except AnalysisException:  # no folder yet
            return None
        return json.loads(row["state"]) if row else None

    def save(self, number: int, state: dict) -> None:
        if self.folder:
            self.spark.createDataFrame([(number, json.dumps(state))], "round int, state string").coalesce(1).write.mode("append").json(self.folder)


def fit(df: DataFrame, columns: list[str], starts: list[Mixture], covariance: str = "full", max_iter: int = 200, tol: float = 1e-3, reg: float = REG, weight: str | None = None, folder: str | None = None) -> Mixture:
    """The mixture that expectation-maximisation over all complete rows makes of the best of `starts`.

    Rows are written once, as numbers; a round is one pass over them for all starts that still go on, and one row for each
    component reaches the driver. A start ends when the mean log-likelihood changes by less than `tol` or after max_iter rounds; the
    one with the greatest is the result. With `folder` each round is saved there, and a fit that finds rounds goes on from the last.
    """
    if not starts:
        raise ValueError("a fit needs a mixture to start from")
    plain = [f"x{i}" for i in range(len(columns))]
    rows = written(df.select(*[num(df, n).alias(x) for n, x in zip(columns, plain, strict=True)], *([num(df, weight).alias("w")] if weight else [])).dropna(), "events")
    columns, weight = plain, "w" if weight else None
    _, centre, base = moments(rows, columns, weight)
    rounds = Rounds(df, folder)
    state = rounds.last() or {"round": 0, "models": [m.to_json() for m in starts], "last": [None] * len(starts), "going": [True] * len(starts)}
    models = [Mixture.from_json(m) for m in state["models"]]
    last, going = list(state["last"]), list(state["going"])
    for number in range(state["round"], max_iter):
        at = [i for i, g in enumerate(going) if g]
        if not at:
            break
        found = {(r["model"], r["component"]): np.array(r["sums"]) for r in expectation(rows, columns, [models[i] for i in at], centre, weight).collect()}  # a row for each component
        for q, i in enumerate(at):
            mean = float(found[q, -1][0] / found[q, -1][1])
            models[i] = maximisation(np.array([found[q, k] for k in range(models[i].k)]), centre, base, covariance, reg)
            going[i] = last[i] is None or abs(mean - last[i]) >= tol
            last[i] = mean
        rounds.save(number + 1, {"round": number + 1, "models": [m.to_json() for m in models], "last": last, "going": going})
    if len(models) > 1:
        ends = {r["model"]: r["sums"] for r in expectation(rows, columns, models, centre, weight).where("component = -1").collect()}
        models = [models[max(ends, key=lambda i: (ends[i][0] / ends[i][1], -i))]]
    dropped(rows)
    return models[0]
