"""Additive models of penalised splines: Gram matrices, their solution by feature and group, and corrections, all on the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import all_of, c, num
from .arrow import map_arrow

DEFAULT_SPLINES, LAMBDA, CUTOFF = 25, 0.6, 1e-11


def check_terms(terms: list[tuple], covariates: list[str]) -> None:
    """Terms are ("s", cov), ("f", cov) and ("te", cov, cov, ...); every covariate has to be in one."""
    used = set()
    for kind, *names in terms:
        if kind not in ("s", "te", "f"):
            raise ValueError(f"unknown term {kind!r}")
        if kind == "te" and len(names) < 2:
            raise ValueError("a tensor term needs two covariates or more")
        if kind in ("s", "f") and len(names) != 1:
            raise ValueError(f"term {kind!r} takes one covariate")
        if missing := [n for n in names if n not in covariates]:
            raise ValueError(f"unknown covariates {missing}")
        used |= set(names)
    if rest := [n for n in covariates if n not in used]:
        raise ValueError(f"covariates without a term: {rest}")


@dataclass
class Axis:
    """A covariate's basis: cubic B-splines on equal knots between its least and greatest value (constant beyond), cyclic ones, or levels."""

    kind: str
    low: float = 0.0
    high: float = 1.0
    n: int = DEFAULT_SPLINES
    levels: list[float] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.levels) if self.kind == "f" else self.n

    def basis(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "f":
            return (x[:, None] == np.array(self.levels)).astype(float)
        m = self.n if self.kind == "cp" else self.n - 3
        span = (self.high - self.low) or 1.0
        u = (x - self.low) / span
        u = (np.mod(u, 1.0) if self.kind == "cp" else np.clip(u, 0, 1)) * m
        k = np.clip(np.floor(u).astype(int), 0, m - 1)
        t = u - k
        four = np.column_stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6
        out = np.zeros((len(x), self.n))
        at = k[:, None] + np.arange(4)
        np.add.at(out, (np.arange(len(x))[:, None], at % self.n if self.kind == "cp" else at), four)
        return out

    def penalty(self) -> np.ndarray:
        if self.kind == "f":
            return np.eye(self.size)
        d = np.eye(self.n)
        d = (np.roll(d, 1, axis=0) - 2 * d + np.roll(d, -1, axis=0)) if self.kind == "cp" else np.diff(d, 2, axis=0)
        return d.T @ d


@dataclass
class Design:
    """Columns of the model: a constant, then each term's basis (a tensor term: all products)."""

    covariates: list[str]
    terms: list[tuple]
    axes: dict[str, Axis]
    lam: float = LAMBDA

    def term(self, k: int, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), 1))
        for n in self.terms[k][1:]:
            b = self.axes[n].basis(x[:, self.covariates.index(n)])
            out = (out[:, :, None] * b[:, None, :]).reshape(len(x), -1)
        return out

    def sizes(self) -> list[int]:
        return [int(np.prod([self.axes[n].size for n in t[1:]])) for t in self.terms]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), *[self.term(k, x) for k in range(len(self.terms))]])

    def penalty(self) -> np.ndarray:
        p = 1 + sum(self.sizes())
        out, at = np.zeros((p, p)), 1
        for t, size in zip(self.terms, self.sizes(), strict=True):
            block = np.zeros((size, size))
            for i, n in enumerate(t[1:]):
                part = np.eye(1)
                for j, m in enumerate(t[1:]):
                    part = np.kron(part, self.axes[n].penalty() if i == j else np.eye(self.axes[m].size))
                block += part
            out[at : at + size, at : at + size] = self.lam * block
            at += size
        return out


def make_design(df: DataFrame, covariates: list[str], terms: list[tuple] | None = None, n_splines: int | dict[str, int] = DEFAULT_SPLINES, cyclic: tuple[str, ...] = (), lam: float = LAMBDA, most_levels: int = 1000) -> Design:
    """Ranges of spline covariates and levels of factors from one aggregate each. A factor with more than `most_levels` is an error."""
    terms = terms or [("s", n) for n in covariates]
    check_terms(terms, covariates)
    factors = {t[1] for t in terms if t[0] == "f"}
    row = df.agg(*[f(num(df, n)).alias(f"{k}{i}") for i, n in enumerate(covariates) for k, f in (("l", F.min), ("h", F.max))]).first()
    axes = {}
    for i, n in enumerate(covariates):
        if n in factors:
            levels = [r[0] for r in df.select(num(df, n).alias("v")).where("v is not null").distinct().limit(most_levels + 1).collect()]
            if len(levels) > most_levels:
                raise ValueError(f"factor {n!r} has more than {most_levels} levels")
            axes[n] = Axis("f", levels=sorted(levels))
        else:
            size = n_splines.get(n, DEFAULT_SPLINES) if isinstance(n_splines, dict) else n_splines
            axes[n] = Axis("cp" if n in cyclic else "ps", row[f"l{i}"] or 0.0, row[f"h{i}"] or 1.0, max(4, size))
    return Design(covariates, terms, axes, lam)


GRAMS = T.StructType([T.StructField("grp", T.StringType()), T.StructField("feature", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])


def grams(df: DataFrame, features: list[str], design: Design, group: str | None, bands: dict | None = None) -> DataFrame:
    """(grp, feature, n, v: the upper half of BtB, Bty, yty and the sum of y): one pass over the data for all features.

    Each task adds up its own rows' matrices, of each feature's own complete rows; the sums are added by (feature, group) on the
    cluster and stay there. bands: {(feature, group): (low, high)}, rows outside which don't count. Without a group grp is empty.
    """
    p = 1 + sum(design.sizes())
    upper = np.triu_indices(p)
    cov_names = design.covariates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.array(batch.column(0).to_pylist(), object)
            data = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, batch.num_columns)])
            x, y = data[:, : len(cov_names)], data[:, len(cov_names) :]
            fine = ~np.isnan(x).any(axis=1)
            for g in set(groups.tolist()):
                rows = np.flatnonzero(fine & (groups == g))
                if not len(rows):
                    continue
                b = design.matrix(x[rows])
                cache: dict[bytes, np.ndarray] = {}
                for f in range(y.shape[1]):
                    v = y[rows, f]
                    ok = ~np.isnan(v)
                    if bands is not None and (f, g) in bands:
                        ok &= (v > bands[f, g][0]) & (v < bands[f, g][1])
                    if not ok.any():
                        continue
                    key = ok.tobytes()
                    if key not in cache:  # features with the same gaps share the matrix
                        cache[key] = (b[ok].T @ b[ok])[upper]
                    part = np.concatenate([cache[key], b[ok].T @ v[ok], [(v[ok] ** 2).sum(), v[ok].sum()]])
                    old = sums.setdefault((g, f), [0, 0.0])
                    old[0] += int(ok.sum())
                    old[1] = old[1] + part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))], names=GRAMS.names)

    wide = df.select((c(group).cast("string") if group else F.lit("")).alias("grp"), *[num(df, n).alias(f"x{i}") for i, n in enumerate(cov_names)], *[num(df, n).alias(f"y{i}") for i, n in enumerate(features)]).where("grp is not null")
    m = len(upper[0]) + p + 2
    parts = wide.mapInArrow(run, GRAMS).groupBy("grp", "feature")
    if m > 400:
        return _added(wide.mapInArrow(run, GRAMS))
    return parts.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("values", F.lit(i))) for i in range(m)]).alias("v"))


def _added(parts: DataFrame) -> DataFrame:
    """Sums of long arrays by (group, feature), place by place."""
    rows = parts.select("grp", "feature", "n", F.posexplode("values").alias("i", "v"))
    total = rows.groupBy("grp", "feature", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return total.groupBy("grp", "feature").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))


@dataclass
class Fit:
    coef: np.ndarray
    mean: float
    n: int
    sigma2: float = 0.0
    inverse: np.ndarray | None = None

    @staticmethod
    def of(row: dict) -> Fit:
        p = len(row["coef"])
        return Fit(np.array(row["coef"]), row["mean"], row["n"], row["sigma2"], np.array(row["inverse"]).reshape(p, p))


def solve(v: np.ndarray, n: int, penalty: np.ndarray) -> Fit:
    """Penalised least squares of one row of grams, with residual variance and the inverse for intervals. Directions that the data and the
    penalty leave open (each term holds a constant) are left at zero."""
    p = len(penalty)
    upper = np.triu_indices(p)
    btb = np.zeros((p, p))
    btb[upper] = v[: len(upper[0])]
    btb = btb + np.triu(btb, 1).T
    bty, yty, total = v[len(upper[0]) : len(upper[0]) + p], v[-2], v[-1]
    inv = np.linalg.pinv(btb + penalty, rcond=CUTOFF, hermitian=True)
    coef = inv @ bty
    edf = float(np.trace(inv @ btb))
    rss = max(0.0, float(yty - 2 * coef @ bty + coef @ btb @ coef))
    return Fit(coef, total / n, n, rss / max(1.0, n - edf), inv @ btb @ inv)


FITS = T.StructType([T.StructField("grp", T.StringType()), T.StructField("feature", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("sigma2", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType()))])


def solved(sums: DataFrame, design: Design, least: int = 1) -> DataFrame:
    """FITS of all rows of grams with `least` rows of data or more: each system is solved by the task that has it."""
    penalty = design.penalty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [solve(np.array(v, float), n, penalty) for n, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            rest = [pa.array([f.mean for f in fits], pa.float64()), pa.array([f.sigma2 for f in fits], pa.float64()), *[pa.array([x.ravel().tolist() for x in y], pa.list_(pa.float64())) for y in ([f.coef for f in fits], [f.inverse for f in fits])]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *rest], names=FITS.names)

    return map_arrow(sums.where(F.col("n") >= least).select("grp", "feature", "n", "v"), run, FITS)


def with_bases(df: DataFrame, design: Design) -> DataFrame:
    """Adds, for each covariate (already there as _x<i>, never null), where its basis begins (_k<i>) and the basis values that aren't zero: _b<i>_0 to
    _b<i>_3 of a spline, _b<i>_0 of a factor.

    Each step is a projection of its own and uses the columns of the one before, never null ones: written out in one, the steps would
    repeat each other's expressions, and the JVM doesn't compile what becomes of that (methods of 8,000 bytes and more are interpreted).
    """
    scaled, start, rest, four = {}, {}, {}, {}
    for i, n in enumerate(design.covariates):
        axis, v, u, k, t = design.axes[n], *(F.col(f"_{part}{i}") for part in "xukt")
        if axis.kind == "f":
            scaled[f"_u{i}"] = (F.coalesce(F.array_position(F.array(*[F.lit(float(q)) for q in axis.levels]), v), F.lit(0)) if axis.levels else F.lit(0)).cast("int")
            start[f"_k{i}"] = F.greatest(u - 1, F.lit(0))
            four[f"_b{i}_0"] = F.when(u > 0, 1.0).otherwise(0.0)
            continue
        m = axis.n if axis.kind == "cp" else axis.n - 3
        share = (v - F.lit(float(axis.low))) / F.lit(float((axis.high - axis.low) or 1.0))
        scaled[f"_u{i}"] = (F.pmod(share, F.lit(1.0)) if axis.kind == "cp" else F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))) * m
        start[f"_k{i}"] = F.greatest(F.least(F.floor(u).cast("int"), F.lit(m - 1)), F.lit(0))
        rest[f"_t{i}"] = u - k
        values = [(1 - t) * (1 - t) * (1 - t) / 6, ((3 * t - 6) * t * t + 4) / 6, (((-3 * t + 3) * t + 3) * t + 1) / 6, t * t * t / 6]
        four |= {f"_b{i}_{j}": e for j, e in enumerate(values)}
    for step in (scaled, start, rest, four):
        df = df.withColumns(step) if step else df
    return df


def places(design: Design) -> tuple[list[Column], list[Column]]:
    """(positions, values) of the basis columns that aren't zero, from the columns of with_bases: a constant, four of each spline, one of a
    factor, products of a tensor term. A level that the factor doesn't have has the value 0."""
    own: dict[str, tuple[list[Column], list[Column]]] = {}
    for i, n in enumerate(design.covariates):
        axis, k = design.axes[n], F.col(f"_k{i}")
        width = range(1 if axis.kind == "f" else 4)
        own[n] = ([(k + j) % axis.n if axis.kind == "cp" else k + j for j in width], [F.col(f"_b{i}_{j}") for j in width])
    at, value, first = [F.lit(0)], [F.lit(1.0)], 1
    for term, size in zip(design.terms, design.sizes(), strict=True):
        pos, val = own[term[1]]
        for n in term[2:]:
            pos, val = [p * design.axes[n].size + q for p in pos for q in own[n][0]], [p * q for p in val for q in own[n][1]]
        at += [F.lit(first) + p for p in pos]
        value += val
        first += size
    return at, value


#: Up to so many products a projection is written out as arithmetic, beyond as a function over arrays.
PRODUCTS = 40


def apply_corrections(df: DataFrame, features: list[str], design: Design, fits: DataFrame, group: str | None, offsets: DataFrame | None = None) -> DataFrame:
    """x - prediction + reference where covariates and x are there and the group has a model; otherwise x as it is. Then its group's offset is added.

    fits: grp, feature (its number in features), coef, ref; offsets: grp, offsets (an array by feature). All of a group's coefficients are one row, which is joined by
    group: sort-merged if there are many groups, and skewed groups are split by AQE; without a group it is one row,
    broadcast. Predictions are Catalyst expressions of the few basis columns that aren't zero at a row.
    """
    names = df.columns
    have = {n: features.index(n) for n in features if n in names}
    models = fits.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("coef", "ref")))).alias("_fits"))  # at most as many as features
    models = models.withColumn("_fits", F.transform(F.sequence(F.lit(0), F.lit(max(0, len(features) - 1))), lambda i: F.try_element_at("_fits", i)))  # by place: rows needn't search
    models = models.join(offsets.select("grp", F.col("offsets").alias("_offsets")), "grp", "full_outer") if offsets is not None else models.withColumn("_offsets", F.lit(None).cast("array<double>"))
    models = models.select(F.col("grp").alias("_grp"), "_fits", "_offsets")
    x = [num(df, n) for n in design.covariates]
    own = [c(n).alias(f"_c{j}") for j, n in enumerate(names)]  # by place: no name of theirs can clash
    wide = df.select(*own, *[num(df, n).alias(f"_y{i}") for n, i in have.items()], all_of([v.isNotNull() for v in x]).alias("_fine"), *[F.coalesce(v, F.lit(0.0)).alias(f"_x{i}") for i, v in enumerate(x)], (c(group).cast("string") if group else F.lit("")).alias("_g"))
    at, value = places(design)
    wide, written_out = with_bases(wide, design), len(at) * len(have) <= PRODUCTS
    if not written_out:
        wide = wide.withColumns({"_at": F.array(*at), "_w": F.array(*value)})
    wide = wide.join(models if group else F.broadcast(models), F.col("_g") == F.col("_grp"), "left")
    wide = wide.withColumns({f"_f{i}": F.when(F.col("_fine"), F.get("_fits", F.lit(i))) for i in have.values()})

    def corrected(n: str) -> Column:
        y, own = F.col(f"_y{have[n]}"), F.col(f"_f{have[n]}")
        if written_out:
            parts = [F.get(own["coef"], p) * v for p, v in zip(at, value, strict=True)]
            prediction = sum(parts[1:], parts[0])
        else:
            prediction = F.aggregate(F.zip_with("_at", "_w", lambda i, w: F.get(own["coef"], i) * w), F.lit(0.0), lambda a, v: a + v)
        moved = F.coalesce(y - prediction + own["ref"], y)
        return moved + F.coalesce(F.get("_offsets", F.lit(have[n])), F.lit(0.0))

    return wide.select(*[(corrected(n) if n in have else F.col(f"_c{j}")).alias(n) for j, n in enumerate(names)])


def fits_of(df: DataFrame, features: list[str], fits: dict[tuple[str, str | None], tuple[np.ndarray, float]]) -> DataFrame:
    """A table for apply_corrections of given coefficients: {(feature, group): (coefficients, reference)}."""
    rows = [(g or "", features.index(f), [float(x) for x in coef], float(ref)) for (f, g), (coef, ref) in fits.items()]
    return df.sparkSession.createDataFrame(rows, "grp string, feature int, coef array<double>, ref double")
