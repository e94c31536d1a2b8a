"""Robust statistics, distances between distributions, binned and grouped means."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, bucket, c, num, rescaled
from ..storage import written


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(_k0, ..., column, x, k): how often each value stands in each column (and group); null values aside. Counted by task first."""
    keys = [c(n).alias(f"_k{j}") for j, n in enumerate(by or [])]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), num(df, n).alias("x")) for n in columns])).alias("_r")
    names = [f"_k{j}" for j in range(len(keys))]
    return df.select(*keys, rows).select(*names, "_r.*").where("x is not null").groupBy(*names, "column", "x").agg(F.count(F.lit(1)).alias("k"))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return all_of([a[n].eqNullSafe(b[n]) for n in names])


#: Ranges for quantiles: most are never looked at, so small ones leave little to sort.
FINER = 4


def _ranges(counts: DataFrame, sums: list[str], finer: int = 1) -> tuple[DataFrame, DataFrame, list[str]]:
    """(ranges, totals, keys) of counts (keys, x, sums).

    Values are dealt to ranges (_p) by keys and value, `finer` times as many as there are shuffle partitions, so neither a column nor a share of it
    that grows with the input is sorted by one task. totals has a row for each range: its sums, those of the ranges before it
    (_b_<sum>), of all of them (<sum>_all), and the next range's first value.
    """
    keys = [n for n in counts.columns if n not in ("x", *sums)]
    n = finer * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(counts.repartitionByRange(n, *keys, "x").withColumn("_p", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy(*keys, "_p").agg(*[F.sum(s).alias(s) for s in sums], F.min("x").alias("_low"))
    line = Window.partitionBy(*keys).orderBy("_p")
    before, every = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    totals = totals.select(*keys, "_p", *sums, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_b_{s}") for s in sums], *[F.sum(s).over(every).alias(f"{s}_all") for s in sums], F.lead("_low").over(line).alias("_next"))
    return ranges, totals, keys


def _within(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Adds _a_<sum> (of smaller values in the range) and _x2 (the next value in it)."""
    within = Window.partitionBy(*keys, "_p").orderBy("x")
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"_a_{s}": F.coalesce(F.sum(s).over(ahead), F.lit(0)) for s in sums} | {"_x2": F.lead("x").over(within)})


def running_counts(counts: DataFrame, sums: list[str]) -> tuple[DataFrame, list[str]]:
    """counts (keys, x, sums) with, for each of the sums s, s_before (of smaller values) and s_all, and `next` (the next value); and the
    keys. See _ranges: a range begins with the sums of those before it."""
    ranges, totals, keys = _ranges(counts, sums)
    inner, totals = _within(ranges, keys, sums), totals.drop(*sums)
    both = inner.join(totals, _same(inner, totals, [*keys, "_p"]))
    return both.select(*[inner[n] for n in keys], "x", *sums, *[(F.col(f"_a_{s}") + F.col(f"_b_{s}")).alias(f"{s}_before") for s in sums], *[f"{s}_all" for s in sums], F.coalesce("_x2", "_next").alias("next")), keys


def quantiles_of(counts: DataFrame, fractions: list[float]) -> DataFrame:
    """(keys, q): exact quantiles in the order of the fractions, interpolated between the two ranks beside them, from value counts.
    Only ranges that hold one of the ranks are looked at."""
    ranges, totals, keys = _ranges(counts, ["k"], FINER)
    place = lambda f, n: F.lit(float(f)) * (F.col(n) - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("h"), (F.ceil if h else F.floor)(place(f, "k_all")).alias("r")) for i, f in enumerate(fractions) for h in (0, 1)])
    ranks = totals.select(*keys, "_p", F.col("k_all").alias("n"), "_b_k", F.col("k").alias("_in"), F.explode(ranks).alias("t")).where("t.r >= _b_k and t.r < _b_k + _in")
    ranks = written(ranks.select(*keys, "_p", "n", "t.i", "t.h", (F.col("t.r") - F.col("_b_k")).alias("r")), "ranks")
    some = ranks.select(*keys, "_p").distinct()
    inner = _within(ranges.join(some, _same(ranges, some, [*keys, "_p"]), "left_semi"), keys, ["k"])
    at = (F.col("r") >= F.col("_a_k")) & (F.col("r") < F.col("_a_k") + F.col("k"))
    hit = inner.join(ranks, _same(inner, ranks, [*keys, "_p"]) & at).select(*[inner[n] for n in keys], "x", "n", "i", "h")
    wide = hit.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when((F.col("i") == i) & (F.col("h") == h), F.col("x"))).alias(f"_{i}_{h}") for i in range(len(fractions)) for h in (0, 1)])

    def value(i: int, f: float) -> Column:
        p, low, high = place(f, "n"), F.col(f"_{i}_0"), F.col(f"_{i}_1")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return wide.select(*keys, F.array(*[value(i, f) for i, f in enumerate(fractions)]).alias("q"))


def _medians_of(counts: DataFrame) -> DataFrame:
    """(keys, median, mad) from value counts (keys, x, k): as exact as median_mad, without going back to the rows."""
    keys = [n for n in counts.columns if n not in ("x", "k")]
    med = written(quantiles_of(counts, [0.5]).select(*keys, F.col("q")[0].alias("median")), "medians")
    far = counts.join(med, _same(counts, med, keys)).groupBy(*[counts[n] for n in keys], F.abs(F.col("x") - F.col("median")).alias("x")).agg(F.sum("k").alias("k"))
    mad = quantiles_of(far, [0.5]).select(*keys, F.col("q")[0].alias("mad"))
    return med.join(mad, _same(med, mad, keys)).select(*[med[n] for n in keys], "median", "mad")


#: Values that a sketch keeps, and the rank that it may be off by (three times its error at 99 %, and the ends' rounding).
SKETCH = 2048
OFF = 3 * 2.296 / SKETCH**0.9723 + 0.001
#: Fractions for which pivots pay: beyond, most values are near one of the ranks.
PIVOTS = 12
#: Values between the pivots of a rank that one window orders; more are dealt to ranges.
SMALL = 1 << 20


def _wide(df: DataFrame, columns: list[str], by: list[str] | None) -> DataFrame:
    """Keys as _k<j> and columns as numbers, _x<i>: no name of theirs can clash."""
    return df.select(*[c(n).alias(f"_k{j}") for j, n in enumerate(by or [])], *[num(df, n).alias(f"_x{i}") for i, n in enumerate(columns)])


def _pivoted(wide: DataFrame, keys: list[str], columns: int, fractions: list[float]) -> DataFrame:
    """(keys, _c, _f, x, k): value counts for each column and fraction, of values between two pivots that hold its ranks; all below count as
    -inf, all above as inf.

    The pivots are quantiles of a mergeable sketch, a little below and above each fraction: one aggregate, whose sketches are
    small. A second pass counts: what is shuffled is the few values between pivots. Neither pass sorts or moves the values themselves.
    """
    at = [(i, j) for i in range(columns) for j in range(len(fractions))]
    sketched = wide.groupBy(*keys).agg(*[e for i in range(columns) for e in (F.count(f"_x{i}").alias(f"_n{i}"), F.kll_sketch_agg_double(f"_x{i}", SKETCH).alias(f"_s{i}"))])

    def pivot(i: int, rank: float, end: float) -> Column:
        if not 0 < rank < 1:
            return F.lit(end)
        return F.when(F.col(f"_n{i}") <= SKETCH, end).otherwise(F.kll_sketch_get_quantile_double(f"_s{i}", F.lit(rank)))

    pivots = sketched.select(*keys, F.array(*[pivot(i, fractions[j] - OFF, float("-inf")) for i, j in at]).alias("_low"), F.array(*[pivot(i, fractions[j] + OFF, float("inf")) for i, j in at]).alias("_high"))
    if keys:
        pivots = written(pivots.toDF(*[f"{k}_" for k in keys], "_low", "_high"), "pivots")
        both = wide.join(pivots, all_of([F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]))
        bound = lambda side, q: F.get(side, F.lit(q))
    else:
        row = pivots.first()  # two numbers for each column and fraction
        both, bound = wide, lambda side, q: F.lit(float(row[side][q]))
    parts = []
    for q, (i, j) in enumerate(at):
        x = F.col(f"_x{i}")
        parts.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("_c"), F.lit(j).alias("_f"), F.when(x < bound("_low", q), float("-inf")).when(x > bound("_high", q), float("inf")).otherwise(x).alias("x"))))
    rows = both.select(*keys, F.explode(F.array(*parts)).alias("_r")).where("_r is not null").select(*keys, "_r.*")
    return rows.groupBy(*keys, "_c", "_f", "x").agg(F.count(F.lit(1)).alias("k"))


def _interpolated(low: Column, high: Column, place: Column) -> Column:
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def _at_ranks(counts: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """(keys, _c, q): from _pivoted, by a window for each rank."""
    by = [*keys, "_c", "_f"]
    line = Window.partitionBy(*by).orderBy("x")
    run = counts.withColumns({"_b": F.coalesce(F.sum("k").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("k").over(Window.partitionBy(*by))})
    run = run.withColumn("_p", F.get(F.array(*[F.lit(float(f)) for f in fractions]), F.col("_f")) * (F.col("_n") - 1))
    holds = lambda r: (r >= F.col("_b")) & (r < F.col("_b") + F.col("k"))
    found = run.groupBy(*by).agg(F.max("_p").alias("_p"), F.max(F.when(holds(F.floor("_p")), F.col("x"))).alias("_l"), F.max(F.when(holds(F.ceil("_p")), F.col("x"))).alias("_h"))
    found = found.select(*by, _interpolated(F.col("_l"), F.col("_h"), F.col("_p")).alias("v"))
    return found.groupBy(*keys, "_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "v"))), lambda r: r["v"]).alias("q"))


def _selected(wide: DataFrame, keys: list[str], columns: int, fractions: list[float]) -> DataFrame:
    """(keys, _c, q): exact quantiles of the columns _x<i> that have values. See _pivoted; should a sketch have been off by
    more than its pivots allow (or should values be infinite), ranks are found among all values."""
    names = [f"_x{i}" for i in range(columns)]

    def of_all() -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(n).alias("x")) for i, n in enumerate(names)])).alias("_r")
        every = wide.select(*keys, rows).select(*keys, "_r.*").where("x is not null").groupBy(*keys, "_c", "x").agg(F.count(F.lit(1)).alias("k"))
        return quantiles_of(every, fractions)

    if len(fractions) > PIVOTS:
        return of_all()
    counts = written(_pivoted(wide, keys, columns, fractions), "pivoted")
    most = counts.groupBy(*keys, "_c", "_f").count().agg(F.max("count")).first()[0]
    if most is not None and most > SMALL:
        every = quantiles_of(counts, fractions)  # all fractions for each, of which its own is right
        found = every.groupBy(*keys, "_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "q"))), lambda r: F.get(r["q"], r["_f"])).alias("q"))
    else:
        found = _at_ranks(counts, keys, fractions)
    found = written(found, "quantiles")
    off = F.exists("q", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return of_all() if not found.where(off).isEmpty() else found


def quantiles(df: DataFrame, columns: list[str], fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """(_k0, ..., column, q): exact quantiles, interpolated, of the columns that have values."""
    keys = [f"_k{j}" for j in range(len(by or []))]
    found = _selected(_wide(df, columns, by), keys, len(columns), fractions)
    return found.select(*keys, F.get(F.array(*[F.lit(n) for n in columns]), F.col("_c")).alias("column"), "q")


def median_mad(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, median, mad): exact medians, and medians of the distances to them, null values aside; a column (of a group)
    without values has no row. Four passes over the rows and no shuffle of values: see _pivoted."""
    by = by or []
    keys, wide = [f"_k{j}" for j in range(len(by))], _wide(df, columns, by)
    med = _selected(wide, keys, len(columns), [0.5]).select(*keys, "_c", F.col("q")[0].alias("median"))
    if keys:
        med = written(med, "medians")
        own = med.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_c", "median"))).alias("_m")).toDF(*[f"{k}_" for k in keys], "_m")
        both = wide.join(own, all_of([F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]))
        far = both.select(*keys, *[F.abs(F.col(f"_x{i}") - F.col("_m")[i]).alias(f"_x{i}") for i in range(len(columns))])
    else:
        value = {r["_c"]: r["median"] for r in med.collect()}  # a number for each column
        far = wide.select(*[F.abs(F.col(f"_x{i}") - F.lit(value.get(i)).cast("double")).alias(f"_x{i}") for i in range(len(columns))])
    mad = _selected(far, keys, len(columns), [0.5]).select(*keys, "_c", F.col("q")[0].alias("mad"))
    named = F.get(F.array(*[F.lit(n) for n in columns]), med["_c"]).alias("column")
    return med.join(mad, _same(med, mad, [*keys, "_c"])).select(*[med[k].alias(n) for k, n in zip(keys, by, strict=True)], named, "median", "mad")


def mad_parameters(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """{column: {median, mad}}: as many values as columns."""
    return {r["column"]: {"median": r["median"], "mad": r["mad"]} for r in median_mad(df, columns).collect() if r["median"] is not None}


def mad_band(df: DataFrame, column: str, threshold: float = 3.5) -> DataFrame:
    """Rows strictly within `threshold` MADs of the median; null values go."""
    p = mad_parameters(df, [column]).get(column)
    if p is None:
        return df.where(F.lit(False))
    x = c(column)
    return df.where((x > p["median"] - threshold * p["mad"]) & (x < p["median"] + threshold * p["mad"]))


def align_columns(df: DataFrame, source: dict[str, dict[str, float]], target: dict[str, dict[str, float]], passthrough: bool = False) -> DataFrame:
    """Columns moved from the source's location and scale to the target's, in one projection. Text that is no number becomes
    null; with `passthrough` the column stays text and such values stay as they are."""
    new: dict[str, Column] = {}
    for n in df.columns:
        if n in source and n in target:
            moved = rescaled(num(df, n), source[n]["median"], target[n]["median"], source[n]["mad"], target[n]["mad"])
            new[n] = F.coalesce(moved.cast("string"), c(n).cast("string")) if passthrough else moved
    return df.select(*[new[n].alias(n) if n in new else c(n) for n in df.columns])


def _distances_of(counts: DataFrame) -> DataFrame:
    """(keys, wasserstein, ks, n_a, n_b) from the value counts of two samples: (keys, x, k0, k1)."""
    keys = [n for n in counts.columns if n not in ("x", "k0", "k1")]
    run, _ = running_counts(counts.groupBy(*keys, "x").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1")), ["k0", "k1"])
    share = lambda s: (F.col(f"{s}_before") + F.col(s)) / F.col(f"{s}_all")
    both = run.where("k0_all > 0 and k1_all > 0").withColumns({"gap": F.abs(share("k0") - share("k1")), "wide": F.coalesce(F.col("next") - F.col("x"), F.lit(0.0))})
    return both.groupBy(*keys).agg(F.sum(F.col("gap") * F.col("wide")).alias("wasserstein"), F.max("gap").alias("ks"), F.max("k0_all").alias("n_a"), F.max("k1_all").alias("n_b"))


def _side(counts: DataFrame, i: int) -> DataFrame:
    """Value counts as those of the first (0) or second (1) sample of a pair."""
    return counts.select(*[n for n in counts.columns if n != "k"], *[(F.col("k") if k == i else F.lit(0).cast("long")).alias(f"k{k}") for k in (0, 1)])


def ecdf_distances(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(column, wasserstein, ks, n_a, n_b) of two samples: areas and greatest gaps between their distribution functions. Values of
    both sides are counted by value first; see running_counts for the order that the running counts need."""
    return _distances_of(_side(value_counts(a, columns), 0).unionByName(_side(value_counts(b, columns), 1)))


def improvement(before: Column, after: Column) -> Column:
    """Per cent by which a distance fell; null where there was none."""
    return F.when(before != 0, 100 * (before - after) / before)


def alignment_quality(source: DataFrame, target: DataFrame, moved: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """By column: distances to the target before and after, of medians, MADs, Wasserstein and KS, and their improvement in per cent.
    Columns with fewer than `least` values on a side are left out."""
    # Medians of all three tables, and distances of both pairs, are found together, from value counts: each table is read once.
    named = [value_counts(df, columns).withColumn("side", F.lit(k)) for k, df in (("s", source), ("t", target), ("m", moved))]
    counts = written(reduce(lambda x, y: x.unionByName(y), named), "counts")
    stats = written(_medians_of(counts), "medians")
    stats = [stats.where(F.col("side") == k).select("column", F.col("median").alias(f"med_{k}"), F.col("mad").alias(f"mad_{k}")) for k in "stm"]
    pair = lambda k, name, i: _side(counts.where(F.col("side") == k).drop("side").withColumn("pair", F.lit(name)), i)
    pairs = [pair("s", "before", 0), pair("t", "before", 1), pair("m", "after", 0), pair("t", "after", 1)]
    found = written(_distances_of(reduce(lambda x, y: x.unionByName(y), pairs)), "distances")
    old, new = (found.where(F.col("pair") == k).select("column", "n_a", "n_b", F.col("wasserstein").alias(f"wasserstein_{k}"), F.col("ks").alias(f"ks_{k}")) for k in ("before", "after"))
    old, new = old.where(f"n_a >= {least} and n_b >= {least}").drop("n_a", "n_b"), new.drop("n_a", "n_b")
    rows = reduce(lambda x, y: x.join(y, "column"), [old, new, *stats])
    for k in ("med", "mad"):
        rows = rows.withColumns({f"{k}_before": F.abs(F.col(f"{k}_s") - F.col(f"{k}_t")), f"{k}_after": F.abs(F.col(f"{k}_m") - F.col(f"{k}_t"))})
    names = ["med", "mad", "wasserstein", "ks"]
    return rows.select("column", *[F.col(f"{k}_{w}") for k in names for w in ("before", "after")], *[improvement(F.col(f"{k}_before"), F.col(f"{k}_after")).alias(f"{k}_improvement") for k in names])


def quantile_grid(df: DataFrame, columns: list[str], n: int = 100) -> DataFrame:
    """(column, q, value): n evenly spaced quantiles from 0 to 1, interpolated."""
    qs = [i / (n - 1) for i in range(n)] if n > 1 else [0.5]
    return quantiles(df, columns, qs).select("column", F.posexplode("q").alias("_i", "value")).select("column", (F.col("_i") / max(1, n - 1)).alias("q"), "value")


def standardise(df: DataFrame, columns: list[str], undo: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(x - mean) / deviation (of the population; 0 counts as 1) by column, and the parameters; or back again with `undo`."""
    if undo is not None:
        return df.select(*[(c(n) * undo[n][1] + undo[n][0]).alias(n) if n in undo else c(n) for n in df.columns]), undo
    row = df.agg(*[f(c(n)).alias(f"_{k}{i}") for i, n in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    params = {n: (row[f"_m{i}"] or 0.0, row[f"_s{i}"] or 1.0) for i, n in enumerate(columns)}
    return df.select(*[((c(n) - params[n][0]) / params[n][1]).alias(n) if n in params else c(n) for n in df.columns]), params


def binned_means(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(bin, n, mean_x, mean_y) over equal-width bins of x between its least and greatest value."""
    low, high = df.agg(F.min(num(df, x)), F.max(num(df, x))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n long, mean_x double, mean_y double")
    rows = df.select(num(df, x).alias("x"), num(df, y).alias("y")).withColumn("bin", bucket(F.col("x"), low, high, bins)).where("bin is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def group_offsets(df: DataFrame, group: str, column: str, reference: str | None = None) -> DataFrame:
    """(group, mean, offset) to what all groups are moved to: the reference group's mean, or the plain mean of the groups'
    means. A reference that isn't there is an error."""
    return offsets_by_group(df, group, [column], reference).select("grp", F.get("means", F.lit(0)).alias("mean"), F.get("offsets", F.lit(0)).alias("offset"))


def offsets_by_group(df: DataFrame, group: str, columns: list[str], reference: str | None = None) -> DataFrame:
    """(grp, means, offsets): group_offsets of all columns in one aggregate, arrays in their order."""
    means = df.groupBy(c(group).alias("grp")).agg(*[F.avg(c(n)).alias(f"m{i}") for i, n in enumerate(columns)])
    at = range(len(columns))
    if reference is None:
        ref = means.agg(*[F.avg(f"m{i}").alias(f"r{i}") for i in at])
    else:
        ref = means.where(F.col("grp").cast("string") == str(reference)).select(*[F.col(f"m{i}").alias(f"r{i}") for i in at])
        row = ref.first()
        if row is None or all(row[f"r{i}"] is None for i in at):
            raise ValueError(f"no group {reference!r}")
    both = means.join(F.broadcast(ref))  # ref is one row
    return both.select("grp", F.array(*[F.col(f"m{i}") for i in at]).alias("means"), F.array(*[F.col(f"r{i}") - F.col(f"m{i}") for i in at]).alias("offsets"))


def normalise_groups(df: DataFrame, group: str, columns: list[str], reference: str | None = None) -> DataFrame:
    """Each column plus its group's offset: one aggregate and one join for all columns."""
    off = offsets_by_group(df, group, columns, reference).select(F.col("grp").alias("_g"), F.col("offsets").alias("_o"))
    out = df.join(off, c(group).eqNullSafe(F.col("_g")), "left")
    return out.select(*[(c(n) + F.coalesce(F.get("_o", F.lit(columns.index(n))), F.lit(0.0))).alias(n) if n in columns else c(n) for n in df.columns])


def conditional_mean(df: DataFrame, column: str, conditions: list[Column]) -> DataFrame:
    """One row: the mean of a column where all conditions hold."""
    return df.agg(F.avg(F.when(all_of(conditions), c(column))).alias("mean"))


def group_mean_spread(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(column, variance) of the groups' means."""
    means = df.groupBy(c(group)).agg(*[F.avg(c(n)).alias(f"_{i}") for i, n in enumerate(columns)])
    wide = means.agg(*[F.var_samp(f"_{i}").alias(f"_{i}") for i in range(len(columns))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_{i}").alias("variance")) for i, n in enumerate(columns)])).alias("r")).select("r.*")


def correlation_change(before: DataFrame, after: DataFrame, pairs: list[tuple[str, str]], top: int | None = 10) -> DataFrame:
    """(feature, covariate, r_before, r_after, reduction) with |r| reduced most first."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*[F.corr(num(df, a), num(df, b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
        return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature"), F.lit(b).alias("covariate"), F.col(f"_{i}").alias(name)) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")

    rows = tall(before, "r_before").join(tall(after, "r_after"), ["feature", "covariate"]).withColumn("reduction", F.abs("r_before") - F.abs("r_after"))
    return rows.orderBy(F.col("reduction").desc(), "feature", "covariate").limit(top) if top else rows


def accuracy_by_level(df: DataFrame, level: str, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(c(level).alias("level")).agg(F.avg((c(truth) == c(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def prefix_counts(df: DataFrame, column: str, length: int = 3, top: int | None = 10) -> DataFrame:
    """(prefix, n): the most frequent beginnings of a text column."""
    rows = df.groupBy(F.substring(c(column), 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.col("n").desc(), "prefix").limit(top) if top else rows


def prevalence(df: DataFrame, columns: list[str]) -> DataFrame:
    """(flag, n, pct): sums of 0/1 or boolean columns."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(c(n).cast("int"), F.lit(0))).alias(f"_{i}") for i, n in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(n).alias("flag"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("n"), F.when(F.col("_n") > 0, 100.0 * F.col(f"_{i}") / F.col("_n")).alias("pct")) for i, n in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def overlap(tables: dict[str, DataFrame], id_col: str) -> DataFrame:
    """(id, n_tables): ids that stand in two tables or more."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(c(id_col).alias("id"), F.lit(k).alias("t")) for k, df in tables.items()])
    return rows.groupBy("id").agg(F.countDistinct("t").alias("n_tables")).where("n_tables > 1")


def split_thirds(df: DataFrame, order_by: list[str], parts: int = 3) -> DataFrame:
    """Adds part, 0 to parts - 1, by order: sizes differ by at most one. Exact ranks come from range partitions and counts
    before them (no window over the whole table)."""
    from .sampling import global_rank

    ranked = global_rank(df, [c(n) for n in order_by])
    n = ranked.agg(F.count(F.lit(1))).first()[0]
    return ranked.withColumn("part", F.floor(F.col("_rank") * parts / max(1, n)).cast("int")).drop("_rank")


#: Rows of both sides together up to which kernel sums are exact: what each task holds beside its own rows. Beyond, random features.
EXACT, FEATURES = 50_000, 4096
#: Chance that the bound on what features miss is too small.
MISSED = 1e-3


def mmd(a: DataFrame, b: DataFrame, columns: list[str], bandwidth: float = 10.0, exact: int = EXACT, features: int = FEATURES, seed: int = 0) -> float:
    """Squared maximum mean discrepancy with a Gaussian kernel over all complete rows; see mmd_with_bound."""
    return mmd_with_bound(a, b, columns, bandwidth, exact, features, seed)[0]


def mmd_with_bound(a: DataFrame, b: DataFrame, columns: list[str], bandwidth: float = 10.0, exact: int = EXACT, features: int = FEATURES, seed: int = 0) -> tuple[float, float]:
    """(squared maximum mean discrepancy, how far it may be off): over all complete rows of both sides, on the cluster.

    Up to `exact` rows in all, kernels of all pairs are added up, each task's rows with all: nothing is off. Beyond, the kernel is the
    mean of cosines and sines in `features` random directions, whose means over each side are one aggregate; the empirical Bernstein bound over
    the directions holds with probability 1 - MISSED.
    """
    both = written(reduce(lambda x, y: x.unionAll(y), [df.select(F.lit(i).alias("side"), *[num(df, n).alias(f"x{j}") for j, n in enumerate(columns)]).dropna() for i, df in enumerate((a, b))]), "sides")
    sizes = {r["side"]: r["n"] for r in both.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        raise ValueError("a side has no complete rows")
    matrix = lambda batch: np.column_stack([x.to_numpy(zero_copy_only=False).astype(float) for x in batch.columns[1:]])
    if sum(sizes.values()) <= exact:
        held = np.array([list(r) for r in both.collect()], float)  # `exact` rows at most
        every, names = held[:, 1:], ("side", "other", "sum")
        other = held[:, 0]

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, own = matrix(batch), batch.column(0).to_numpy()
                sums = np.zeros((2, 2))
                for i in range(0, len(x), 256):
                    part = x[i : i + 256]
                    k = np.exp(-np.maximum(0, (part * part).sum(1)[:, None] + (every * every).sum(1) - 2 * part @ every.T) / (2 * bandwidth**2))
                    for p in (0, 1):
                        for q in (0, 1):
                            sums[p, q] += k[own[i : i + 256] == p][:, other == q].sum()
                yield pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1], pa.int32()), pa.array([0, 1, 0, 1], pa.int32()), pa.array(sums.ravel())], names=list(names))

        found = both.mapInArrow(pairs, "side int, other int, sum double").groupBy("side", "other").agg(F.sum("sum").alias("sum")).collect()
        return float(sum((1 if r["side"] == r["other"] else -1) * r["sum"] / sizes[r["side"]] / sizes[r["other"]] for r in found)), 0.0
    way = np.random.default_rng(seed).normal(size=(len(columns), features)) / bandwidth

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, own = matrix(batch), batch.column(0).to_numpy()
            for i in range(0, len(x), 1024):
                turn = x[i : i + 1024] @ way
                both_ways = np.hstack([np.cos(turn), np.sin(turn)])
                for p in set(own[i : i + 1024].tolist()):
                    sums[p] = sums.get(p, 0.0) + both_ways[own[i : i + 1024] == p].sum(axis=0)
        for p, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["side", "sums"])

    parts = both.mapInArrow(means, "side int, sums array<double>").select("side", F.posexplode("sums").alias("i", "v"))
    total = np.zeros((2, 2 * features))
    for r in parts.groupBy("side", "i").agg(F.sum("v").alias("v")).collect():  # two numbers for each direction
        total[r["side"], r["i"]] = r["v"] / sizes[r["side"]]
    gap = (total[0] - total[1]) ** 2
    each = gap[:features] + gap[features:]  # in [0, 4], by direction
    chance = np.log(3 / MISSED)
    return float(each.mean()), float(np.sqrt(2 * each.var() * chance / features) + 3 * 4 * chance / features)


def directions(dimensions: int, projections: int = 30, seed: int = 0) -> np.ndarray:
    """Random unit vectors, one a row, fixed by the seed."""
    d = np.random.default_rng(seed).normal(size=(projections, dimensions))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def sliced_wasserstein(a: DataFrame, b: DataFrame, columns: list[str], projections: int = 30, seed: int = 0) -> float:
    """Mean Wasserstein distance over fixed random directions, each a column of one projection."""
    d = directions(len(columns), projections, seed)
    names = [f"p{i}" for i in range(projections)]
    project = lambda df: df.select(*[reduce(lambda p, q: p + q, [num(df, n) * float(w) for n, w in zip(columns, row, strict=True)]).alias(k) for k, row in zip(names, d, strict=True)])
    return ecdf_distances(project(a), project(b), names).agg(F.avg("wasserstein")).first()[0]


def exact_transport_distance(a: DataFrame, b: DataFrame, columns: list[str], most: int = 400, seed: int = 0) -> float:
    """Exact 2-Wasserstein distance in several dimensions between samples of `most` rows a side by hash, solved on the driver; its time grows with
    their third power. See mixture_distance for all rows."""
    from .gmm import transport_plan
    from .sampling import exact_sample

    x, y = (np.array([list(r) for r in exact_sample(df.select(*[num(df, n).alias(n) for n in columns]).dropna(), most, seed=seed).collect()], float) for df in (a, b))
    cost = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    return float(np.sqrt((transport_plan(np.ones(len(x)), np.ones(len(y)), cost) * cost).sum()))


def mixture_distance(a: DataFrame, b: DataFrame, columns: list[str], k: int = 8, start_rows: int = 5000, seed: int = 0, **settings) -> float:
    """2-Wasserstein distance between mixtures of k components fitted on all rows of each side (see mixtures.fit): the optimal transport is
    exact and between components, whose distances have a closed form. It is no less than that of the mixtures themselves."""
    from . import gmm, mixtures
    from .sampling import exact_sample

    sides = []
    for df in (a, b):
        rows = df.select(*[num(df, n).alias(f"x{i}") for i, n in enumerate(columns)]).dropna()
        few = np.array([list(r) for r in exact_sample(rows, start_rows, seed=seed).collect()], float)  # where the fit starts from
        sides.append(mixtures.fit(rows, rows.columns, [gmm.fit(few, k, seed=seed)], **settings))
    cost = gmm.component_costs(*sides)
    return float(np.sqrt(max(0.0, (gmm.transport_plan(sides[0].weights, sides[1].weights, cost) * cost).sum())))


def group_sizes(df: DataFrame, id_col: str) -> DataFrame:
    """One row: rows, different ids, and ids with more than one row."""
    sizes = df.groupBy(c(id_col)).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("n") > 1).alias("n_repeated"))
