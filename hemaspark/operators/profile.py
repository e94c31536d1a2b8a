"""Profiles and comparisons of tables, and correlations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.columns import c, na_to_null, num, number
from .clean import drop_columns

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
TIME_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "HH:mm:ss", "yyyyMMdd"]


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def as_time(col: Column, formats: list[str] = TIME_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats], col.try_cast("timestamp"))


def inferred_type(df: DataFrame, column: str) -> str:
    """numeric if over 90 % of a text column's values are numbers, datetime if its first 100 values are all times, else its type."""
    kind = dict(df.dtypes)[column]
    if kind != "string":
        return kind
    x = na_to_null(c(column))
    share = df.where(x.isNotNull()).agg(F.avg(number(x).isNotNull().cast("double"))).first()[0]
    if share is not None and share > 0.9:
        return "numeric"
    times = df.where(x.isNotNull()).select(x.alias("x")).limit(100).agg(F.bool_and(as_time(F.col("x")).isNotNull())).first()[0]
    return "datetime" if times else "text"


def profile_columns(df: DataFrame, most_values: int = 10) -> DataFrame:
    """(column, type, n, missing, missing_pct, distinct, unique_pct, top): one pass for all columns. top lists the values of a
    column that has at most `most_values` different ones."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, type string, n long, missing long, missing_pct double, distinct long, unique_pct double, top array<string>")
    text = lambda n: c(n).cast("string")
    # Unpivoted and counted by value first: a distinct count of every column at once would copy each row once for a column anyway.
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text(n).alias("v")) for i, n in enumerate(df.columns)])).alias("r")).select("r.*")
    counts = rows.groupBy("i", "v").agg(F.count(F.lit(1)).alias("k"))
    stats = counts.groupBy("i").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct"))
    small = stats.where(F.col("distinct") <= most_values).select("i")
    values = counts.join(small, "i", "left_semi").where("v is not null").groupBy("i").agg(F.array_sort(F.collect_list("v")).alias("top"))
    names, kinds = (F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("i") + 1) for xs in (df.columns, [k for _, k in df.dtypes]))
    return stats.join(values, "i", "left").select(names.alias("column"), kinds.alias("type"), "n", "missing", (100.0 * F.col("missing") / F.col("n")).alias("missing_pct"), "distinct", F.when(F.col("n") > F.col("missing"), 100.0 * F.col("distinct") / (F.col("n") - F.col("missing"))).alias("unique_pct"), "top")


def profile_table(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, n_duplicates (rows equal to an earlier one), duplicate_pct. Rows meet by hash groups of the row itself."""
    rows = df.groupBy(*[c(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("_k"))
    return rows.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("n_duplicates")).withColumn("duplicate_pct", F.when(F.col("n_rows") > 0, 100.0 * F.col("n_duplicates") / F.col("n_rows")))


def sample_for_profile(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The first rows: the cap is the feature."""
    return df.limit(rows)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, median, q75, max) of numeric columns."""
    names = columns or [n for n, k in df.dtypes if is_numeric(k) and k != "boolean"]
    from .stats import quantiles

    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(num(df, n)).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in stats]) for i, n in enumerate(names)])
    tall = wide.select(F.explode(rows).alias("r")).select("r.*")
    ranks = quantiles(df, names, [0.25, 0.5, 0.75])
    return tall.join(ranks, "column", "left").select("column", "count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))], "max")


def compare_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, status, type_1, type_2): common, only in one, or of another type; a table of names."""
    ka, kb = dict(a.dtypes), dict(b.dtypes)
    rows = [(n, "common" if ka.get(n) == kb.get(n) else "type differs" if n in ka and n in kb else "only in first" if n in ka else "only in second", ka.get(n), kb.get(n)) for n in sorted({*ka, *kb})]
    return a.sparkSession.createDataFrame(rows, "column string, status string, type_1 string, type_2 string")


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Profiles of the columns that both have, side by side."""
    common = [n for n in a.columns if n in b.columns]
    left, right = (profile_columns(df.select(*[c(n) for n in common])) for df in (a, b))
    right = right.select("column", *[F.col(n).alias(f"{n}_2") for n in right.columns if n != "column"])
    return left.join(right, "column")


def corr_with(df: DataFrame, anchors: list[str], others: list[str], step: int = 50) -> DataFrame:
    """(anchor, feature, r): correlations over rows where both have values. `step` expressions an aggregate; a pass over the data for each."""
    pairs = [(a, o) for a in anchors for o in others if a != o]
    parts = []
    for i in range(0, len(pairs), step):
        part = pairs[i : i + step]
        wide = df.agg(*[F.corr(num(df, a), num(df, o)).alias(f"_{j}") for j, (a, o) in enumerate(part)])
        parts.append(wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("anchor"), F.lit(o).alias("feature"), F.col(f"_{j}").alias("r")) for j, (a, o) in enumerate(part)])).alias("x")).select("x.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], "anchor string, feature string, r double")
    return reduce(lambda x, y: x.unionByName(y), parts)


SUMS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("n", "x", "y", "xx", "yy", "xy")]])


def corr_matrix(df: DataFrame, anchors: list[str], others: list[str]) -> DataFrame:
    """The same in one pass for very wide tables: each task adds up sums over pairwise complete rows as matrix products, of
    values less a common centre; the sums are added by pair. No rows are sampled."""
    names = list(dict.fromkeys([*anchors, *others]))
    row = df.agg(*[F.avg(num(df, n)).alias(f"_{i}") for i, n in enumerate(names)]).first()
    centre = np.array([x or 0.0 for x in row])
    a, b = [names.index(n) for n in anchors], [names.index(n) for n in others]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(a), len(b)))
        for batch in batches:
            m = np.column_stack([x.to_numpy(zero_copy_only=False).astype(float) for x in batch.columns]) - centre if batch.num_rows else np.zeros((0, len(names)))
            have = (~np.isnan(m)).astype(float)
            m = np.nan_to_num(m)
            p, q, hp, hq = m[:, a], m[:, b], have[:, a], have[:, b]
            total += np.array([hp.T @ hq, p.T @ hq, hp.T @ q, (p * p).T @ hq, hp.T @ (q * q), p.T @ q])
        i, j = np.indices((len(a), len(b)))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), *[pa.array(t.ravel()) for t in total]], names=SUMS.names)

    wide = df.select(*[num(df, n).alias(f"_{i}") for i, n in enumerate(names)])
    added = wide.mapInArrow(sums, SUMS).groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in ("n", "x", "y", "xx", "yy", "xy")])
    vx, vy = F.col("n") * F.col("xx") - F.col("x") ** 2, F.col("n") * F.col("yy") - F.col("y") ** 2
    r = F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(F.greatest(vx, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300))))
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col(k) + 1)
    return added.select(pick(anchors, "i").alias("anchor"), pick(others, "j").alias("feature"), r.alias("r")).where("anchor <> feature")


def correlation_report(df: DataFrame, anchors: list[str] = K.ANCHOR_FEATURES, threshold: float = 0.8, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(anchor, feature, r) with r >= threshold; the sign counts, and anchors may be features of each other."""
    numeric = [n for n, k in df.dtypes if is_numeric(k) and k != "boolean" and n not in exempt]
    present = [n for n in anchors if n in numeric]
    pairs = len(present) * len(numeric)
    rows = corr_with(df, present, numeric) if pairs <= 200 else corr_matrix(df, present, numeric)
    return rows.where(F.col("r") >= threshold)


def drop_correlated(df: DataFrame, report: DataFrame) -> DataFrame:
    """Without the features of a report (names: as many as columns)."""
    return drop_columns(df, [r[0] for r in report.select("feature").distinct().collect()])


def corr_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean absolute difference of two tables' correlations over pairs of columns."""
    x, y = (corr_matrix(df, columns, columns).where("anchor < feature") for df in (a, b))
    return x.join(y.withColumnRenamed("r", "r2"), ["anchor", "feature"]).agg(F.avg(F.abs(F.col("r") - F.col("r2"))).alias("mean_abs_difference"), F.count(F.lit(1)).cast("long").alias("n_pairs"))

