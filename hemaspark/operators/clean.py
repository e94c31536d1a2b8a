"""Stages of cleaning: one select each, whatever the number of columns."""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import all_of, any_of, c, is_true, num, number

ID, DATE, TIME, DISCRETE = "Sample No.", "Date", "Time", "Discrete"
log = logging.getLogger("hemaspark")


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns in order with new expressions for some, further ones at the end: a single projection."""
    kept = [new[n].alias(n) if n in new else c(n) for n in df.columns]
    return df.select(*kept, *[e.alias(n) for n, e in new.items() if n not in df.columns])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def technical_flag(id_col: str = ID, prefixes: list[str] = K.TECHNICAL_PREFIXES) -> Column:
    """Whether a sample number begins with a technical prefix, in its case. A null number is no technical sample."""
    return is_true(any_of([c(id_col).startswith(p) for p in prefixes]))


def remove_technical_samples(df: DataFrame, id_col: str = ID, prefixes: list[str] = K.TECHNICAL_PREFIXES, flag: bool = False) -> DataFrame:
    """Drops technical samples, or adds a drop_techsample_<prefix> column for each prefix."""
    if flag:
        return _replace(df, {f"drop_techsample_{p}": is_true(c(id_col).startswith(p)) for p in prefixes})
    return df.where(~technical_flag(id_col, prefixes))


def mask_channels(df: DataFrame, discrete: str = DISCRETE, channels: dict[str, list[str]] = K.CHANNEL_COLUMNS, everything: str = K.ALL_CHANNELS) -> DataFrame:
    """Nulls what a channel measures where `discrete` names neither the channel nor free selection; a column that two channels
    measure needs both. A null `discrete` names nothing."""
    has = lambda token: is_true(c(discrete).contains(token))
    needs: dict[str, list[Column]] = {}
    for token, names in channels.items():
        for n in dict.fromkeys(names):
            if n in df.columns:
                needs.setdefault(n, []).append(has(everything) | has(token))
    return _replace(df, {n: F.when(all_of(conditions), c(n)) for n, conditions in needs.items()})


def drop_unused_columns(df: DataFrame, names: list[str] = K.UNUSED_COLUMNS) -> DataFrame:
    return df.select(*[c(n) for n in df.columns if n not in names and "(Reserved)" not in n and "Unnamed" not in n])


def encode_flags(df: DataFrame) -> DataFrame:
    """Positive and Error columns: 0 if null or a numeric 0, else 1 (text is 1, "0" in a text column too). Abnormal, Suspect and IP columns: integers, null
    as 0; a value that is no integer is an error of the query. Q-Flag columns: numbers, with _err and _disc columns. Columns
    that repeat a name (.1, .2, ...) go."""
    kinds = dict(df.dtypes)
    new: dict[str, Column] = {}
    for n in df.columns:
        x = c(n)
        if n.startswith(("Positive", "Error")):
            new[n] = F.when(x.isNull(), 0).otherwise(1) if kinds[n] == "string" else F.when(x.isNull() | (x.cast("double") == 0), 0).otherwise(1)
        elif n.endswith(("Abnormal", "Suspect")) or n.startswith("IP "):
            value = x.cast("double") if kinds[n] != "string" else F.trim(x).try_cast("double")
            bad = F.raise_error(F.concat(F.lit(f"column {n}: no integer: "), x.cast("string"))).cast("int")
            new[n] = F.when(x.isNull(), 0).when(value.isNull(), bad).otherwise(value.cast("int"))
        elif n.startswith("Q-Flag"):
            new[n] = number(x)
            new[f"{n}_err"] = F.when(x.cast("string") == "ERROR", 1).otherwise(0)
            new[f"{n}_disc"] = F.when(x.cast("string") == "DISCRETE", 1).otherwise(0)
    out = _replace(df, new)
    return out.select(*[c(n) for n in out.columns if not re.search(r"\.\d+$", n)])


def process_marks(df: DataFrame, marks: dict[str, str] = K.MARKS, one_hot: bool = False) -> DataFrame:
    """Columns that end in /M: symbols become labels, anything else null; or a 0/1 column for each label instead."""
    label = lambda n: reduce(lambda e, m: e.when(c(n).isin(m[0], m[1]), F.lit(m[1])), marks.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    names = [n for n in df.columns if n.endswith("/M")]
    if not one_hot:
        return _replace(df, {n: label(n) for n in names})
    hot = {f"{n}_{m}": is_true(label(n) == m).cast("int") for n in names for m in marks.values()}
    return df.select(*[c(n) for n in df.columns if n not in names], *[e.alias(n) for n, e in hot.items()])


def first_of_duplicate_columns(df: DataFrame) -> DataFrame:
    """Of columns with the same name the first stays."""
    seen: set[str] = set()
    keep = [not (n in seen or seen.add(n)) for n in df.columns]
    if all(keep):
        return df
    named = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return named.select(*[F.col(f"_{i}").alias(n) for i, (n, k) in enumerate(zip(df.columns, keep, strict=True)) if k])


def remove_clotted(df: DataFrame, indicators: list[str] = K.CLOT_INDICATORS, flag: bool = False) -> DataFrame:
    """Drops rows with a clot flag of 1, or adds drop_<indicator> columns. Indicators that are missing are left out."""
    present = [n for n in indicators if n in df.columns]
    if missing := [n for n in indicators if n not in df.columns]:
        log.warning("no columns %s", missing)
    hit = {n: is_true(c(n).try_cast("double") == 1) for n in present}
    if flag:
        return _replace(df, {f"drop_{n}": e for n, e in hit.items()})
    return df.where(~any_of(list(hit.values())))


def null_sentinels(df: DataFrame, sentinels: tuple[str, ...] = ("----", "      ")) -> DataFrame:
    return _replace(df, {n: F.when(~c(n).isin(*sentinels), c(n)) for n, k in df.dtypes if k == "string"})


def promotable(df: DataFrame, exempt: tuple[str, ...] = (ID, DATE, TIME), step: int = 200) -> list[str]:
    """String columns of which every value is a number: one aggregate over `step` columns at a time."""
    names = [n for n, k in df.dtypes if k == "string" and n not in exempt]
    out: list[str] = []
    for i in range(0, len(names), step):
        part = names[i : i + step]
        row = df.agg(*[F.count_if(c(n).isNotNull() & num(df, n).isNull()).alias(f"_{j}") for j, n in enumerate(part)]).first()
        out += [n for j, n in enumerate(part) if not row[j]]
    return out


def promote_numeric(df: DataFrame, exempt: tuple[str, ...] = (ID, DATE, TIME)) -> DataFrame:
    """All or nothing: a text column becomes double only if every value is a number. Numbers of samples, dates and times stay text."""
    return _replace(df, {n: num(df, n) for n in promotable(df, exempt)})


def missing_share(df: DataFrame, step: int = 200) -> DataFrame:
    """(column, missing_pct), and a row for all columns together (column "*"): one aggregate, turned into rows."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, missing_pct double")
    shares = df.agg(*[(100.0 * F.avg(c(n).isNull().cast("double"))).alias(f"_{i}") for i, n in enumerate(df.columns)])
    every = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(len(df.columns))]) / len(df.columns)
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_{i}").alias("missing_pct")) for i, n in enumerate(df.columns)], F.struct(F.lit("*").alias("column"), every.alias("missing_pct")))
    return shares.select(F.explode(rows).alias("r")).select("r.*")


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c(n) for n in df.columns if n not in names])


def drop_redundant(df: DataFrame) -> DataFrame:
    return drop_columns(df, K.REDUNDANT_HGB)


def drop_union(df: DataFrame) -> DataFrame:
    """Adds `drop`: whether any drop* column is true."""
    return _replace(df, {"drop": any_of([is_true(c(n)) for n in df.columns if n.startswith("drop")])})


def rows_dropped(df: DataFrame, prefix: str = "drop") -> DataFrame:
    """One row: how many rows have a flag of the prefix."""
    return df.agg(F.count_if(any_of([is_true(c(n)) for n in df.columns if n.startswith(prefix)])).alias("rows_dropped"))


def saturation_filter(df: DataFrame, columns: list[str], low: float = 0, high: float = 255) -> DataFrame:
    """Rows of which no channel stands at an end of its scale. Null channels don't count."""
    return df.where(all_of([F.coalesce((c(n) != low) & (c(n) != high), F.lit(True)) for n in columns]))


def with_standard_flag(df: DataFrame, samples: DataFrame | None, id_col: str = ID) -> DataFrame:
    """Adds is_standard: whether a sample number is in `samples` (first column); without a list all are. A join by key, so
    the list's length doesn't matter; repeated numbers in it don't either."""
    if samples is None:
        return df.withColumn("is_standard", F.lit(1))
    ids = samples.select(F.col(samples.columns[0]).cast("string").alias("_sid")).distinct().withColumn("_in", F.lit(1))
    return df.join(ids, c(id_col) == F.col("_sid"), "left").withColumn("is_standard", F.coalesce("_in", F.lit(0))).drop("_sid", "_in")


def only_samples(df: DataFrame, samples: DataFrame, id_col: str = ID) -> DataFrame:
    return df.join(samples.select(F.col(samples.columns[0]).cast("string").alias("_sid")), c(id_col) == F.col("_sid"), "left_semi")


def without_samples(df: DataFrame, samples: DataFrame, id_col: str = ID) -> DataFrame:
    return df.join(samples.select(F.col(samples.columns[0]).cast("string").alias("_sid")), c(id_col) == F.col("_sid"), "left_anti")


def derived_ratios(df: DataFrame) -> DataFrame:
    """LYMPH_RATIO and MCH from counts, where the columns are there."""
    new: dict[str, Column] = {}
    if {"LYMPH#(10^3/uL)", "WBC(10^3/uL)"} <= set(df.columns):
        new["LYMPH_RATIO"] = F.try_divide(num(df, "LYMPH#(10^3/uL)"), num(df, "WBC(10^3/uL)"))
    if {"HGB(g/dL)", "RBC(10^6/uL)"} <= set(df.columns):
        new["MCH"] = F.try_divide(num(df, "HGB(g/dL)"), num(df, "RBC(10^6/uL)")) * 10
    return _replace(df, new)


def trim_percentiles(df: DataFrame, columns: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Rows within both percentiles of every column, whose exact bounds come from ranks. Null values stay."""
    from .stats import quantiles

    bounds = {r["column"]: r["q"] for r in quantiles(df, columns, [low, high]).collect()}  # a row for each column
    return df.where(all_of([F.coalesce(num(df, n).between(*bounds[n]), F.lit(True)) for n in columns if n in bounds]))
