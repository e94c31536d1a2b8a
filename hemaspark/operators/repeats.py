"""Consolidation of repeated measurements of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import c, num
from ..storage import written
from .clean import DATE, ID, TIME


#: A sample with more rows is ranked by many tasks.
HOT = 100_000
SALTS = 64


def _agreement(line: WindowSpec, spread: Row | tuple, threshold: float) -> Column:
    """On how many measures (_m<i>) the first and the second row of a window in order agree."""
    every, agree = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), F.lit(0)
    for i in range(len(spread)):
        far = F.abs(F.nth_value(f"_m{i}", 1).over(every) - F.nth_value(f"_m{i}", 2).over(every)) > F.lit(threshold) * F.lit(spread[i])
        agree = agree + F.when(F.coalesce(far, F.lit(False)), 0).otherwise(1)
    return agree


def _ranked(df: DataFrame, id_col: str, order: list[Column], measures: list[str], threshold: float, hot: int = HOT) -> DataFrame:
    """Adds _rn (1: the sample's earliest row; else more), _n (size of the sample) and _ok (measures on which its two earliest rows agree).

    The spread of each measure over all rows comes from one aggregate, whose values become constants of the plan. A sample's
    rows meet in one shuffle by its number. Of samples with more than `hot` rows (the null number is one) the two earliest rows of each
    of SALTS shares by hash are found first, and only those meet.
    """
    names, kinds = df.columns, [num(df, m) for m in measures]
    spread = df.agg(*[F.stddev_samp(m).alias(f"_{i}") for i, m in enumerate(kinds)]).first() if measures else ()
    line = Window.partitionBy(c(id_col)).orderBy(*order)

    def plain(df: DataFrame) -> DataFrame:
        """All in one window, so that a sample's rows are gone through once."""
        every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = df.withColumns({f"_m{i}": m for i, m in enumerate(kinds)})
        return out.select(*[c(n) for n in names], F.row_number().over(line).alias("_rn"), F.count(F.lit(1)).over(every).alias("_n"), _agreement(line, spread, threshold).alias("_ok"))

    large = written(df.groupBy(c(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot), "large")
    if large.isEmpty():
        return plain(df)
    same = c(id_col).eqNullSafe(F.col("_id"))
    rest = df.join(large, same, "left_anti")
    shares = df.join(large.select("_id"), same, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*[c(n) for n in names]), F.lit(SALTS)))
    shares = shares.withColumn("_in", F.row_number().over(Window.partitionBy(c(id_col), "_salt").orderBy(*order)))
    first = shares.where("_in <= 2").withColumns({f"_m{i}": m for i, m in enumerate(kinds)})
    verdict = first.withColumns({"_first": F.row_number().over(line), "_ok": _agreement(line, spread, threshold)}).where("_first = 1")
    verdict = written(verdict.select(c(id_col).alias("_id"), F.col("_salt").alias("_at"), "_ok").join(large.withColumnRenamed("_id", "_i"), F.expr("_id <=> _i")).drop("_i"), "verdict")
    spread_out = shares.join(verdict, same).withColumn("_rn", F.when((F.col("_salt") == F.col("_at")) & (F.col("_in") == 1), 1).otherwise(2))
    return plain(rest).unionByName(spread_out.select(*[c(n) for n in names], "_rn", "_n", "_ok"))


def consolidate_repeats(df: DataFrame, threshold: float = 1.0, measures: list[str] = K.CORE_MEASURES, id_col: str = ID, order_by: tuple[str, ...] = (DATE, TIME), flag: bool = False, shared: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(main, odd, one_different).

    Samples with one row stay. Of others the two earliest rows are compared, whatever the number of rows: two values of a
    measure agree unless they differ by more than `threshold` of its standard deviations over all rows (null values agree).
    If all measures agree, or all but one, the earliest row stays, else the whole sample goes. odd holds the rows of
    samples that went, one_different those of samples that disagree once. With `flag` main has all rows, with drop_dup
    (a later row of a sample that stays) and drop_dup_disagree (a row of one that goes). Rows are ordered by `order_by` as text, then by
    all other columns, so neither input order nor partitions matter. Null sample numbers are one sample.
    With `shared` the ranks are written once, for callers that use more than one of the three tables.
    """
    present = [m for m in measures if m in df.columns]
    rest = [n for n in df.columns if n not in (*order_by, id_col)]
    order = [c(n).asc_nulls_last() for n in order_by if n in df.columns] + [c(n).asc() for n in rest]
    ranked = _ranked(df, id_col, order, present, threshold)
    ranked = written(ranked, "ranked") if shared else ranked
    agrees = (F.col("_n") == 1) | (F.col("_ok") >= len(present) - 1)
    helpers = ("_rn", "_n", "_ok")
    if flag:
        main = ranked.withColumns({"drop_dup": agrees & (F.col("_rn") > 1), "drop_dup_disagree": ~agrees}).drop(*helpers)
    else:
        main = ranked.where(agrees & (F.col("_rn") == 1)).drop(*helpers)
    odd = ranked.where(~agrees).drop(*helpers)
    one = ranked.where((F.col("_n") > 1) & (F.col("_ok") == len(present) - 1)).drop(*helpers)
    return main, odd, one


def anonymised(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Sample numbers replaced by their rank among distinct ones, from 0.

    Ranks come from a range-partitioned sort of the distinct numbers and counts by partition, so no task sees them all.
    """
    ids = df.select(c(id_col).alias("_id")).distinct()
    sized = written(ids.repartitionByRange("_id").sortWithinPartitions("_id").withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()}), "ids")
    counts = sized.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = sized.join(ahead.select("_p", "_first", "_ahead"), "_p").select("_id", (F.col("_k") - F.col("_first") + F.col("_ahead")).alias("_rank"))
    out = df.join(ranks, c(id_col).eqNullSafe(F.col("_id")))
    return out.select(*[F.col("_rank").alias(n) if n == id_col else c(n) for n in df.columns])
