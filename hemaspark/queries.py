"""Queries that exercise every operator on the driver's tables, and the same in DuckDB's SQL where it can say it.

The tables are an order system's; the roles are: sample number = order key, measures = line item columns, source and target =
return flags, events = the first components of embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as X
from .operators import clean, encoder, gam, gating, gmm, mixtures, profile, repeats, sampling, stats, transport
from .plans import api
from .sources import events, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(X.c(n), digits).alias(n) if k == "double" else X.c(n) for n, k in df.dtypes])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


# --- rows and columns ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT (starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '5-'))")
def technical_prefix_filter(spark, sf):
    return clean.remove_technical_samples(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-", "5-"])


@query("SELECT o_orderkey, starts_with(o_orderpriority, '1-') AS a, starts_with(o_orderpriority, '5-') AS b FROM orders")
def technical_prefix_flags(spark, sf):
    df = clean.remove_technical_samples(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-", "5-"], flag=True)
    return df.select("o_orderkey", X.c("drop_techsample_1-").alias("a"), X.c("drop_techsample_5-").alias("b"))


@query(f"""SELECT {KEY},
  CASE WHEN p LIKE '%LOW%' OR p LIKE '%URGENT%' THEN l_quantity END AS l_quantity,
  CASE WHEN (p LIKE '%LOW%' OR p LIKE '%URGENT%') AND (p LIKE '%LOW%' OR p LIKE '%HIGH%') THEN l_tax END AS l_tax,
  CASE WHEN p LIKE '%LOW%' OR p LIKE '%HIGH%' THEN l_discount END AS l_discount
FROM (SELECT l.*, o_orderpriority AS p FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)""")
def channel_mask(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.expr("l_orderkey = o_orderkey"))
    out = clean.mask_channels(df, "o_orderpriority", {"URGENT": ["l_quantity", "l_tax"], "HIGH": ["l_tax", "l_discount"]}, "LOW")
    return out.selectExpr(*KEY.split(", "), "l_quantity", "l_tax", "l_discount")


@query("""SELECT event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS "Positive(Diff)", CASE WHEN value < 20 THEN 1 ELSE 0 END AS "Error(Func)",
  CASE WHEN value > 80 THEN 1 ELSE 0 END AS "WBC Abnormal", CASE WHEN value > 90 THEN 1 ELSE 0 END AS "IP X" FROM events""")
def flag_encode(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "case when value > 50 then event_type end as `Positive(Diff)`", "case when value < 20 then 1 when value < 60 then 0 end as `Error(Func)`", "case when value > 80 then 1 end as `WBC Abnormal`", "case when value > 90 then '1' end as `IP X`", "value as `value.1`")
    return clean.encode_flags(df)


@query("""SELECT event_id, CASE WHEN user_id % 3 = 2 THEN value END AS q, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS q_err,
  CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END AS q_disc FROM events""")
def qflag_split(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "case user_id % 3 when 0 then 'ERROR' when 1 then 'DISCRETE' else cast(value as string) end as `Q-Flag(a)`")
    return clean.encode_flags(df).toDF("event_id", "q", "q_err", "q_disc")


_MARK = "CASE l_returnflag WHEN 'R' THEN '*' WHEN 'A' THEN '----' ELSE 'junk' END"


@query(f"""SELECT {KEY}, CASE l_returnflag WHEN 'R' THEN 'low_reliability' WHEN 'A' THEN 'error' END AS m FROM lineitem""")
def mark_recode(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*KEY.split(", "), f"{_MARK} as `WBC/M`")
    return clean.process_marks(df).withColumnRenamed("WBC/M", "m")


@query(f"""SELECT {KEY}, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS m_error, 0 AS m_oor, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS m_low_reliability,
  0 AS m_oor_linearity, 0 AS m_oor_panic FROM lineitem""")
def mark_onehot(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*KEY.split(", "), f"{_MARK} as `m/M`")
    out = clean.process_marks(df, one_hot=True)
    return out.toDF(*[n.replace("m/M", "m") for n in out.columns])


@query(f"SELECT {KEY} FROM lineitem WHERE NOT (l_discount > 0.08 OR l_tax > 0.07)")
def clot_filter(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({"a": F.when(F.col("l_discount") > 0.08, 1), "b": (F.col("l_tax") > 0.07).cast("int")})
    return clean.remove_clotted(df, ["a", "b", "missing"]).selectExpr(*KEY.split(", "))


@query(f'SELECT {KEY}, l_discount > 0.08 AS drop_a, l_tax > 0.07 AS drop_b, (l_discount > 0.08 OR l_tax > 0.07) AS "drop" FROM lineitem')
def drop_union(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({"a": (F.col("l_discount") > 0.08).cast("int"), "b": (F.col("l_tax") > 0.07).cast("int")})
    return clean.drop_union(clean.remove_clotted(df, ["a", "b"], flag=True)).selectExpr(*KEY.split(", "), "drop_a", "drop_b", "drop")


@query("SELECT count(*) FILTER (WHERE l_discount > 0.08 OR l_tax > 0.07) AS rows_dropped FROM lineitem")
def count_rows_dropped(spark, sf):
    return clean.rows_dropped(table(spark, sf, "lineitem").selectExpr("l_discount > 0.08 as drop_a", "l_tax > 0.07 as drop_b"))


@query("""SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN value END AS a, CASE WHEN user_id % 5 = 0 THEN 'abc' ELSE CAST(user_id AS VARCHAR) END AS b FROM events""")
def sentinel_promote(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "case when user_id % 4 = 0 then if(user_id % 8 = 0, '----', '      ') else cast(value as string) end as a", "case when user_id % 5 = 0 then 'abc' else cast(user_id as string) end as b")
    return clean.promote_numeric(clean.null_sentinels(df))


@query("SELECT DISTINCT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0)")
def row_dedup(spark, sf):
    df = table(spark, sf, "orders")
    return clean.drop_duplicate_rows(df.union(df.where("o_orderkey % 3 = 0")))


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier' FROM supplier")
def schema_union(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey as k", "c_name as name", "c_acctbal as bal")
    return tables.union_by_name([a, table(spark, sf, "supplier").selectExpr("s_name as name", "s_suppkey as k", "'supplier' as extra", "s_acctbal as bal")])


@query("SELECT n_nationkey, n_name FROM nation")
def unused_columns(spark, sf):
    df = table(spark, sf, "nation").withColumns({"Rack": F.lit(1), "x (Reserved)": F.lit(2), "Unnamed: 3": F.lit(3), "HGB_SI(mmol/L)": F.lit(4)})
    return clean.drop_redundant(clean.drop_unused_columns(df)).select("n_nationkey", "n_name")


@query("SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation")
def duplicate_columns(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey", F.col("n_name"), F.lit(7).alias("n_nationkey"))
    return clean.first_of_duplicate_columns(df).toDF("a", "b", "c")


@query(f"SELECT {KEY}, l_quantity, l_linenumber AS l2 FROM lineitem WHERE l_quantity NOT IN (1, 50) AND l_linenumber NOT IN (1, 50)")
def saturation_filter(spark, sf):
    return clean.saturation_filter(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"], 1, 50).selectExpr(*KEY.split(", "), "l_quantity", "l_linenumber as l2")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def semi_samples(spark, sf):
    return clean.only_samples(table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey"), "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def anti_samples(spark, sf):
    return clean.without_samples(table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey"), "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) THEN 1 ELSE 0 END AS is_standard FROM orders")
def standard_flag(spark, sf):
    return clean.with_standard_flag(table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey"), "o_custkey").select("o_orderkey", "is_standard")


@query("""WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) lo, quantile_cont(l_extendedprice, 0.99) hi, quantile_cont(l_quantity, 0.01) lo2, quantile_cont(l_quantity, 0.99) hi2 FROM lineitem)
SELECT l_orderkey, l_extendedprice FROM lineitem, b WHERE l_extendedprice BETWEEN lo AND hi AND l_quantity BETWEEN lo2 AND hi2""")
def percentile_trim(spark, sf):
    return clean.trim_percentiles(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], 0.01, 0.99).select("l_orderkey", "l_extendedprice")


@query('SELECT l_orderkey, l_extendedprice, round(l_discount / l_quantity, 9) AS "LYMPH_RATIO", round(l_tax / l_quantity * 10, 9) AS "MCH" FROM lineitem')
def derived_ratios(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_extendedprice", "l_discount as `LYMPH#(10^3/uL)`", "l_quantity as `WBC(10^3/uL)`", "l_tax as `HGB(g/dL)`", "l_quantity as `RBC(10^6/uL)`")
    return clean.derived_ratios(df).select("l_orderkey", "l_extendedprice", F.round("LYMPH_RATIO", 9).alias("LYMPH_RATIO"), F.round("MCH", 9).alias("MCH"))


# --- repeated measurements -----------------------------------------------------------------------------------------

_REPEATS = f"""WITH s AS (SELECT stddev_samp(l_quantity) a, stddev_samp(l_extendedprice) b, stddev_samp(l_discount) c, stddev_samp(l_tax) d FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) rn, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem),
p AS (SELECT l_orderkey, max(n) n, {", ".join(f"max(CASE WHEN rn = {k} THEN {m} END) {m}_{k}" for m in MEASURES for k in (1, 2))} FROM r GROUP BY 1),
v AS (SELECT l_orderkey, n, {" + ".join(f"CASE WHEN abs({m}_1 - {m}_2) > s.{x} THEN 0 ELSE 1 END" for m, x in zip(MEASURES, "abcd", strict=True))} AS ok FROM p, s)
SELECT r.l_orderkey, r.l_shipdate, r.l_linenumber, r.l_partkey, r.l_quantity, r.l_extendedprice FROM r JOIN v USING (l_orderkey) WHERE """


def _consolidated(spark, sf, which):
    df = table(spark, sf, "lineitem")
    out = repeats.consolidate_repeats(df, 1.0, MEASURES, "l_orderkey", LINE_ORDER)[which]
    return out.select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query(_REPEATS + "rn = 1 AND (v.n = 1 OR ok >= 3)")
def repeat_consolidate(spark, sf):
    return _consolidated(spark, sf, 0)


@query(_REPEATS + "v.n > 1 AND ok < 3")
def repeat_odd(spark, sf):
    return _consolidated(spark, sf, 1)


@query(_REPEATS + "v.n > 1 AND ok = 3")
def repeat_one_different(spark, sf):
    return _consolidated(spark, sf, 2)


@query(_REPEATS.replace("r.l_extendedprice FROM", "r.l_extendedprice, ((v.n = 1 OR ok >= 3) AND rn > 1) AS drop_dup, NOT (v.n = 1 OR ok >= 3) AS drop_dup_disagree FROM") + "true")
def repeat_flags(spark, sf):
    main = repeats.consolidate_repeats(table(spark, sf, "lineitem"), 1.0, MEASURES, "l_orderkey", LINE_ORDER, flag=True)[0]
    return main.select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "drop_dup", "drop_dup_disagree")


@query("SELECT dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code, o_orderkey FROM orders")
def anonymised_codes(spark, sf):
    return repeats.anonymised(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select(F.col("o_orderpriority").cast("long").alias("code"), "o_orderkey")


# --- statistics and alignment --------------------------------------------------------------------------------------


@query("SELECT l_returnflag, 'l_quantity' AS \"column\", median(l_quantity) AS median, mad(l_quantity) AS mad FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_extendedprice', median(l_extendedprice), mad(l_extendedprice) FROM lineitem GROUP BY 1")
def median_mad(spark, sf):
    return stats.median_mad(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])


@query("""WITH p AS (SELECT median(l_extendedprice) FILTER (WHERE l_returnflag = 'R') ms, mad(l_extendedprice) FILTER (WHERE l_returnflag = 'R') ds,
  median(l_extendedprice) FILTER (WHERE l_returnflag = 'N') mt, mad(l_extendedprice) FILTER (WHERE l_returnflag = 'N') dt FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - ms) / ds * dt + mt, 4) AS l_extendedprice FROM lineitem, p WHERE l_returnflag = 'R'""")
def mad_align(spark, sf):
    df = table(spark, sf, "lineitem")
    model = api.TableAligner(["l_extendedprice"]).fit(df.where("l_returnflag = 'R'"), df.where("l_returnflag = 'N'"))
    return rounded(model.transform(df.where("l_returnflag = 'R'")).select("l_orderkey", "l_linenumber", "l_extendedprice"), 4)


@query("""WITH p AS (SELECT median(l_extendedprice) m, mad(l_extendedprice) d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, p WHERE l_extendedprice > m - 1.5 * d AND l_extendedprice < m + 1.5 * d""")
def mad_band_filter(spark, sf):
    return stats.mad_band(table(spark, sf, "lineitem"), "l_extendedprice", 1.5).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("WITH p AS (SELECT median(l_quantity) m, mad(l_quantity) d FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, round((l_quantity - m) / d, 6) AS score FROM lineitem, p")
def mad_score(spark, sf):
    df = table(spark, sf, "lineitem")
    p = stats.mad_parameters(df, ["l_quantity"])["l_quantity"]
    return df.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(X.robust_score(F.col("l_quantity"), p["median"], p["mad"]), 6).alias("score"))


_ECDF = """WITH a AS (SELECT {x} AS x, count(*) FILTER (WHERE {s}) k0, count(*) FILTER (WHERE {t}) k1 FROM lineitem WHERE ({s}) OR ({t}) GROUP BY 1),
g AS (SELECT x, sum(k0) OVER (ORDER BY x) / sum(k0) OVER () - sum(k1) OVER (ORDER BY x) / sum(k1) OVER () AS d, coalesce(lead(x) OVER (ORDER BY x) - x, 0) AS w FROM a)
SELECT '{x}' AS "column", round(sum(abs(d) * w), 6) AS wasserstein, round(max(abs(d)), 9) AS ks FROM g"""


@query(" UNION ALL ".join("(" + _ECDF.format(x=x, s="l_returnflag = 'R'", t="l_returnflag = 'N'") + ")" for x in ("l_extendedprice", "l_quantity")))
def ecdf_distances(spark, sf):
    df = table(spark, sf, "lineitem")
    out = stats.ecdf_distances(df.where("l_returnflag = 'R'"), df.where("l_returnflag = 'N'"), ["l_extendedprice", "l_quantity"])
    return out.select("column", F.round("wasserstein", 6).alias("wasserstein"), F.round("ks", 9).alias("ks"))


_QUALITY = """WITH s AS (SELECT {x} AS x FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT {y} AS x FROM lineitem WHERE l_returnflag = 'N'),
p AS (SELECT (SELECT median(x) FROM s) ms, (SELECT mad(x) FROM s) ds, (SELECT median(x) FROM t) mt, (SELECT mad(x) FROM t) dt),
m AS (SELECT (x - ms) / ds * dt + mt AS x FROM s, p),
q AS (SELECT median(x) mm, mad(x) dm FROM m),
{before}, {after}
SELECT '{x}' AS "column", round(abs(ms - mt), 3) AS med_before, round(abs(mm - mt), 3) AS med_after, round(abs(ds - dt), 3) AS mad_before, round(abs(dm - dt), 3) AS mad_after,
  round(b.w, 3) AS wasserstein_before, round(a.w, 3) AS wasserstein_after, round(b.k, 6) AS ks_before, round(a.k, 6) AS ks_after FROM p, q, b, a"""
_GAPS = """{n} AS (WITH c AS (SELECT x, sum(i) i, sum(j) j FROM (SELECT x, 1 i, 0 j FROM {l} UNION ALL SELECT x, 0, 1 FROM t) GROUP BY x),
  g AS (SELECT x, sum(i) OVER (ORDER BY x) / sum(i) OVER () - sum(j) OVER (ORDER BY x) / sum(j) OVER () AS d, coalesce(lead(x) OVER (ORDER BY x) - x, 0) AS w FROM c)
  SELECT sum(abs(d) * w) AS w, max(abs(d)) AS k FROM g)"""


@query(" UNION ALL ".join("(" + _QUALITY.format(x=x, y=y, before=_GAPS.format(n="b", l="s"), after=_GAPS.format(n="a", l="m")) + ")" for x, y in (("l_extendedprice", "l_extendedprice * 1.3 + 100"), ("l_tax", "l_tax"))))
def align_quality(spark, sf):
    df = table(spark, sf, "lineitem")
    s, t = df.where("l_returnflag = 'R'"), df.where("l_returnflag = 'N'").withColumn("l_extendedprice", F.col("l_extendedprice") * 1.3 + 100)
    names = ["l_extendedprice", "l_tax"]
    out = stats.alignment_quality(s, t, api.TableAligner(names).fit(s, t).transform(s), names)
    return out.select("column", *[F.round(f"{k}_{w}", 6 if k == "ks" else 3).alias(f"{k}_{w}") for k in ("med", "mad", "wasserstein", "ks") for w in ("before", "after")])


_Q = [i / 20 for i in range(21)]


@query(" UNION ALL ".join(f"SELECT 'l_extendedprice' AS \"column\", {q!r}::DOUBLE AS q, round(quantile_cont(l_extendedprice, {q!r}), 6) AS value FROM lineitem" for q in _Q))
def quantile_grid(spark, sf):
    return rounded(stats.quantile_grid(table(spark, sf, "lineitem"), ["l_extendedprice"], 21))


@query("SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def standardise(spark, sf):
    return rounded(stats.standardise(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])[0])


@query("""WITH b AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem),
k AS (SELECT greatest(least(CAST(ceil((l_extendedprice - lo) / ((hi - lo) / 20)) AS INTEGER) - 1, 19), 0) AS bin, l_extendedprice x, l_quantity y FROM lineitem, b)
SELECT bin, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM k GROUP BY 1""")
def binned_trend(spark, sf):
    return rounded(stats.binned_means(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 20))


@query("""WITH g AS (SELECT l_returnflag AS grp, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1)
SELECT grp, round(mean, 4) AS mean, round((SELECT avg(mean) FROM g) - mean, 4) AS "offset" FROM g""")
def group_offsets(spark, sf):
    return rounded(stats.group_offsets(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query("""WITH g AS (SELECT l_returnflag AS grp, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_extendedprice + (SELECT mean FROM g WHERE grp = 'N') - mean, 4) AS l_extendedprice FROM lineitem JOIN g ON grp = l_returnflag""")
def group_normalise(spark, sf):
    return rounded(stats.normalise_groups(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"), "l_returnflag", ["l_extendedprice"], "N").drop("l_returnflag"), 4)


@query("SELECT round(avg(l_extendedprice) FILTER (WHERE l_quantity < 10 AND l_tax > 0.02), 4) AS mean FROM lineitem")
def conditional_mean(spark, sf):
    return rounded(stats.conditional_mean(table(spark, sf, "lineitem"), "l_extendedprice", [F.col("l_quantity") < 10, F.col("l_tax") > 0.02]), 4)


@query("SELECT 'l_quantity' AS \"column\", round(var_samp(m), 9) AS variance FROM (SELECT avg(l_quantity) m FROM lineitem GROUP BY l_suppkey)")
def group_mean_spread(spark, sf):
    return rounded(stats.group_mean_spread(table(spark, sf, "lineitem"), "l_suppkey", ["l_quantity"]), 9)


@query("""SELECT 'l_extendedprice' AS feature, 'l_quantity' AS covariate, round(corr(l_extendedprice, l_quantity), 9) AS r_before, round(corr(l_extendedprice - 900 * l_quantity, l_quantity), 9) AS r_after,
  round(abs(corr(l_extendedprice, l_quantity)) - abs(corr(l_extendedprice - 900 * l_quantity, l_quantity)), 9) AS reduction FROM lineitem""")
def correlation_change(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(stats.correlation_change(df, df.withColumn("l_extendedprice", F.col("l_extendedprice") - 900 * F.col("l_quantity")), [("l_extendedprice", "l_quantity")]), 9)


@query("SELECT l_returnflag AS level, round(avg(CASE WHEN (l_quantity > 25) = (l_extendedprice > 38000) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM lineitem GROUP BY 1")
def accuracy_by_level(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({"y": F.col("l_quantity") > 25, "p": F.col("l_extendedprice") > 38000})
    return rounded(stats.accuracy_by_level(df, "l_returnflag", "y", "p"), 9)


@query("SELECT substr(p_type, 1, 3) AS prefix, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def prefix_counts(spark, sf):
    return stats.prefix_counts(table(spark, sf, "part"), "p_type")


@query("""SELECT 'big' AS flag, count(*) FILTER (WHERE l_quantity > 40) AS n, round(100.0 * count(*) FILTER (WHERE l_quantity > 40) / count(*), 9) AS pct FROM lineitem
UNION ALL SELECT 'taxed', count(*) FILTER (WHERE l_tax > 0), round(100.0 * count(*) FILTER (WHERE l_tax > 0) / count(*), 9) FROM lineitem""")
def flag_prevalence(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") > 40).alias("big"), (F.col("l_tax") > 0).cast("int").alias("taxed"))
    return rounded(stats.prevalence(df, ["big", "taxed"]), 9)


@query("SELECT id, count(DISTINCT t) AS n_tables FROM (SELECT c_custkey AS id, 'a' t FROM customer UNION ALL SELECT s_suppkey, 'b' FROM supplier UNION ALL SELECT p_partkey, 'c' FROM part) GROUP BY 1 HAVING count(DISTINCT t) > 1")
def id_overlap(spark, sf):
    rename = lambda n, k: table(spark, sf, n).select(F.col(k).alias("id"))
    return stats.overlap({"a": rename("customer", "c_custkey"), "b": rename("supplier", "s_suppkey"), "c": rename("part", "p_partkey")}, "id")


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 3.0 / count(*) OVER ()) AS INTEGER) AS part FROM orders")
def date_thirds(spark, sf):
    return stats.split_thirds(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "part")


@query("SELECT event_id, CAST(floor(value / 24) AS INTEGER) % 7 AS weekday, round(value - 24 * floor(value / 24), 6) AS time_of_day, CASE WHEN value > 0 AND value <= 8 THEN 'a' WHEN value > 8 AND value <= 16 THEN 'b' WHEN value > 16 AND value <= 24 THEN 'c' END AS shift FROM events")
def hours(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", X.weekday(v).alias("weekday"), F.round(X.time_of_day(v), 6).alias("time_of_day"), X.cut(v, [0, 8, 16, 24], ["a", "b", "c"]).alias("shift"))


@query("SELECT l_orderkey, l_linenumber, round(exp(ln(l_extendedprice + 1e-7)), 4) AS log_trip, CASE WHEN l_discount + 1e-7 > 0 AND l_discount + 1e-7 < 1 THEN round(1 / (1 + exp(-ln((l_discount + 1e-7) / (1 - l_discount - 1e-7)))), 6) END AS logit_trip FROM lineitem")
def transform_roundtrip(spark, sf):
    trip = lambda n, k: X.inverse(X.forward(F.col(n), k), k)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(trip("l_extendedprice", "log"), 4).alias("log_trip"), F.round(trip("l_discount", "logit"), 6).alias("logit_trip"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, least(greatest(l_extendedprice / 100 - 50, 0), 255) AS clipped, round(log10(l_quantity + 1) * 255 / log10(255), 6) AS fsc_log FROM lineitem")
def clip_and_log(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", X.clip(F.col("l_extendedprice") / 100 - 50).alias("clipped"), F.round(X.fsc_log(F.col("l_quantity")), 6).alias("fsc_log"))


# --- profiles and correlations -------------------------------------------------------------------------------------


@query("""SELECT "column", n, missing, "distinct" FROM (
  SELECT 'o_orderstatus' AS "column", count(*) n, count(*) - count(o_orderstatus) missing, count(DISTINCT o_orderstatus) "distinct" FROM orders UNION ALL
  SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders UNION ALL
  SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders)""")
def profile_columns(spark, sf):
    return profile.profile_columns(table(spark, sf, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority")).select("column", "n", "missing", "distinct")


@query("""SELECT count(*) AS n_rows, 2::INTEGER AS n_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicates,
  round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))) / count(*), 9) AS duplicate_pct FROM lineitem""")
def profile_table(spark, sf):
    return rounded(profile.profile_table(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")), 9)


@query("""SELECT 'a' AS "column", round(100.0 * avg(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END), 6) AS missing_pct FROM lineitem UNION ALL
SELECT 'b', 0.0 UNION ALL SELECT '*', round(50.0 * avg(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END), 6) FROM lineitem""")
def missing_share(spark, sf):
    return rounded(clean.missing_share(table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") <= 40, 1).alias("a"), F.lit(1).alias("b"))))


@query("SELECT 'l_quantity' AS \"column\", count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max FROM lineitem")
def describe(spark, sf):
    return rounded(profile.describe(table(spark, sf, "lineitem"), ["l_quantity"]))


@query("""SELECT * FROM (VALUES ('c_acctbal', 'common', 'double', 'double'), ('c_custkey', 'type differs', 'bigint', 'string'), ('c_mktsegment', 'only in first', 'string', NULL), ('extra', 'only in second', NULL, 'int')) t("column", status, type_1, type_2)""")
def compare_columns(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return profile.compare_columns(df, df.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_acctbal", F.lit(1).alias("extra")))


@query("SELECT 'n_name' AS \"column\", 25::BIGINT AS n, 25::BIGINT AS \"distinct\", count(*) AS n_2, count(DISTINCT n_name) AS distinct_2 FROM nation WHERE n_regionkey < 3")
def compare_tables(spark, sf):
    df = table(spark, sf, "nation").select("n_name")
    return profile.compare_tables(df, table(spark, sf, "nation").where("n_regionkey < 3").select("n_name")).select("column", "n", "distinct", "n_2", "distinct_2")


@query("SELECT 'a' AS \"column\", 'numeric' AS kind UNION ALL SELECT 'b', 'datetime' UNION ALL SELECT 'c', 'text'")
def inferred_types(spark, sf):
    df = table(spark, sf, "orders").selectExpr("cast(o_totalprice as string) as a", "date_format(o_orderdate, 'yyyy/MM/dd') as b", "o_orderpriority as c")
    return spark.createDataFrame([(n, profile.inferred_type(df, n)) for n in df.columns], "column string, kind string")


_PAIRS = [(a, b) for a in MEASURES for b in MEASURES if a != b]


@query(" UNION ALL ".join(f"SELECT '{a}' AS anchor, '{b}' AS feature, round(corr({a}, {b}), 9) AS r FROM lineitem" for a, b in _PAIRS))
def corr_pairs(spark, sf):
    return rounded(profile.corr_with(table(spark, sf, "lineitem"), MEASURES, MEASURES), 9)


@query(" UNION ALL ".join(f"SELECT '{a}' AS anchor, '{b}' AS feature, round(corr(CASE WHEN l_linenumber > 1 THEN {a} END, {b}), 9) AS r FROM lineitem" if a == "l_tax" else f"SELECT '{a}', '{b}', round(corr({a}, {b if b != 'l_tax' else 'CASE WHEN l_linenumber > 1 THEN l_tax END'}), 9) FROM lineitem" for a, b in sorted(_PAIRS, key=lambda p: p[0] != "l_tax")))
def corr_matrix(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") > 1, F.col("l_tax")))
    return rounded(profile.corr_matrix(df, MEASURES, MEASURES), 9)


@query(" UNION ALL ".join(f"SELECT 'l_quantity' AS anchor, '{n}' AS feature, round(corr(l_quantity, {e}), 9) AS r FROM lineitem HAVING corr(l_quantity, {e}) >= 0.5" for n, e in (("l_extendedprice", "l_extendedprice"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("amount", "(l_quantity + 100 * l_discount)"), ("less", "(l_tax - l_quantity)"))))
def corr_report(spark, sf):
    df = table(spark, sf, "lineitem").select(*MEASURES, (F.col("l_quantity") + 100 * F.col("l_discount")).alias("amount"), (F.col("l_tax") - F.col("l_quantity")).alias("less"))
    return rounded(profile.correlation_report(df, ["l_quantity"], 0.5), 9)


@query("SELECT round((abs(corr(l_quantity, l_tax) - corr(l_quantity * l_tax, l_tax)) + abs(corr(l_quantity, l_discount) - corr(l_quantity * l_tax, l_discount)) + abs(corr(l_tax, l_discount) - corr(l_tax, l_discount))) / 3, 9) AS mean_abs_difference, 3::BIGINT AS n_pairs FROM lineitem")
def corr_difference(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(profile.corr_difference(df, df.withColumn("l_quantity", F.col("l_quantity") * F.col("l_tax")), ["l_quantity", "l_tax", "l_discount"]), 9)


# --- gates and samples ---------------------------------------------------------------------------------------------

GATES = {"low": [[-0.6, -0.6], [0.05, -0.5], [0.1, 0.1], [-0.5, 0.05]], "mid": [[-0.1, -0.1], [0.3, -0.05], [0.2, 0.3], [-0.05, 0.2]], "line": [[0, 0], [1, 1]]}


def _inside_sql(x: str, y: str, polygon: list) -> str:
    terms = [f"CASE WHEN (({y1!r} <= {y}) <> ({y2!r} <= {y})) AND {x} < {x1!r} + ({y} - {y1!r}) * {(x2 - x1) / (y2 - y1)!r} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True) if y1 != y2]
    return f"(({' + '.join(terms)}) % 2 = 1)"


_POINTS = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"
_IN = {k: _inside_sql("x", "y", [[float(a), float(b)] for a, b in p]) for k, p in GATES.items() if len(p) > 2}
_FIRST = f"CASE WHEN {_IN['low']} THEN 'low' WHEN {_IN['mid']} THEN 'mid' END"
_LAST = f"CASE WHEN {_IN['mid']} THEN 1 WHEN {_IN['low']} THEN 0 ELSE -1 END"


def points(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(f"SELECT vec_id, {_FIRST} AS gate FROM ({_POINTS})")
def gate_label_first(spark, sf):
    return gating.label_gates(points(spark, sf), GATES, "x", "y").select("vec_id", "gate")


@query(f"SELECT vec_id, {_LAST} AS gate FROM ({_POINTS})")
def gate_label_last(spark, sf):
    return gating.label_gates(points(spark, sf), GATES, "x", "y", "last").select("vec_id", "gate")


@query(f"SELECT vec_id, {_FIRST} AS gate FROM ({_POINTS})")
def gate_all(spark, sf):
    return gating.label_all_gates(points(spark, sf), {"low": ("x", "y", GATES["low"]), "mid": ("x", "y", GATES["mid"]), "absent": ("x", "z", GATES["low"])}).select("vec_id", "gate")


@query(f"SELECT vec_id, x, y FROM ({_POINTS}) WHERE {_IN['mid']}")
def gate_filter(spark, sf):
    return gating.in_gate(points(spark, sf), GATES["mid"], "x", "y").select("vec_id", "x", "y")


@query(f"""WITH g AS (SELECT label, {_FIRST} AS gate FROM ({_POINTS}))
SELECT label, gate, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 9) AS proportion FROM g GROUP BY 1, 2""")
def gate_counts(spark, sf):
    return rounded(gating.gate_counts(gating.label_gates(points(spark, sf), GATES, "x", "y"), by=["label"]), 9)


@query(f"""WITH g AS (SELECT x, y, {_FIRST} AS gate FROM ({_POINTS}))
SELECT gate, count(*) AS n, round(avg(x), 9) AS mean_x, round(avg(y), 9) AS mean_y, round(covar_pop(x, x) + 1e-6, 9) AS cov_x_x, round(covar_pop(x, y), 9) AS cov_x_y, round(covar_pop(y, y) + 1e-6, 9) AS cov_y_y FROM g WHERE gate IS NOT NULL GROUP BY 1""")
def gate_gaussians(spark, sf):
    return rounded(gating.gate_gaussians(gating.label_gates(points(spark, sf), GATES, "x", "y"), ["x", "y"]), 9)


@query(f"SELECT 'low' AS gate, count(*) FILTER (WHERE {_IN['low']}) AS n_components, round(sum(CASE WHEN {_IN['low']} THEN 0.5 ELSE 0 END), 6) AS weight FROM ({_POINTS}) UNION ALL SELECT 'mid', count(*) FILTER (WHERE {_IN['mid']}), round(sum(CASE WHEN {_IN['mid']} THEN 0.5 ELSE 0 END), 6) FROM ({_POINTS})")
def component_coverage(spark, sf):
    means = points(spark, sf).withColumn("w", F.lit(0.5))
    return rounded(gating.component_coverage(means, {k: p for k, p in GATES.items() if k != "line"}, "x", "y", "w"))


@query("""WITH k AS (SELECT label, count(*) n FROM embeddings GROUP BY 1), w AS (SELECT label, n, sqrt(n) / sum(sqrt(n)) OVER () AS w FROM k)
SELECT label, least(n, greatest(CAST(floor(w * 200) AS BIGINT), 15)) AS n FROM w""")
def stratified_quota(spark, sf):
    df = points(spark, sf)
    return sampling.stratified_sample(df, F.col("label"), 200, 15, "sqrt", ["vec_id"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test, count(*) - CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS train FROM embeddings GROUP BY 1")
def stratified_split(spark, sf):
    train, test = sampling.stratified_split(points(spark, sf), ["label"], 0.2, ["vec_id"])
    both = train.select("label", F.lit(0).alias("t")).union(test.select("label", F.lit(1).alias("t")))
    return both.groupBy("label").agg(F.sum("t").cast("long").alias("test"), F.sum(1 - F.col("t")).cast("long").alias("train"))


@query("SELECT least(count(*), 100) AS n FROM embeddings")
def exact_sample(spark, sf):
    return sampling.exact_sample(points(spark, sf), 100, ["vec_id"]).agg(F.countDistinct("vec_id").alias("n"))


# --- histograms ----------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, least(CAST(floor(l_quantity + 0.5) AS INTEGER), 39) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN -0.5 AND 39.5 GROUP BY 1, 2")
def hist_rebin(spark, sf):
    return transport.rebin(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"], 40)


def histograms(spark, sf):
    """One histogram a supplier: RBC of quantities, PLT of line numbers."""
    df = table(spark, sf, "lineitem")
    return df.groupBy(F.col("l_suppkey").cast("string").alias("Sample No.")).agg(*[F.count_if(F.col("l_quantity") == i).cast("double").alias(f"RBC_RAW_{i:03d}") for i in range(51)], *[F.count_if(F.col("l_linenumber") * 3 == i).cast("double").alias(f"PLT_RAW_{i:03d}") for i in range(26)])


@query("SELECT b.i::INTEGER AS bin, count(l_linenumber)::DOUBLE AS count FROM range(26) b(i) LEFT JOIN lineitem ON l_linenumber * 3 = b.i GROUP BY 1")
def hist_sum(spark, sf):
    return transport.histogram_sum(histograms(spark, sf), "PLT")


@query("SELECT b.i::INTEGER AS bin, round(count(l_linenumber)::DOUBLE / (SELECT count(DISTINCT l_suppkey) FROM lineitem), 6) AS count FROM range(26) b(i) LEFT JOIN lineitem ON l_linenumber * 3 = b.i GROUP BY 1")
def hist_mean(spark, sf):
    return rounded(transport.histogram_mean(histograms(spark, sf), "PLT"))


@query()
def histogram_align(spark, sf):
    df = histograms(spark, sf)
    target = df.select("`Sample No.`", *[X.c(n) for n in df.columns[1:2]], *[X.c(df.columns[max(1, i - 3)]).alias(n) for i, n in enumerate(df.columns) if i > 1])
    return api.HistogramAligner(2000).fit(df, target).transform(df)


# --- transport and models ------------------------------------------------------------------------------------------


def frozen() -> gmm.Transport:
    a = gmm.Mixture(np.array([0.4, 0.6]), np.array([[40.0, 60.0], [150.0, 120.0]]), np.array([[[400.0, 50.0], [50.0, 300.0]], [[900.0, -100.0], [-100.0, 500.0]]]))
    b = gmm.Mixture(np.array([0.5, 0.5]), np.array([[50.0, 70.0], [160.0, 100.0]]), np.array([[[300.0, 0.0], [0.0, 350.0]], [[800.0, 100.0], [100.0, 600.0]]]))
    return gmm.transport_between(a, b)


def _frozen_sql(method: str) -> str:
    t = frozen()

    def score(k: int) -> str:
        p = np.linalg.inv(t.source.covariances[k])
        m = t.source.means[k]
        const = -0.5 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(t.source.covariances[k])[1]) + (np.log(t.source.weights[k]) if method == "max" else 0)
        return f"({const!r} - 0.5 * ({p[0, 0]!r} * (x - {m[0]!r}) * (x - {m[0]!r}) + {2 * p[0, 1]!r} * (x - {m[0]!r}) * (y - {m[1]!r}) + {p[1, 1]!r} * (y - {m[1]!r}) * (y - {m[1]!r})))".replace("np.float64", "")

    def move(k: int, i: int) -> str:
        at = [int(t.omega[k].argmax())] if method == "max" else [j for j in range(2) if t.omega[k, j] >= 0.05]
        w = [t.omega[k, j] / sum(t.omega[k, q] for q in at) for j in at]
        a = sum(u * t.maps[k, j] for u, j in zip(w, at, strict=True))
        b = sum(u * (t.target.means[j] - t.maps[k, j] @ t.source.means[k]) for u, j in zip(w, at, strict=True))
        return f"round(least(greatest({float(a[i, 0])!r} * x + {float(a[i, 1])!r} * y + {float(b[i])!r}, 0), 255), 6)"

    pick = lambda i: f"CASE WHEN {score(0)} >= {score(1)} THEN {move(0, i)} ELSE {move(1, i)} END"
    return f"SELECT vec_id, {pick(0)} AS x, {pick(1)} AS y FROM (SELECT vec_id, 128 + 300 * x AS x, 128 + 300 * y AS y FROM ({_POINTS}))"


def scaled(spark, sf):
    return points(spark, sf).select("vec_id", "label", (128 + 300 * F.col("x")).alias("x"), (128 + 300 * F.col("y")).alias("y"))


@query(_frozen_sql("max"))
def transport_max_frozen(spark, sf):
    return rounded(transport.transport_events(scaled(spark, sf).drop("label"), ["x", "y"], frozen(), "max"))


@query(_frozen_sql("weight"))
def transport_weight_frozen(spark, sf):
    return rounded(transport.transport_events(scaled(spark, sf).drop("label"), ["x", "y"], frozen(), "weight", preserve_rare=False))


def _rand_sql() -> str:
    """Pairs in order, a running sum of density times plan, the first pair that exceeds u of the whole."""
    t = frozen()
    pairs = [(i, j) for i in range(2) for j in range(2) if t.omega[i, j] > 0]

    def chance(i: int, j: int) -> str:
        p, m = np.linalg.inv(t.source.covariances[i]).tolist(), t.source.means[i].tolist()
        size = float(t.omega[i, j] / np.sqrt(np.linalg.det(t.source.covariances[i])))
        return f"{size!r} * exp(-0.5 * ({p[0][0]!r} * (x - {m[0]!r}) ** 2 + {2 * p[0][1]!r} * (x - {m[0]!r}) * (y - {m[1]!r}) + {p[1][1]!r} * (y - {m[1]!r}) ** 2))"

    def move(i: int, j: int, a: int) -> str:
        m = t.maps[i, j].tolist()
        b = float((t.target.means[j] - t.maps[i, j] @ t.source.means[i])[a])
        return f"round(least(greatest({m[a][0]!r} * x + {m[a][1]!r} * y + {b!r}, 0), 255), 6)"

    n = len(pairs)
    sums = ", ".join(f"{' + '.join(f'p{q}' for q in range(k + 1))} AS s{k}" for k in range(n))
    pick = lambda a: "CASE " + " ".join(f"WHEN s{k} > u * s{n - 1} THEN {move(*pairs[k], a)}" for k in range(n)) + " END"
    return f"""WITH e AS (SELECT vec_id, 128 + 300 * x AS x, 128 + 300 * y AS y, CAST('0x' || substr(md5('7|' || vec_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM ({_POINTS})),
p AS (SELECT *, {", ".join(f"{chance(*q)} AS p{k}" for k, q in enumerate(pairs))} FROM e), s AS (SELECT *, {sums} FROM p)
SELECT vec_id, {pick(0)} AS x, {pick(1)} AS y FROM s"""


@query(_rand_sql())
def transport_rand_frozen(spark, sf):
    return rounded(transport.transport_events(scaled(spark, sf).drop("label"), ["x", "y"], frozen(), "rand", keys=["vec_id"], seed=7))


def _step_sql() -> str:
    """Sums of a round of expectation-maximisation: for each component, of posterior times 1, x, y, xx, xy, yy; and the log-likelihood."""
    m = frozen().source

    def density(k: int) -> str:
        p, mean = np.linalg.inv(m.covariances[k]).tolist(), m.means[k].tolist()
        size = float(m.weights[k] / (2 * np.pi * np.sqrt(np.linalg.det(m.covariances[k]))))
        return f"{size!r} * exp(-0.5 * ({p[0][0]!r} * (x - {mean[0]!r}) ** 2 + {2 * p[0][1]!r} * (x - {mean[0]!r}) * (y - {mean[1]!r}) + {p[1][1]!r} * (y - {mean[1]!r}) ** 2))"

    parts = " UNION ALL ".join(f"SELECT {k} AS component, round(sum(r), 6) AS n, round(sum(r * x), 4) AS x, round(sum(r * y), 4) AS y, round(sum(r * x * x), 2) AS xx, round(sum(r * x * y), 2) AS xy, round(sum(r * y * y), 2) AS yy FROM (SELECT x, y, d{k} / (d0 + d1) AS r FROM e)" for k in range(2))
    return f"""WITH e AS (SELECT x, y, {density(0)} AS d0, {density(1)} AS d1 FROM (SELECT 128 + 300 * x AS x, 128 + 300 * y AS y FROM ({_POINTS})) WHERE x IS NOT NULL AND y IS NOT NULL)
{parts} UNION ALL SELECT -1, round(sum(ln(d0 + d1)), 6), count(*), NULL, NULL, NULL, NULL FROM e"""


@query(_step_sql())
def mixture_step(spark, sf):
    out = mixtures.expectation(scaled(spark, sf), ["x", "y"], [frozen().source])
    return out.select("component", *[F.round(F.get("sums", F.lit(i)), d).alias(n) for i, (n, d) in enumerate(zip(["n", "x", "y", "xx", "xy", "yy"], [6, 4, 4, 2, 2, 2], strict=True))])


@query()
def mixture_fit(spark, sf):
    """A mixture over all rows from a fixed start: its components and the rounds' mean log-likelihood."""
    df = scaled(spark, sf)
    found = mixtures.fit(df, ["x", "y"], [frozen().source], max_iter=20, tol=1e-6)
    ends = mixtures.expectation(df, ["x", "y"], [found]).where("component = -1").select((F.col("sums")[0] / F.col("sums")[1]).alias("likelihood"))
    parts = spark.createDataFrame([(k, float(found.weights[k]), *map(float, found.means[k])) for k in range(found.k)], "component int, weight double, x double, y double")
    return parts.join(F.broadcast(ends))  # one row


@query()
def event_align(spark, sf):
    df = scaled(spark, sf)
    s, t = df.where("label < 5"), df.where("label >= 5").withColumn("x", F.col("x") * 0.8 + 30)
    return api.EventAligner("RET", 6, columns=["x", "y"], use_gates=False, n_init=2).fit(s, t).transform(s, ["vec_id"])


@query()
def event_align_gated(spark, sf):
    df = scaled(spark, sf)
    gates = {"left": [[0, 0], [128, 0], [128, 256], [0, 256]], "right": [[128, 0], [256, 0], [256, 256], [128, 256]]}
    model = api.EventAligner("RET", 6, columns=["SFL", "FSC"], gates=gates, stratified=True, least_per_gate=20, method="weight")
    named = lambda d: d.select("vec_id", F.col("x").alias("SFL"), F.col("y").alias("FSC"))
    return model.fit(named(df.where("label < 5")), named(df.where("label >= 5"))).transform(named(df), ["vec_id"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_linenumber) + avg(l_extendedprice) OVER (), 1) AS l_extendedprice FROM lineitem""")
def factor_residual(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    model = api.CovariateCorrector(["l_linenumber"], ["l_extendedprice"], terms=[("f", "l_linenumber")], lam=0.0)
    return rounded(model.fit_transform(df), 1)


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_linenumber, l_returnflag) + avg(l_extendedprice) OVER (PARTITION BY l_returnflag), 1) AS l_extendedprice FROM lineitem""")
def factor_residual_by_group(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    model = api.CovariateCorrector(["l_linenumber"], ["l_extendedprice"], group="l_returnflag", terms=[("f", "l_linenumber")], lam=0.0)
    return rounded(model.fit_transform(df).drop("l_linenumber"), 1)


@query()
def spline_correct(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", "l_returnflag")
    return api.CovariateCorrector(["l_quantity", "l_tax"], ["l_extendedprice"], group="l_returnflag", n_splines=12, normalise_groups=True).fit_transform(df)


@query()
def tensor_correct(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    return api.CovariateCorrector(["l_quantity", "l_tax"], ["l_extendedprice"], terms=[("te", "l_quantity", "l_tax")], n_splines=6).fit_transform(df)


def frozen_design(tensor: bool) -> tuple[gam.Design, np.ndarray]:
    """A design over quantity and tax with coefficients that no data were fitted for."""
    axes = {"l_quantity": gam.Axis("ps", 1.0, 50.0, 8), "l_tax": gam.Axis("cp" if not tensor else "ps", 0.0, 0.08, 6)}
    terms = [("te", "l_quantity", "l_tax")] if tensor else [("s", "l_quantity"), ("s", "l_tax")]
    design = gam.Design(["l_quantity", "l_tax"], terms, axes)
    return design, np.round(np.random.default_rng(5).normal(size=1 + sum(design.sizes())) * 1000, 3)


def _design_sql(tensor: bool) -> str:
    design, coef = frozen_design(tensor)
    values = f"[{', '.join(repr(float(v)) for v in coef)}]"
    places = []
    for n, axis in design.axes.items():
        m = axis.n if axis.kind == "cp" else axis.n - 3
        share = f"(({n} - {axis.low!r}) / {axis.high - axis.low!r})"
        u = f"({share} - floor({share})) * {m}" if axis.kind == "cp" else f"least(greatest({share}, 0), 1) * {m}"
        places.append(f"{u} AS u_{n}, CAST(least(floor({u}), {m - 1}) AS BIGINT) AS k_{n}")
    four = lambda n: [f"(1 - t_{n}) ** 3 / 6", f"(3 * t_{n} ** 3 - 6 * t_{n} ** 2 + 4) / 6", f"(-3 * t_{n} ** 3 + 3 * t_{n} ** 2 + 3 * t_{n} + 1) / 6", f"t_{n} ** 3 / 6"]
    at = lambda n, i: f"((k_{n} + {i}) % {design.axes[n].n})"
    a, b = design.axes
    if tensor:
        terms = [f"({p}) * ({q}) * c[2 + {at(a, i)} * {design.axes[b].n} + {at(b, j)}]" for i, p in enumerate(four(a)) for j, q in enumerate(four(b))]
    else:
        terms = [f"({p}) * c[2 + {first} + {at(n, i)}]" for n, first in ((a, 0), (b, design.axes[a].n)) for i, p in enumerate(four(n))]
    return f"""WITH u AS (SELECT {KEY}, l_extendedprice, {", ".join(places)} FROM lineitem), t AS (SELECT *, u_{a} - k_{a} AS t_{a}, u_{b} - k_{b} AS t_{b}, {values} AS c FROM u)
SELECT {KEY}, round(l_extendedprice + 100 - (c[1] + {" + ".join(terms)}), 3) AS l_extendedprice FROM t"""


def _corrected_by(spark: SparkSession, sf: str, tensor: bool) -> DataFrame:
    design, coef = frozen_design(tensor)
    df = table(spark, sf, "lineitem").selectExpr(*KEY.split(", "), "l_extendedprice", "l_quantity", "l_tax")
    out = gam.apply_corrections(df, ["l_extendedprice"], design, gam.fits_of(df, ["l_extendedprice"], {("l_extendedprice", None): (coef, 100.0)}), None)
    return rounded(out.drop("l_quantity", "l_tax"), 3)


@query(_design_sql(False))
def spline_frozen(spark, sf):
    """Ordinary and cyclic splines with given coefficients."""
    return _corrected_by(spark, sf, False)


@query(_design_sql(True))
def tensor_frozen(spark, sf):
    return _corrected_by(spark, sf, True)


@query(f"""WITH b AS (SELECT {KEY}, l_returnflag, CAST(l_extendedprice AS DOUBLE) AS y, (CAST(l_quantity AS DOUBLE) - 25.5) / 24.5 AS x FROM lineitem WHERE l_returnflag IS NOT NULL),
o AS (SELECT *, x - avg(x) OVER g AS p, y - avg(y) OVER g AS r, avg(y) OVER g AS m FROM b WINDOW g AS (PARTITION BY l_returnflag)),
q0 AS (SELECT *, x * x - avg(x * x) OVER g - p * sum(x * x * p) OVER g / sum(p * p) OVER g AS q FROM o WINDOW g AS (PARTITION BY l_returnflag)),
s0 AS (SELECT *, x * x * x - avg(x * x * x) OVER g - p * sum(x * x * x * p) OVER g / sum(p * p) OVER g - q * sum(x * x * x * q) OVER g / sum(q * q) OVER g AS s FROM q0 WINDOW g AS (PARTITION BY l_returnflag))
SELECT {KEY}, l_returnflag, round(m + r - p * sum(r * p) OVER g / sum(p * p) OVER g - q * sum(r * q) OVER g / sum(q * q) OVER g - s * sum(r * s) OVER g / sum(s * s) OVER g, 3) AS l_extendedprice
FROM s0 WINDOW g AS (PARTITION BY l_returnflag)""")
def spline_fitted(spark, sf):
    """Splines fitted by group. Four of them without a penalty span the cubic polynomials, so the normal equations can be solved by
    orthogonal polynomials in SQL."""
    df = table(spark, sf, "lineitem").where("l_returnflag is not null").selectExpr(*KEY.split(", "), "l_returnflag", "l_extendedprice", "l_quantity")
    out = api.CovariateCorrector(["l_quantity"], ["l_extendedprice"], group="l_returnflag", n_splines=4, lam=0.0).fit_transform(df)
    return rounded(out.drop("l_quantity"), 3)


@query()
def domain_encoder(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("label") % 2).alias("task"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(16)])
    return api.DomainEncoder([f"e{i}" for i in range(16)], ["task"], ["label"], latent_dim=8, hidden_dims=(32, 16)).fit(df, max_epochs=5).transform(df).select("vec_id", "shared", "private", "tasks", "domains", "domain_entropy", "reconstruction_error")


@query(f"""WITH p AS ({_POINTS}), m AS (SELECT avg(x) mx, avg(y) my, covar_samp(x, x) a, covar_samp(x, y) b, covar_samp(y, y) c FROM p), e AS (SELECT mx, my, cos(0.5 * atan2(2 * b, a - c)) co, sin(0.5 * atan2(2 * b, a - c)) si FROM m),
s AS (SELECT *, CASE WHEN abs(co) >= abs(si) THEN sign(co) ELSE sign(si) END s1, CASE WHEN abs(si) >= abs(co) THEN sign(-si) ELSE sign(co) END s2 FROM e)
SELECT vec_id, round(((x - mx) * co + (y - my) * si) * s1, 6) AS first, round(((y - my) * co - (x - mx) * si) * s2, 6) AS second FROM p, s""")
def principal_components(spark, sf):
    return rounded(encoder.principal_components(points(spark, sf), ["x", "y"], 2).select("vec_id", F.col("pca")[0].alias("first"), F.col("pca")[1].alias("second")))


def _distances_sql() -> str:
    turns = ", ".join(f"({i}, {float(u)!r}, {float(v)!r})" for i, (u, v) in enumerate(stats.directions(2)))
    return f"""WITH p AS (SELECT vec_id, label < 5 AS side, 128 + 300 * x AS x, 128 + 300 * y AS y FROM ({_POINTS}) WHERE label IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT CASE WHEN a.side = b.side THEN 1 ELSE -1 END * avg(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 200)) AS m FROM p a, p b GROUP BY a.side, b.side),
n AS (SELECT count(*) FILTER (WHERE side) AS na, count(*) FILTER (WHERE NOT side) AS nb FROM p), d(i, u, v) AS (VALUES {turns}),
z AS (SELECT i, vec_id, u * x + v * y AS z, CASE WHEN side THEN 1.0::DOUBLE / na ELSE -1.0::DOUBLE / nb END AS f FROM p, d, n),
g AS (SELECT i, abs(sum(f) OVER (PARTITION BY i ORDER BY z, vec_id ROWS UNBOUNDED PRECEDING)) * (lead(z) OVER (PARTITION BY i ORDER BY z, vec_id) - z) AS w FROM z)
SELECT (SELECT round(sum(m), 6) FROM k) AS mmd, (SELECT round(avg(w), 6) FROM (SELECT sum(w) AS w FROM g GROUP BY i)) AS sliced_wasserstein"""


@query(_distances_sql())
def distribution_distances(spark, sf):
    df = scaled(spark, sf)
    a, b = df.where("label < 5"), df.where("label >= 5")
    return rounded(spark.createDataFrame([(stats.mmd(a, b, ["x", "y"]), stats.sliced_wasserstein(a, b, ["x", "y"]))], "mmd double, sliced_wasserstein double"))


@query()
def transport_distance(spark, sf):
    df = scaled(spark, sf)
    return spark.createDataFrame([(stats.mixture_distance(df.where("label < 5"), df.where("label >= 5"), ["x", "y"]),)], "wasserstein_2 double")


@query("SELECT 'l_quantity' AS \"column\", round(avg((l_quantity - l_linenumber) * (l_quantity - l_linenumber)), 6) AS mse FROM lineitem UNION ALL SELECT 'l_tax', round(avg((l_tax - l_discount) * (l_tax - l_discount)), 9) FROM lineitem")
def feature_errors(spark, sf):
    out = encoder.feature_errors(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], ["l_linenumber", "l_discount"])
    return out.select("column", F.when(F.col("column") == "l_tax", F.round("mse", 9)).otherwise(F.round("mse", 6)).alias("mse"))


@query()
def logistic_accuracy(spark, sf):
    return spark.createDataFrame([(encoder.logistic_accuracy(table(spark, sf, "embeddings"), "embedding", "label"),)], "accuracy double")


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_ids, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) AS n_repeated FROM lineitem")
def group_sizes(spark, sf):
    return stats.group_sizes(table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT event_id, 'RET' AS channel, 'AN-20^14232' AS analyser_id, CAST(user_id AS VARCHAR) AS sample_number, event_id % 2 = 1 AS overflow, 'RET_[AN-20^14232][00-22_123][20211002_001515][   ' || user_id || '].116.csv' AS file_key FROM events")
def file_names(spark, sf):
    name = F.concat(F.lit("RET_[AN-20^14232][00-22_123][20211002_001515][   "), F.col("user_id").cast("string"), F.lit("].116"), F.when(F.col("event_id") % 2 == 1, "(1)").otherwise(""), F.lit(".csv"))
    facts = events.file_facts(name)
    return table(spark, sf, "events").select("event_id", *[facts[n].alias(n) for n in ("channel", "analyser_id", "sample_number")], events.is_overflow(name).alias("overflow"), events.file_key(name).alias("file_key"))


@query("SELECT event_id, value AS \"SFL\", 2 * value AS \"FSC\", 3 * value AS \"SSC\", CASE WHEN user_id % 2 = 0 THEN 255.0 ELSE 4 * value END AS \"FSCW\" FROM events WHERE user_id % 3 = 0")
def channel_events(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "value as SFL", "2 * value as FSC", "3 * value as SSC", "4 * value as FSCW", "user_id % 3 as RepeatCount", "if(user_id % 2 = 0, 'A', 'B') as Phase")
    return events.preprocess(df, "PLTF", ["event_id"])


@query("""WITH t AS (SELECT DISTINCT CASE WHEN l_suppkey % 50 = 0 THEN 'QC-' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS id, strftime(l_shipdate, '%Y/%m/%d') AS d, strftime(l_shipdate, '%H:%M:%S') AS s,
  l_tax > 0.02 AS cbc, CAST(l_quantity AS VARCHAR) AS w, CASE WHEN l_discount > 0.09 THEN '----' ELSE CAST(l_extendedprice AS VARCHAR) END AS r, CAST(l_tax AS VARCHAR) AS h, l_returnflag, l_tax > 0.05 AS p, l_discount = 0 AS ip FROM lineitem),
f AS (SELECT id, d, s, w, r, h, p::INTEGER AS p, ip::INTEGER AS ip FROM t WHERE NOT starts_with(id, 'QC-') AND NOT ip),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, s, w, r, h, p, ip) AS rn, count(*) OVER (PARTITION BY id) AS n, TRY_CAST(w AS DOUBLE) AS x, TRY_CAST(r AS DOUBLE) AS y, TRY_CAST(h AS DOUBLE) AS z FROM f),
e AS (SELECT stddev_samp(x) AS x, stddev_samp(y) AS y, stddev_samp(z) AS z FROM o),
v AS (SELECT a.id, CASE WHEN abs(a.x - b.x) > e.x THEN 0 ELSE 1 END + CASE WHEN abs(a.y - b.y) > e.y THEN 0 ELSE 1 END + CASE WHEN abs(a.z - b.z) > e.z THEN 0 ELSE 1 END AS ok FROM o a JOIN o b ON a.id = b.id AND a.rn = 1 AND b.rn = 2, e)
SELECT o.id AS "Sample No.", d AS "Date", s AS "Time", x AS "WBC(10^3/uL)", y AS "RBC(10^6/uL)", z AS "HGB(g/dL)", CAST(NULL AS DOUBLE) AS "WBC/M", p AS "Positive(Diff)", ip AS "IP SUS(RBC)RBC Agglutination?"
FROM o LEFT JOIN v ON o.id = v.id WHERE rn = 1 AND (n = 1 OR ok >= 2)""")
def clean_table(spark, sf):
    """The whole cleaning of a sample table made of line items."""
    df = table(spark, sf, "lineitem").selectExpr("if(l_suppkey % 50 = 0, concat('QC-', l_orderkey), cast(l_orderkey as string)) as `Sample No.`", "date_format(l_shipdate, 'yyyy/MM/dd') as `Date`", "date_format(l_shipdate, 'HH:mm:ss') as `Time`", "if(l_tax > 0.02, 'CBC+DIFF', 'FREE SELECT') as `Discrete`", "cast(l_quantity as string) as `WBC(10^3/uL)`", "if(l_discount > 0.09, '----', cast(l_extendedprice as string)) as `RBC(10^6/uL)`", "cast(l_tax as string) as `HGB(g/dL)`", "l_returnflag as `WBC/M`", "if(l_tax > 0.05, 'Diff.', null) as `Positive(Diff)`", "if(l_discount = 0.0, 1, null) as `IP SUS(RBC)RBC Agglutination?`")
    return api.SampleCleaner().clean(df).main
