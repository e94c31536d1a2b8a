"""Penalised change points of daily series: PELT with delayed minimum-length candidates and a pruning constant that the floors of its cost allow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.arrow import map_arrow
from .common import bound_arrow

#: Days that a segment has at least, and what each cut costs.
LEAST, PENALTY = 14, 40000
#: Days of all series that are looked at together.
TOGETHER = 1 << 20
FAR = 1 << 62
#: What floors can cost a day, by the floor of the smallest mean V (see `loss`); one from the last entry on.
LOSS = np.array([0, *(int(np.ceil(1000 * np.log1p(1 / f))) for f in range(1, 1001))], np.int64) + 2


def costs(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, cost) of segments of n days with sum s and sum of squares q: V = 1 + floor of the variance, cost = n * floor(1000 ln V)."""
    v = 1 + (n * q - s * s) // (n * n)
    return v, n * np.floor(1000 * np.log(v.astype(float))).astype(np.int64)


def loss(n: np.ndarray, v: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """More than cost(s, t) + cost(t, u) - cost(s, u) can be, for any u in the series: n days and V of (s, t), rest days from s to the end.

    Without floors the cost is superadditive: the variance of a whole is at least the mean variance of its parts, and ln(1 + x) is
    concave. With floors, let a be the mean of the parts' V by days. The whole's variance is at least a - 1, so its V is at
    least floor(a), and by concavity the parts' ln V add up to at most m ln a for m days in all. So the loss stays
    below m * 1000 ln(a / floor(a)) < m * 1000 ln(1 + 1 / floor(a)), and the floor of 1000 ln V adds less than one a
    day. a is at least 1 + n (V - 1) / m, as no V is below 1, and m at most `rest`: both ends of the bound are reached
    there. One more a day covers the rounding of logarithms.
    """
    return rest * LOSS[np.minimum(1 + n * (v - 1) // rest, len(LOSS) - 1).astype(np.int64)]


def cuts(series: list[np.ndarray], least: int = LEAST, penalty: int = PENALTY) -> list[tuple[list[int], int]]:
    """For each series of integers: (ends of its segments, best cost with penalties).

    All series advance by a day together; their candidates (series, start of the last segment) are one flat list, ordered by series.
    A start becomes a candidate when `least` days have passed since. Where another cut is better by more than `loss`,
    that cut can replace it, but only for ends at least `least` days later: till then it stays. Ties: fewest segments,
    then the earliest start of the last segment, and so on backwards, which is how each prefix was chosen. Numbers that
    may not fit into 64 bits are computed in Python's.
    """
    size = np.array([len(x) for x in series], np.int64)
    out: list[tuple[list[int], int]] = [([], 0)] * len(series)
    # Within a chunk the longest come first, so those that go on are its head.
    order, a = np.argsort(-size, kind="stable"), 0
    while a < len(order):
        b = min(len(order), a + max(1, min(TOGETHER // int(size[order[a]] + 1), 1 << 14)))
        for i, found in zip(order[a:b], _together([series[i] for i in order[a:b]], least, penalty), strict=True):
            out[i] = found
        a = b
    return out


def _together(series: list[np.ndarray], least: int, penalty: int) -> list[tuple[list[int], int]]:
    size = np.array([len(x) for x in series], np.int64)
    days, count = int(size.max(initial=0)), len(series)
    top = max((int(max(abs(int(x.max())), abs(int(x.min())))) for x in series if len(x)), default=0)
    kind = np.int64 if top * top * (days + 1) ** 2 < FAR // 4 else object
    p, q = (np.zeros((count, days + 1), kind) for _ in range(2))
    for i, x in enumerate(series):
        p[i, 1 : len(x) + 1] = np.cumsum(x.astype(kind))
        q[i, 1 : len(x) + 1] = np.cumsum(x.astype(kind) ** 2)
    best, parts, back = (np.zeros((count, days + 1), np.int64) for _ in range(3))
    best[:, 0] = -penalty
    who, start, until = (np.zeros(0, np.int64) for _ in range(3))
    for t in range(1, days + 1):
        if t < least:  # a series that is too short is one segment
            new = np.flatnonzero(size == t)
        elif t == least:
            new = np.flatnonzero(size >= t)
        else:
            new = np.flatnonzero(size >= t) if t >= 2 * least else np.zeros(0, np.int64)
        if len(new):
            who, start, until = np.concatenate([who, new]), np.concatenate([start, np.full(len(new), max(0, t - least))]), np.concatenate([until, np.full(len(new), FAR)])
            ranked = np.argsort(who.astype(np.int16), kind="stable")
            who, start, until = who[ranked], start[ranked], until[ranked]
        if not len(who):
            continue
        n = t - start
        v, cost = costs(n, p[who, t] - p[who, start], q[who, t] - q[who, start])
        total = best[who, start] + cost
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        runs = np.diff(np.r_[first, len(who)])
        low = np.minimum.reduceat(total, first)
        key = np.where(total == np.repeat(low, runs), parts[who, start] * (days + 1) + start, FAR)
        key = np.minimum.reduceat(key, first)
        own = who[first]
        best[own, t], parts[own, t], back[own, t] = low + penalty, key // (days + 1) + 1, key % (days + 1)
        rest = size[who] - start
        worse = total - loss(n, v, rest) > best[who, t]
        until = np.where(worse, np.minimum(until, t + least), until)
        stay = (until > t + 1) & (size[who] > t)
        who, start, until = who[stay], start[stay], until[stay]
    found = []
    for i, n in enumerate(size.tolist()):
        ends, t = [], n
        while t > 0:
            ends.append(t)
            t = int(back[i, t])
        found.append((ends[::-1], int(best[i, n])))
    return found


def change_points(df: DataFrame, key_col: str = "vendor_id", time_col: str = "shipped_at", value_col: str = "quantity", least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """One row for each segment: key_col, segment_no, first_day (days since 1970), n_days, total, spread (V), cost, n_segments, best_cost.

    A key's series is the sum of the integers of value_col by day of time_col (in the session's zone if it has one), from its first
    to its last day with rows; other days are 0. Rows without a time or value are left out, repeated ones count, a null key is a
    key of its own; an empty table gives no rows. Segments have `least` days or more (a shorter series is one segment) and
    minimise the sum of costs plus `penalty` a cut, exactly; ties as in `cuts`. Totals by key and day are summed up
    before they are shuffled, so a task gets days of keys, never rows; a key's days meet in one task.
    """
    bound_arrow(df.sparkSession)
    taken = df.select(F.col(key_col).alias("k"), F.unix_date(F.to_date(F.col(time_col))).alias("d"), F.col(value_col).cast("long").alias("x")).where("d is not null and x is not null")
    daily = taken.groupBy("k", "d").agg(F.sum("x").alias("x"))
    whole = daily.groupBy("k").agg(F.collect_list(F.struct("d", "x")).alias("s")).select("k", "s.d", "s.x")
    kind = whole.schema["k"].dataType
    names = ("first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")
    schema = T.StructType([T.StructField(key_col, kind), T.StructField("segment_no", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, series = [], []
            for d, x in zip(batch.column(1), batch.column(2), strict=True):
                d, x = d.values.to_numpy(), x.values.to_numpy()
                firsts.append(int(d.min()))
                filled = np.zeros(int(d.max()) - firsts[-1] + 1, np.int64)
                filled[d - firsts[-1]] = x
                series.append(filled)
            at, rows = [], []
            for i, (ends, cost) in enumerate(cuts(series, least, penalty)):
                a = 0
                for number, b in enumerate(ends):
                    x = series[i][a:b].astype(object)
                    n, s = b - a, int(x.sum())
                    v, c = costs(*(np.array([y], object) for y in (n, s, int((x * x).sum()))))
                    at.append(i)
                    rows.append((number + 1, firsts[i] + a, n, s, int(v[0]), int(c[0]), len(ends), cost))
                    a = b
            columns = [pa.array(x, pa.int32() if j == 0 else pa.int64()) for j, x in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int32() if j == 0 else pa.int64()) for j in range(8)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.names)

    return map_arrow(whole, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all rows of sale_lines, production parameters."""
    return change_points(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))


#: The same by dynamic programming over all starts, for DuckDB.
SQL = """
WITH RECURSIVE daily AS (
  SELECT vendor_id, CAST(shipped_at AS DATE) - DATE '1970-01-01' AS d, CAST(sum(quantity) AS BIGINT) AS x FROM sale_lines
  WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), span AS (SELECT vendor_id, min(d) AS lo, max(d) AS hi FROM daily GROUP BY vendor_id),
every AS (SELECT vendor_id, lo, unnest(range(lo, hi + 1)) AS d FROM span),
filled AS (
  SELECT e.vendor_id, e.lo, e.d, coalesce(y.x, 0) AS x FROM every e LEFT JOIN daily y ON e.vendor_id IS NOT DISTINCT FROM y.vendor_id AND e.d = y.d
), sums AS (
  SELECT vendor_id, lo, d, sum(x) OVER w AS p, sum(x * x) OVER w AS q FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY d)
), series AS (
  SELECT vendor_id, any_value(lo) AS lo, count(*) AS n, list_prepend(0, list(CAST(p AS HUGEINT) ORDER BY d)) AS p, list_prepend(0, list(CAST(q AS HUGEINT) ORDER BY d)) AS q
  FROM sums GROUP BY vendor_id
), dp AS (
  SELECT *, least(n, 14) AS t, [CAST(-40000 AS BIGINT)] AS f, [CAST(0 AS BIGINT)] AS k, CAST([NULL] AS BIGINT[]) AS b FROM series
  UNION ALL
  SELECT vendor_id, lo, n, p, q, t + 1,
    list_concat(list_resize(f, t, NULL), [best.c + 40000]), list_concat(list_resize(k, t, NULL), [best.k + 1]), list_concat(list_resize(b, t, NULL), [best.s])
  FROM (
    SELECT *, list_min(list_transform(list_filter(range(0, t), lambda s: s = 0 OR (s >= 14 AND t - s >= 14)), lambda s: {
      'c': f[s + 1] + (t - s) * CAST(floor(1000 * ln(CAST(1 + ((t - s) * (q[t + 1] - q[s + 1]) - (p[t + 1] - p[s + 1]) * (p[t + 1] - p[s + 1])) // ((t - s) * (t - s)) AS DOUBLE))) AS BIGINT),
      'k': k[s + 1], 's': s})) AS best
    FROM dp WHERE t <= n
  )
), done AS (SELECT * FROM dp WHERE t = n + 1),
walk AS (
  SELECT vendor_id, n AS e, b[n + 1] AS s, k[n + 1] AS number FROM done
  UNION ALL
  SELECT w.vendor_id, w.s, d.b[w.s + 1], w.number - 1 FROM walk w JOIN done d ON w.vendor_id IS NOT DISTINCT FROM d.vendor_id WHERE w.s > 0
), segment AS (
  SELECT w.vendor_id, w.number, d.lo + w.s AS first_day, w.e - w.s AS n_days, d.p[w.e + 1] - d.p[w.s + 1] AS total, d.q[w.e + 1] - d.q[w.s + 1] AS squares, d.k[n + 1] AS n_segments, d.f[n + 1] AS best_cost
  FROM walk w JOIN done d ON w.vendor_id IS NOT DISTINCT FROM d.vendor_id
), spread AS (SELECT *, 1 + (n_days * squares - total * total) // (n_days * n_days) AS v FROM segment)
SELECT vendor_id, CAST(number AS INTEGER) AS segment_no, CAST(first_day AS BIGINT) AS first_day, CAST(n_days AS BIGINT) AS n_days, CAST(total AS BIGINT) AS total, CAST(v AS BIGINT) AS spread,
  CAST(n_days * floor(1000 * ln(CAST(v AS DOUBLE))) AS BIGINT) AS cost, CAST(n_segments AS BIGINT) AS n_segments, CAST(best_cost AS BIGINT) AS best_cost
FROM spread
"""
