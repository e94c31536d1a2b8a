import datetime
import math

import numpy as np
import pytest

from hemaspark.llm import changepoints as c

duckdb = pytest.importorskip("duckdb")

DAY = datetime.datetime(2024, 1, 1)


def cost(x):
    n, s, q = len(x), sum(x), sum(v * v for v in x)
    v = 1 + (n * q - s * s) // (n * n)
    return v, n * math.floor(1000 * math.log(v))


def brute(x, least, penalty):
    """All starts, without pruning: (ends, best cost)."""
    x = [int(v) for v in x]
    if len(x) < least:
        return [len(x)], cost(x)[1]
    best = {0: (-penalty, 0, ())}
    for t in range(least, len(x) + 1):
        if found := [(best[s][0] + cost(x[s:t])[1] + penalty, best[s][1] + 1, (s, *best[s][2])) for s in best if t - s >= least]:
            best[t] = min(found)
    total, _, starts = best[len(x)]
    return [len(x), *starts[:-1]][::-1], total


def series(rng, count):
    out = []
    for i in range(count):
        n = int(rng.integers(1, 120))
        steps = lambda width, top: np.repeat(rng.integers(0, top, n // width + 1), width)[:n]
        out.append([rng.integers(0, 3, n), steps(14, 60) + rng.integers(0, 4, n), (rng.random(n) < 0.1).astype(int), rng.integers(0, 2, n) * rng.integers(1, 500, n), steps(20, 9), np.zeros(n, int), -steps(14, 5)][i % 7].astype(np.int64))
    return out


@pytest.mark.parametrize(("least", "penalty"), [(14, 40000), (14, 0), (5, 500), (1, 2000), (3, 9000)])
def test_equals_all_starts(least, penalty):
    found = series(np.random.default_rng(least + penalty), 60)
    assert c.cuts(found, least, penalty) == [brute(x, least, penalty) for x in found]


def test_numbers_beyond_64_bits():
    found = [x * 10**10 for x in series(np.random.default_rng(3), 14)]
    assert c.cuts(found) == [brute(x, 14, 40000) for x in found]


def test_bound_on_what_floors_lose():
    """Superadditivity fails by less than the bound; and it does fail, so that a constant of zero would be wrong."""
    rng, worst = np.random.default_rng(5), -math.inf
    for _ in range(4000):
        top, a, b, more = int(rng.choice([2, 3, 9, 200])), *(int(x) for x in rng.integers(1, 40, 3))
        x = [int(v) for v in rng.integers(0, top, a + b)]
        lost = cost(x[:a])[1] + cost(x[a:])[1] - cost(x)[1]
        one = lambda v: np.array([v])
        assert lost < c.loss(one(a), one(cost(x[:a])[0]), one(a + b))[0] <= c.loss(one(a), one(cost(x[:a])[0]), one(a + b + more))[0]
        worst = max(worst, lost)
    assert worst > 0


def test_pruning_leaves_few_starts(monkeypatch):
    seen, plain = [], c.costs
    monkeypatch.setattr(c, "costs", lambda n, s, q: (seen.append(len(n)), plain(n, s, q))[1])
    rng = np.random.default_rng(8)
    x = [np.repeat(rng.integers(0, 20000, 10), 80) + rng.integers(0, 40, 800)]
    assert len(c.cuts(x)[0][0]) == 10
    assert sum(seen) < 0.35 * 800 * 800 / 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "vendor_id long, shipped_at timestamp_ntz, quantity int, k long, d int, x string")


def got(df):
    return sorted(map(repr, df.collect()))


def test_rows_of_any_kind(spark):
    rng = np.random.default_rng(1)
    rows = [(v, DAY + datetime.timedelta(days=int(d), hours=int(h)), int(q), None, 7, "x") for v in (1, 2, None) for d, h, q in zip(rng.integers(0, 90, 200), rng.integers(0, 24, 200), rng.integers(0, 30, 200), strict=True)]
    rows += [*rows[:20], (1, None, 5, 1, 1, None), (2, DAY, None, 1, 1, None), (9, DAY, 4, 1, 1, None), (8, None, 4, 1, 1, None)]
    table = {}
    for v, at, q, *_ in rows:
        if at is not None and q is not None:
            day = (at - datetime.datetime(1970, 1, 1)).days
            table.setdefault(v, {}).setdefault(day, []).append(q)
    want = []
    for v, days in table.items():
        x = [sum(days.get(d, [])) for d in range(min(days), max(days) + 1)]
        ends, total = brute(x, 14, 40000)
        for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            want.append((v, i + 1, min(days) + a, b - a, sum(x[a:b]), *cost(x[a:b]), len(ends), total))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in c.change_points(frame(spark, rows)).collect())
    assert c.change_points(frame(spark, rows), least=400).count() == 4


def test_one_vendor_has_most_rows(spark):
    """A third and more of the rows are one vendor's: the result is that of the daily sums."""
    few = spark.range(120).selectExpr("5L AS vendor_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) AS shipped_at", "cast(if(id < 60, 3, 40) + id % 3 AS int) AS quantity")
    many = few.selectExpr("vendor_id", "shipped_at", "explode(array_repeat(1, quantity)) AS quantity")
    assert got(c.change_points(few)) == got(c.change_points(many)) and c.change_points(few).count() == 2


def test_empty(spark):
    assert c.change_points(frame(spark, [])).collect() == []


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW sale_lines AS SELECT * FROM '{sf}/sale_lines.parquet'")
    found = c.query(spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(c.SQL).project(", ".join(found.columns)).fetchall())
