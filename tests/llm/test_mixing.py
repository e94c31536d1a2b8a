import re
from collections import defaultdict

from pyspark.sql import functions as F

from hemaspark.llm import mixing

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, cycle=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        t = {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in full and t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def check(rows, docs):
    sizes = defaultdict(int)
    for s, text in docs:
        sizes[s] += len(W.findall(text or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert t - 1 <= taken[s] + 1e-6 <= t + 1
    assert len(rows) == len(docs)


def test_query(spark, sf):
    docs = [(r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = mixing.query(spark, sf).collect()
    check(rows, docs)
    assert sorted(rows) == sorted(mixing.query(spark, sf).repartition(3).collect())  # reruns agree


def test_odd_rows(odd_docs, empty_docs):
    rows, pieces = mixing.mix(odd_docs)
    check(rows.collect(), [(r.source, r.text) for r in odd_docs.collect()])
    rows, pieces = mixing.mix(empty_docs)
    assert rows.count() == 0 and pieces.count() == 0


def test_points_and_schedule(spark):
    x = [r[0] for r in spark.range(5000).select(mixing._point("id")).collect()]
    assert all(abs(v - (i * mixing.STEP % mixing.POINTS) / mixing.POINTS) < 1e-12 for i, v in enumerate(x))
    far = 2**61 + 12345
    assert abs(spark.range(1).select(mixing._point(F.lit(far))).first()[0] - (far * mixing.STEP % mixing.POINTS) / mixing.POINTS) < 1e-12
    targets = mixing.source_targets(spark.createDataFrame([("a", 100000), ("b", 50000), ("c", 7000), (None, 900)], "source string, size long"))
    slots = mixing.schedule(targets, 100).orderBy("slot").collect()
    want = {r.source: r.target for r in targets.collect()}
    for source, t in want.items():
        own = [s for s in slots if s.source == source]
        assert sum(s.words for s in own) == int(t + 1e-9) and [s.rank for s in own] == list(range(len(own)))
    total, n = sum(want.values()), len(slots)
    for cut in (n // 7, n // 3, n // 2):  # low discrepancy: every prefix is close to the mix
        for source, t in want.items():
            assert abs(sum(s.source == source for s in slots[:cut]) - cut * t / total) < 6
