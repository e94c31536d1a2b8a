import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hemaspark.llm import simhash
from hemaspark.llm.common import components


def brute_fp(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=4):
    n = len(ids)
    seen, comp = set(), {}
    for i in range(n):
        if i in seen:
            continue
        stack, part = [i], []
        seen.add(i)
        while stack:
            a = stack.pop()
            part.append(a)
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= distance)
            for b in near.tolist():
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        known = [ids[a] for a in part if ids[a] is not None]
        comp |= dict.fromkeys(part, min(known) if known else None)
    return comp


def check(rows, texts):
    fps = np.array([brute_fp(t) for _, t in texts], np.uint64)
    want = brute_components([i for i, _ in texts], fps)
    expected = sorted((repr(i), f"{int(f):016x}", repr(want[k])) for k, ((i, _), f) in enumerate(zip(texts, fps, strict=True)))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in rows) == expected


def test_query_equals_brute_force(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(simhash.query(spark, sf).collect(), texts)


def test_odd_rows(odd_docs):
    rows = simhash.near_duplicates(odd_docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").collect()
    check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()])


def test_empty(empty_docs):
    assert simhash.near_duplicates(empty_docs).count() == 0
    assert simhash.keep_one(empty_docs).columns == empty_docs.columns


def test_one_of_each_stays(odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 8 not in ids  # a repeated row and a near copy go
    assert len(ids) == simhash.near_duplicates(odd_docs).select("root").distinct().count()


def test_links_keep_components_of_clusters(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(400):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(signed, np.array(fps, np.uint64))
    for hot in (1 << 16, 20):
        edges = simhash.links(df, 4, hot=hot)
        got = {r.node: r.component for r in components(df.withColumnRenamed("fp", "node"), edges).collect()}
        assert got == {signed[k]: c for k, c in want.items()}


def test_roots_of_large_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique((base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 60), dtype=np.uint64))).ravel())
    roots = simhash._roots(x, 4)
    want = brute_components(list(range(len(x))), x)
    assert len(x) > 1024 and all((roots[i] == roots[want[i]]) for i in range(len(x))) and len(set(roots)) == len(set(want.values()))


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(5)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (1000, 10**7, 10**10):
        parts = simhash.plan(sample, n)
        masks = [m for m, _ in parts]
        assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[i + 1 :])
        reach = [max(f.bit_count() for f in flips) for _, flips in parts]
        assert sum(t + 1 for t in reach) == simhash.MAX_DISTANCE + 1
    assert simhash.allocate([[0, 5, 9, 20, 40, 90], [0, 1, 2, 30, 60, 99]], 4) in ([1, 2], [2, 1], [3, 0], [0, 3])


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    x = (x & ~np.uint64(1 << 40)) | ((x & np.uint64(1 << 3)) << np.uint64(37))  # bit 40 repeats bit 3
    assert any(3 in g and 40 in g for g in simhash.group_bits(x, 4))
