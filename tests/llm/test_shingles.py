import random

import corpus_pipeline

from hemaspark.llm import shingles


def brute(rows):
    """Ids that stay: the smallest of each component over all pairs with five-word Jaccard similarity >= 0.8."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y) and top(i) != top(j):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(k, least.get(top(i), k))
    return sorted(least.values())


def edited_rows():
    """Texts with substituted words, chains of edits, a common passage, subsets and short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(60)]
    texts = []
    for n in range(70):
        t = [word() for _ in range(rng.randint(40, 400))] + (common if n % 2 else [])
        texts.append(t)
        for _ in range(rng.randint(0, 4)):
            t = list(t)
            for _ in range(max(1, int(len(t) * rng.uniform(0.002, 0.03)))):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
        texts.append(t[: int(len(t) * rng.uniform(0.7, 0.95))])
    texts += [[], ["a"], ["A"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"], [], common, common[:-9]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_stage_equals_brute_force(spark, monkeypatch):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == want
    monkeypatch.setattr(shingles, "PART", 500)  # buckets in many parts, and fewer pairs from fingerprints: the same
    found = shingles.near_copies(docs, distance=1)
    assert sorted(r[0] for r in found.groupBy("root").agg({"doc_id": "min"}).select("min(doc_id)").collect()) == want


def test_large_group_of_near_copies(spark, monkeypatch):
    """Each copy is near the original and hardly near another copy; so many meet in a bucket that it is cut into parts."""
    monkeypatch.setattr(shingles, "PART", 5000)
    rng = random.Random(8)
    base = [f"v{rng.randrange(2000)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(300):
        t = list(base)
        for k in (rng.randrange(5, 55), rng.randrange(60, 110)):
            t[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    want = brute(rows)
    found = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r[0] for r in found.groupBy("root").agg({"doc_id": "min"}).select("min(doc_id)").collect()) == want


def test_odd_rows(odd_docs, empty_docs):
    assert shingles.near_copies(odd_docs).count() == odd_docs.count() and shingles.near_copies(empty_docs).count() == 0


def test_stage_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_asked_for(spark):
    """By bitmap and by join: the sets of the texts asked for are there, and nearly no others."""
    import numpy as np
    from pyspark.sql import functions as F

    texts = [f"one two three four five six {i} {i * 7} eight nine ten" for i in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts * 2], "_text string").withColumn("_th", F.xxhash64("_text")).repartition(5)
    asked = docs.where(F.pmod("_th", F.lit(4)) == 1).select("_th").distinct()
    want = {shingles._node(shingles.shingles(r["_text"])) for r in docs.join(asked, "_th").select("_text").collect()}
    for most in (1 << 24, 10):
        found = {r.node: np.frombuffer(r.x, np.int64) for r in shingles.wanted(docs, asked, 5, most).collect()}
        assert want <= set(found) and len(found) < len(want) + 60 and all(shingles._node(x) == n for n, x in found.items())
    bits = np.frombuffer(shingles.bitmap(asked, 1 << 13), np.int64)
    on = {i for i in range(1 << 13) if bits[i >> 6] >> (i & 63) & 1}
    assert on == {r["_th"] & ((1 << 13) - 1) for r in asked.collect()}
