import random
import re

from hemaspark.llm.common import components, n_words, words


def brute(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def check(spark, nodes, edges):
    got = components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == brute(nodes, edges) and len(got) == len(nodes)


def test_random_graphs_long_paths_and_stars(spark):
    rng = random.Random(1)
    nodes = [rng.randint(-(1 << 62), 1 << 62) for _ in range(300)]
    check(spark, nodes, [(rng.choice(nodes), rng.choice(nodes)) for _ in range(180)])
    path = list(range(400))
    rng.shuffle(path)
    check(spark, list(range(401)), list(zip(path, path[1:], strict=False)) + [(5, 5), (path[0], path[1])])
    check(spark, list(range(200)), [(150, k) for k in range(100, 200)])
    check(spark, [3, 4], [])


def test_words(spark):
    texts = ["", None, " a\x0bb\t\tc\n", " a b", "one", " \r\n\x0c ", "x\x1cy\x85z q"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", words("t").alias("w"), n_words("t").alias("n")).collect()
    for r in rows:
        want = re.findall(r"[^\x20\x09-\x0D]+", texts[r.i] or "")
        assert r.w == want and r.n == len(want) and (texts[r.i] or "").encode().split() == [w.encode() for w in want]
