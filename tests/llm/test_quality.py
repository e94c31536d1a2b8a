import random
import re
from collections import Counter

from hemaspark.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts_equal_brute_force(spark, sf):
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(d.text)
        assert not (r.base_failed and r.kept)


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1 and r.n_words >= 50]
    assert sum(bad) / len(bad) < 0.1
    assert sum(good) / len(good) > 0.98


def test_odd_rows(odd_docs, empty_docs):
    rows = quality.judged(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = sorted(((r.doc_id is None, r.doc_id or 0, *brute(r.text)) for r in odd_docs.collect()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert quality.judged(empty_docs).count() == 0
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sum(r.kept for r in rows) == kept.count() and kept.where("doc_id = 1").count() == 2


def test_em_finds_the_accurate_rules():
    import random

    rng = random.Random(0)
    counts = Counter()
    for _ in range(20000):
        y = 1 if rng.random() < 0.7 else -1
        counts[tuple((y if rng.random() < acc else -y) if rng.random() < 0.8 else 0 for acc in (0.95, 0.9, 0.85, 0.6))] += 1
    model = quality.fit(list(counts.items()))
    acc = [(t[1][0] / (t[1][0] + t[-1][0])) for t in model["rules"]]
    assert acc[0] > acc[1] > acc[2] > acc[3] and abs(model["prior"] - 0.7) < 0.05 and abs(acc[3] - 0.6) < 0.1
    assert quality.fit([])["rules"] == []


def test_estimated_accuracies_and_posteriors_against_the_truth():
    """Votes drawn from known rates: the estimated rates come near them, and the posterior near that of who knows them."""
    import math
    from collections import Counter

    rng = random.Random(12)
    names = 7
    truth = [({-1: 0.03 + 0.01 * j, 1: 0.5, 0: 0.47 - 0.01 * j}, {-1: 0.6, 1: 0.02 + 0.01 * j, 0: 0.38 - 0.01 * j}) for j in range(names)]
    draw = lambda p: rng.choices(list(p), list(p.values()))[0]
    seen = Counter()
    for _ in range(40_000):
        good = rng.random() < 0.8
        seen[tuple(draw(t[0] if good else t[1]) for t in truth)] += 1
    model = quality.fit(list(seen.items()), share=0.001)
    assert abs(model["prior"] - 0.8) < 0.02
    for j, t in enumerate(truth):
        assert all(abs(model["rules"][j][g][k] - t[k][g]) < 0.03 for g in (-1, 0, 1) for k in (0, 1))

    def posterior(prior, rules, v):
        score = math.log(prior / (1 - prior)) + sum(math.log(rules[j][0] / rules[j][1]) for j in range(names))
        return 1 / (1 + math.exp(-score))

    off = sum(n * abs(posterior(model["prior"], [model["rules"][j][x] for j, x in enumerate(v)], v) - posterior(0.8, [(t[0][x], t[1][x]) for t, x in zip(truth, v, strict=True)], v)) for v, n in seen.items())
    assert off / 40_000 < 0.02
