import itertools
import random
import time

from hemaspark.llm import licenses


def brute(text, templates, t=0.8):
    """The best coefficient over all windows, for each template."""
    words = licenses.normalised(text or "")
    out = {}
    for k, (_, body) in enumerate(templates):
        b = licenses.bigrams(licenses.normalised(body))
        best = 0.0
        for i, j in itertools.combinations(range(len(words)), 2):
            if j - i <= 3 * len(b):
                best = max(best, licenses.dice(licenses.bigrams(words[i : j + 1]), b))
        if best >= t - 1e-12:
            out[k] = round(best, 9)
    return out


SHORT = [x for x in licenses.NOTICES if len(x[1]) < 120]
TEXTS = [
    "the of and. Licensed under CC BY-NC 4.0. end of it", "/* Licensed under the\n * Apache License, version 2.0\n */ int main()", "released under the mit license and under the mit license", "This work is licenced under the GNU General Public License, version 3", "Licensed under CC-BY 4.0", "nothing to see here", "under the", "", None, "the " * 300,
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.license_matches(df, templates=SHORT).collect():
        want = brute(TEXTS[r.doc_id], SHORT)
        got: dict = {}
        for m in r.matches:
            got[m.template] = max(got.get(m.template, 0.0), round(m.dice, 9))
        assert bool(got) == bool(want)
        if want:
            assert max(got.values()) == max(want.values()) and all(want[k] >= s for k, s in got.items())


def test_full_text_with_changes(spark):
    mit = dict(licenses.TEMPLATES[::-1])
    body = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    text = "Copyright (c) 2020 Someone\n\n" + body.replace("Software", "Program").replace(". ", ".\n# ") + "\nint x;"
    (r,) = licenses.license_matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert mit and [m.license for m in r.matches] == ["MIT"] and r.matches[0].dice > 0.8
    assert text[r.matches[0].start :].startswith("Permission is hereby granted")


def test_long_templates_equal_brute_force(spark):
    """Changed parts of whole licences, in blocks of starts: the best window's coefficient is the best of all windows."""
    rng = random.Random(3)
    own = [(n, " ".join(licenses.normalised(t)[200:420])) for n, t in licenses.full_texts() if n in ("GPL-2.0", "MPL-2.0")]
    texts = []
    for _, t in own * 2:
        words = [w for w in t.split() if rng.random() > 0.04]
        texts.append(" ".join([*rng.choices(words, k=40), *words, *words[:30]]))
    got = licenses.license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=own).collect()
    for r in got:
        want = brute(texts[r.doc_id], own)
        assert want and round(max(m.dice for m in r.matches), 9) == max(want.values())


def test_whole_licences_without_their_notices(spark):
    """Every long licence, with words lost and marks of comments, among other text."""
    rng = random.Random(5)
    full = licenses.full_texts()
    rows = [(i, "some words before\n * " + "\n * ".join(" ".join(w for w in line.split() if rng.random() > 0.01) for line in t.splitlines()) + "\nint main();") for i, (_, t) in enumerate(full)]
    got = {r.doc_id: r.matches for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(full) >= 13 and all([m.license for m in got[i]] == [n] and got[i][0].dice > 0.93 for i, (n, _) in enumerate(full))


def test_a_megabyte_of_licences(spark):
    text = "\n\n".join(t for _ in range(5) for _, t in licenses.TEMPLATES)
    began = time.time()
    (r,) = licenses.license_matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(text) > 1_000_000 and time.time() - began < 60
    assert [m.license for m in r.matches] == [n for n, _ in licenses.TEMPLATES] * 5 and all(m.dice > 0.999 for m in r.matches)


def test_repeats_make_a_window_no_longer_than_its_template_allows(spark):
    body = next(t for n, t in licenses.NOTICES if n == "ISC")
    texts = [body + " " + " ".join(["the software is"] * 50_000), " ".join(["of the"] * 100_000)]
    got = {r.doc_id: r.matches for r in licenses.license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [m.license for m in got[0]] == ["ISC"] and got[1] == []


def test_bsd_variants_are_told_apart(spark):
    rows = [(i, "header\n" + t + "\ntrailer") for i, (n, t) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[i].matches and got[i].matches[0].license == name and got[i].matches[0].dice > 0.99


def test_query_finds_all_license_lines(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in licenses.query(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert (rows[d.doc_id].n_matches > 0) == ("icense" in d.text)


def test_odd_rows(odd_docs, empty_docs):
    rows = licenses.license_matches(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.matches == [] for r in rows)
    assert licenses.license_matches(empty_docs).count() == 0


def test_any_number_of_templates(spark):
    own = [(f"L{i}", f"the work number{i} may be used by anyone for purpose{i} of kind{i % 7} only") for i in range(150)]
    rows = [(i, f"before it {t} and after") for i, (_, t) in enumerate(own)]
    got = {r.doc_id: r.matches for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), templates=own).collect()}
    assert all([m.license for m in got[i]] == [f"L{i}"] and got[i][0].dice == 1.0 for i in range(150))
    assert all(r.matches == [] for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), templates=[]).collect())
