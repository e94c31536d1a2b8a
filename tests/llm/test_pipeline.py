import corpus_pipeline
import test_packing
import test_quality
import test_secrets

from hemaspark.llm import mixing, secrets
from hemaspark.llm.common import written


def test_stages_over_documents(spark):
    """Each stage against brute force on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], sf)
        steps.append(out if stage is corpus_pipeline.packing_stage else written(out, "test"))
    raw, good, single, clean, mixed = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]
    assert set(raw) - set(good) >= {i for i, r in raw.items() if test_quality.brute(r.text)[-1]}
    assert set(single) <= set(good) and set(clean) == set(single) and set(mixed) <= set(clean)
    for i, r in clean.items():
        kinds, spans = test_secrets.brute(single[i].text)
        assert (r.text == single[i].text) == (not sum(kinds)) or "<" in r.text
        assert sum(test_secrets.brute(r.text)[0]) == 0
    rows, _ = mixing.mix(steps[3])
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in rows.collect()}
    counts = {}
    for r in steps[4].collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: n for i, n in want.items() if n}
    test_packing.check(steps[5].collect(), [(r.doc_id, r.text) for r in steps[4].collect()])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labels.get(i) != 0 for i in good)


def test_run_and_empty(spark, empty_docs, odd_docs, tmp_path):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    for docs in (empty_docs, odd_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() <= 3 * max(1, docs.count()), name
            assert docs is odd_docs or out.count() == 0
        assert (corpus_pipeline.packing_stage(spark, docs, "").count() > 0) == (docs is odd_docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "source_mix", "packing"] and secrets


def test_any_column_names(spark, odd_docs):
    """Extra columns pass through every stage as they were, whatever their names."""
    from pyspark.sql import functions as F

    names = ["_id", "_th", "_key", "_cut", "_copies", "_copy", "_text", "key", "bucket", "row", "id", "th", "cut", "copies", "root", "node", "_group", "piece", "n", "a.b"]
    docs = odd_docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == (None if r.doc_id is None else f"{n}-{r.doc_id}") for n in names), name
    assert corpus_pipeline.packing_stage(spark, docs, "").count()
