import datetime as dt

from hemaspark.operators import clean
from hemaspark.streaming import adapters


def feed(spark, tmp_path, batches, schema):
    path = f"{tmp_path}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def test_row_local_stages_and_duplicates(spark, tmp_path):
    rows = [[("QC-1", T0), ("a", T0)], [("a", T0), ("b", T0 + H)]]
    df = feed(spark, tmp_path, rows, "id string, at timestamp")
    out = run(adapters.drop_duplicates(clean.remove_technical_samples(df, "id"), "at", keys=["id", "at"]), "dups")
    assert sorted(r.id for r in out) == ["a", "b"]


def test_consolidation(spark, tmp_path):
    rows = [[("a", T0, 5.0), ("b", T0, 1.0), ("c", T0, 1.0)], [("a", T0 + H, 5.1), ("b", T0 + H, 9.0), ("a", T0 + 2 * H, 99.0)], [("z", T0 + 240 * H, 0.0)], [("z", T0 + 480 * H, 0.0)], [("z", T0 + 720 * H, 0.0)]]
    df = feed(spark, tmp_path, rows, "id string, at timestamp, x double")
    out = {r.id: (r.verdict, r.x) for r in run(adapters.consolidate(df, "id", "at", ["x"], {"x": 1.0}, delay="1 hour"), "cons") if r.id != "z"}
    assert out == {"a": ("agree", 5.0), "b": ("one_different", 1.0), "c": ("single", 1.0)}


def test_windowed_counts(spark, tmp_path):
    rows = [[("a", T0), ("a", T0 + H / 2), ("b", T0)], [("a", T0 + 3 * H)], [("a", T0 + 100 * H)]]
    df = feed(spark, tmp_path, rows, "id string, at timestamp")
    out = run(adapters.windowed_counts(df, "at", "id", "1 hour", "1 hour"), "win")
    assert sorted((r.key, r.n) for r in out if r.window.start == T0) == [("a", 2), ("b", 1)]


def test_a_replayed_table_gives_the_batch_verdicts(spark, tmp_path):
    """Samples of a table, a part of which the stream begins with and the rest of which it reads: the same verdicts as in batch."""
    import random

    from pyspark.sql import functions as F

    from hemaspark.operators import repeats

    rng = random.Random(4)
    rows = [(f"s{i}", T0 + H * rng.randint(0, 400) / 20, rng.choice([1.0, 1.2, 5.0]), rng.choice([None, 2.0, 9.0])) for i in range(30) for _ in range(rng.randint(1, 4))]
    schema = "id string, at timestamp, x double, y double"
    table = spark.createDataFrame(rows, schema)
    spread = table.agg(F.stddev_samp("x").alias("x"), F.stddev_samp("y").alias("y")).first().asDict()
    main, odd, one = repeats.consolidate_repeats(table, 1.0, ["x", "y"], "id", ("at",))
    want = {r.id: (r.x, r.y) for r in main.collect()}
    ends = [[("z", T0 + 240 * H * k, 0.0, 0.0)] for k in (1, 2, 3)]
    df = feed(spark, tmp_path, [rows[40:60], rows[60:], *ends], schema)
    found = {r.id: r for r in run(adapters.consolidate(df, "id", "at", ["x", "y"], spread, delay="480 hours", initial=spark.createDataFrame(rows[:40], schema)), "replayed") if r.id != "z"}
    assert set(found) == {r[0] for r in rows}
    assert {i for i, r in found.items() if r.verdict == "odd"} == {r.id for r in odd.collect()}
    assert {i for i, r in found.items() if r.verdict == "one_different"} == {r.id for r in one.collect()}
    assert {i: (r.x, r.y) for i, r in found.items() if r.verdict != "odd"} == want
