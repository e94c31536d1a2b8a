import pytest
from pyspark.sql import functions as F

from hemaspark import constants as K
from hemaspark.functions.columns import c
from hemaspark.operators import clean, repeats
from hemaspark.plans.api import SampleCleaner
from hemaspark.sources import tables

ROWS = [
    ("S1", "2020/01/01", "08:00:00", 6.0, 4.5, 14.0, 42.0, 250.0),
    ("S2", "2020/01/01", "09:30:00", 7.0, 4.8, 15.0, 45.0, 300.0),
    ("S2", "2020/01/01", "09:00:00", 7.1, 4.8, 15.0, 45.0, 302.0),
    ("S3", "2020/01/02", "08:00:00", 5.0, 4.2, 13.0, 39.0, 200.0),
    ("S3", "2020/01/02", "08:05:00", 5.1, 4.2, 13.1, 39.2, 480.0),
    ("S4", "2020/01/02", "10:00:00", 4.0, 3.0, 9.0, 28.0, 150.0),
    ("S4", "2020/01/02", "10:10:00", 12.0, 5.5, 16.5, 49.0, 155.0),
    ("S5", "2020/01/03", "08:00:00", 8.0, 5.0, 15.5, 46.0, 280.0),
    ("S5", "2020/01/03", "08:10:00", 8.1, 5.0, 15.4, 46.1, 281.0),
    ("S5", "2020/01/03", "08:20:00", 15.0, 2.5, 7.0, 22.0, 50.0),
    ("S6", "2020/01/03", "09:00:00", 6.5, 4.6, 14.2, 43.0, 240.0),
    ("S6", "2020/01/03", "09:05:00", None, 4.6, 14.2, 43.1, 241.0),
]
NAMES = ["Sample No.", "Date", "Time", *K.CORE_MEASURES]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(ROWS, "a string, b string, c string, d double, e double, f double, g double, h double").toDF(*NAMES)


def ids(df):
    return sorted((r["Sample No."], r["Time"]) for r in df.collect())


def test_repeats_golden(samples):
    main, odd, one = repeats.consolidate_repeats(samples)
    assert ids(main) == [("S1", "08:00:00"), ("S2", "09:00:00"), ("S3", "08:00:00"), ("S5", "08:00:00"), ("S6", "09:00:00")]
    assert ids(odd) == [("S4", "10:00:00"), ("S4", "10:10:00")]
    assert ids(one) == [("S3", "08:00:00"), ("S3", "08:05:00")]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_repeats_do_not_depend_on_order(samples, parts):
    shuffled = samples.repartition(parts).orderBy(F.rand(parts))
    assert ids(repeats.consolidate_repeats(shuffled)[0]) == ids(repeats.consolidate_repeats(samples)[0])
    main = repeats.consolidate_repeats(samples)[0]
    assert ids(repeats.consolidate_repeats(main)[0]) == ids(main)


def test_repeats_flags(samples):
    rows = repeats.consolidate_repeats(samples, flag=True)[0].collect()
    assert len(rows) == len(ROWS)
    assert sorted({r["Sample No."] for r in rows if r["drop_dup_disagree"]}) == ["S4"]
    assert sum(r["drop_dup"] for r in rows) == 5


def test_anonymised(samples):
    got = {r["Sample No."] for r in repeats.anonymised(samples).collect()}
    assert got == set(range(6))


def test_channel_masks(spark):
    names = ["Discrete", "RET%(%)", "WPC-X(ch)", "HGB(g/dL)", "NEUT%(%)", "RBC(10^6/uL)_O"]
    df = spark.createDataFrame([("CBC+DIFF", 1, 1, 1, 1, 1), ("FREE SELECT", 1, 1, 1, 1, 1), (None, 1, 1, 1, 1, 1), ("CBC+RET", 1, 1, 1, 1, 1)], "a string, b int, c int, d int, e int, f int").toDF(*names)
    got = {r["Discrete"]: tuple(r)[1:] for r in clean.mask_channels(df).collect()}
    assert got == {"CBC+DIFF": (None, None, 1, 1, None), "FREE SELECT": (1,) * 5, None: (None,) * 5, "CBC+RET": (1, None, 1, None, 1)}


def test_channel_lists():
    assert {k: len(v) for k, v in K.CHANNEL_COLUMNS.items()} == {"CBC": 103, "DIFF": 33, "RET": 20, "WPC": 8} and len(set(K.CBC_COLUMNS)) == 100


def test_flags_and_marks(spark):
    df = spark.createDataFrame([("Morph.", None, 1, None, "ERROR", "*", 1), (None, 0, None, "1", "DISCRETE", "x", 2), ("0", 3, 0, "0", "12", None, 3), (None, None, None, None, None, "----", 4)], "a string, b int, c int, d string, e string, f string, g int")
    df = df.toDF("Positive", "Error(Func)", "WBC Suspect", "IP X", "Q-Flag(y)", "WBC/M", "HGB.1")
    got = [tuple(r) for r in clean.process_marks(clean.encode_flags(df)).collect()]
    assert got == [(1, 0, 1, 0, None, "low_reliability", 1, 0), (0, 0, 0, 1, None, None, 0, 1), (1, 1, 0, 0, 12.0, None, 0, 0), (0, 0, 0, 0, None, "error", 0, 0)]
    hot = clean.process_marks(df, one_hot=True)
    assert [n for n in hot.columns if n.startswith("WBC/M")] == [f"WBC/M_{v}" for v in K.MARKS.values()]
    bad = spark.createDataFrame([("abc",)], "a string").toDF("IP X")
    with pytest.raises(Exception, match="no integer"):
        clean.encode_flags(bad).collect()


def test_technical_and_clots(spark):
    df = spark.createDataFrame([("QC-1", 0), ("CALx", 0), ("cal1", 1), (None, None), ("A1", 0)], "a string, b int").toDF("Sample No.", K.CLOT_INDICATORS[0])
    assert sorted(r[0] or "" for r in clean.remove_technical_samples(df).collect()) == ["", "A1", "cal1"]
    flagged = clean.remove_technical_samples(df, flag=True)
    assert flagged.columns[2:] == [f"drop_techsample_{p}" for p in K.TECHNICAL_PREFIXES]
    assert sorted(r[0] or "" for r in clean.remove_clotted(df).collect()) == ["", "A1", "CALx", "QC-1"]


def test_promotion(spark):
    df = spark.createDataFrame([("1.5", "1.5", "007", "1d"), ("----", "abc", "008", "2"), ("2", None, "009", None)], "a string, b string, c string, d string").toDF("x.1", "y", "Sample No.", "z")
    out = clean.promote_numeric(clean.null_sentinels(df))
    assert dict(out.dtypes) == {"x.1": "double", "y": "string", "Sample No.": "string", "z": "string"}
    assert [r[0] for r in out.collect()] == [1.5, None, 2.0]


def test_header_and_tables(spark, tmp_path):
    assert tables.mangled(["X", "X", "", "X.1", "X"]) == ["X", "X.1", "Unnamed: 2", "X.1.1", "X.2"]
    (tmp_path / "a.csv").write_bytes("Sample No.,WBC(10^3/uL),WBC(10^3/uL),naïve\n001,1,2,é\n002,NA,,x\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("WBC(10^3/uL),extra\n9,z\n")
    df = tables.read_tables(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/missing.csv", f"{tmp_path}/b.csv"])
    assert df.columns == ["Sample No.", "WBC(10^3/uL)", "WBC(10^3/uL).1", "naïve", "extra"]
    assert sorted(tuple(r[n] or "" for n in df.columns) for r in df.collect()) == [("", "9", "", "", "z"), ("001", "1", "2", "é", ""), ("002", "", "", "x", "")]
    with pytest.raises(ValueError):
        tables.read_tables(spark, f"{tmp_path}/none.csv")


def test_whole_cleaning(spark, tmp_path, samples):
    extra = samples.withColumns({"Discrete": F.lit("CBC"), "WBC/M": F.lit("*"), "HGB_SI(mmol/L)": F.lit("1"), "Rack": F.lit("r")})
    qc = extra.limit(1).withColumn("Sample No.", F.lit("QC-1"))
    df = extra.unionByName(qc).unionByName(extra.limit(1))
    cleaner = SampleCleaner(output_dir=str(tmp_path), diagnostics=True)
    result = cleaner.clean(df)
    assert ids(result.main) == [("S1", "08:00:00"), ("S2", "09:00:00"), ("S3", "08:00:00"), ("S5", "08:00:00"), ("S6", "09:00:00")]
    assert "Rack" not in result.main.columns and "HGB_SI(mmol/L)" not in result.main.columns
    assert result.odd.count() == 2 and result.one_different.count() == 2
    assert {(r.anchor, r.feature) for r in result.report.collect()} >= {("HGB(g/dL)", "HCT(%)")}
    rows = [df.count(), clean.drop_duplicate_rows(df).count(), clean.remove_technical_samples(clean.drop_duplicate_rows(df)).count(), result.main.count()]
    assert result.dropped == {"duplicates": rows[0] - rows[1], "technical samples": rows[1] - rows[2], "clotted": 0, "repeats": rows[2] - rows[3]}
    flagged = SampleCleaner(keep_drop_rows=True).clean(df)
    kept = flagged.main
    assert kept.count() == 13 and kept.where("drop").count() == 8
    assert flagged.dropped == result.dropped
    paths = [f"{tmp_path}/in.csv"]
    df.select(*[c(n).cast("string").alias(n) for n in df.columns]).toPandas().to_csv(paths[0], index=False)
    main = cleaner.clean_files(spark, paths, "set")
    assert main.count() == 5 and set(cleaner.last.files) == {"main", "odd", "one_different", "correlations"}


def test_large_samples_are_ranked_in_shares(spark, monkeypatch):
    """A sample with very many rows, the null one too, comes to the same verdict as in one window."""
    from hemaspark.operators import repeats

    df = spark.range(900).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 'hot', cast(id as string))) as s", "cast(hash(id) % 1000 as string) as d", "cast(id % 7 as double) as a", "cast(id % 2 as double) as b")
    df = df.union(df.where("s = 'hot'").limit(20))
    for flag in (False, True):
        one = repeats.consolidate_repeats(df, 1.0, ["a", "b"], "s", ("d",), flag)
        want = [sorted(map(str, x.collect())) for x in one]
        monkeypatch.setattr(repeats, "HOT", 50)
        monkeypatch.setattr(repeats._ranked, "__defaults__", (50,))
        many = repeats.consolidate_repeats(df, 1.0, ["a", "b"], "s", ("d",), flag)
        assert [sorted(map(str, x.collect())) for x in many] == want
        monkeypatch.undo()


def test_stage_counts_take_no_jobs(spark, samples, monkeypatch):
    from hemaspark.plans import api

    def jobs(group):
        spark.sparkContext.setJobGroup(group, "counted")
        try:
            SampleCleaner(keep_drop_rows=True).clean(samples.withColumn("Discrete", F.lit("CBC")))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    with_counts = jobs("with counts")
    monkeypatch.setattr(api.StageCounts, "watch", lambda self, df, stage: df)
    assert with_counts == jobs("without counts")


def test_repeats_are_ranked_once(spark, samples):
    """One window for ranks, sizes and verdicts; the cleaner's three tables read its rows instead of ranking again."""
    from hemaspark.operators import repeats

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(repeats.consolidate_repeats(samples)[0]).count("Window [") == 1
    result = SampleCleaner().clean(samples.withColumn("Discrete", F.lit("CBC")))
    shared = repeats.consolidate_repeats(samples, shared=True)
    assert not any("Window [" in plan(df) for df in (*shared, result.main))
    for flag in (False, True):
        for a, b in zip(repeats.consolidate_repeats(samples, flag=flag), repeats.consolidate_repeats(samples, flag=flag, shared=True), strict=True):
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_numbers_of_text(spark):
    from hemaspark.functions.columns import number

    texts = ["1", " 2.5 ", "1d", "1F", "1e3", "0x1f", "inf", "-INF", "Infinity", "NaN", "nan", "----", "", "fd", "1d\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(number(F.col("t"))).collect()]
    assert found == [1.0, 2.5, None, None, 1000.0, None, float("inf"), float("-inf"), float("inf"), None, None, None, None, None, None, None]
