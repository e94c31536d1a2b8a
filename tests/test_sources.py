import numpy as np
import pytest
from pyspark.sql import functions as F

from hemaspark.plans import cli
from hemaspark.sources import config, events, tables

BASE = "RET_[AN-20^14232][00-22_123][20211002_001515][      AB12]"


def test_file_names(spark):
    assert events.without_overflow(["a.116.csv", "a.116(1).csv", "b.116_transformed.csv"]) == ["a.116.csv", "b.116_transformed.csv"]
    df = spark.createDataFrame([(f"{BASE}.116.csv",), (f"{BASE}.116(12).csv",), ("other.csv",)], "n string")
    rows = df.select(*[v.alias(k) for k, v in events.file_facts(F.col("n")).items()], events.is_overflow(F.col("n")).alias("o"), events.file_key(F.col("n")).alias("k"), events.sample_number(F.col("n")).alias("s")).collect()
    assert [rows[0].channel, rows[0].analyser_id, str(rows[0].measured_at), rows[0].sample_number] == ["RET", "AN-20^14232", "2021-10-02 00:15:15", "AB12"]
    assert [r.o for r in rows] == [False, True, False] and rows[0].k == rows[1].k and rows[0].s == "AB12" and rows[2].channel is None
    with pytest.raises(ValueError):
        events.channel_columns("XYZ")


def test_reading_events(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / f"{BASE}.116.csv").write_text("SFL,FSC,RepeatCount\n1,2,0\n3,,0\n5,6,1\n")
    (folder / f"{BASE}.116(1).csv").write_text("SFL,FSC,RepeatCount\n7,8,0\n")
    df = events.read_events(spark, str(folder), "RET")
    assert sorted((r.SFL, r.FSC, r.sample_number) for r in df.collect()) == [(1, 2, "AB12"), (7, 8, "AB12")]
    assert df.select("file_key").distinct().count() == 1
    assert events.read_events(spark, str(folder), "RET", spark.createDataFrame([("zz",)], "s string")).count() == 0
    events.write_events(df, str(tmp_path / "out"), "RET")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert "FSClog" in back.columns and back.count() == 2
    assert {r.kind for r in tables.catalogue(spark, str(folder), qc_only=False, drop_bracketed=False).collect()} == {"RET"}
    assert tables.catalogue(spark, str(folder), qc_only=True).count() == 0
    with pytest.raises(ValueError):
        events.concatenated([])
    with pytest.raises(ValueError):
        events.concatenated([df, df.withColumn("channel", F.lit("WDF"))])


def test_channels(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0, "A"), (1.0, 2.0, 3.0, None, 0, "B"), (None, 2.0, 3.0, 4.0, 0, "B"), (1.0, 2.0, 3.0, 4.0, 1, "B")], "SFL double, FSC double, SSC double, FSCW double, RepeatCount int, Phase string")
    assert [tuple(r) for r in events.preprocess(df, "PLTF").collect()] == [(1, 2, 3, 255), (1, 2, 3, None)]
    assert events.preprocess(df, "WDF").columns == ["SSC", "SFL", "FSC", "FSCW"] and events.preprocess(df, "WDF").count() == 1
    assert events.preprocess(df.drop("RepeatCount"), "RET").count() == 3
    with pytest.raises(ValueError):
        events.preprocess(df.drop("RepeatCount"), "WNR")
    data = spark.createDataFrame([("1",), ("x",)], "Data string")
    assert events.preprocess(data, "RBC").collect()[0][0] == 1.0
    edge = spark.createDataFrame([(0.0, 1.0), (5.0, 9.0), (5.0, 6.0)], "a double, b double")
    assert events.without_extremes(edge, ["a", "b"]).count() == 1


def test_sample_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("s1\n\n s2 \n")
    (tmp_path / "b.csv").write_text("x,sample_number\n1,s3\n2,\n")
    np.save(tmp_path / "c.npy", np.array(["s4", "s5"]))
    assert [[r[0] for r in tables.read_sample_list(spark, f"{tmp_path}/{n}").collect()] for n in ("a.txt", "b.csv", "c.npy")] == [["s1", "s2"], ["s3"], ["s4", "s5"]]


def test_config(spark, tmp_path):
    tree = {"base_paths": {"root": str(tmp_path)}, "datasets": {"raw": {"one": "${base_paths.root}/one"}}, "files": {"lists": {"x": "${datasets.raw.one}/x.txt"}}}
    c = config.Catalog(tree)
    assert c.file_path("lists", "x") == f"{tmp_path}/one/x.txt" and c.datasets("raw") == {"one": f"{tmp_path}/one"}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "t.csv").write_text("a\n1\n")
    assert c.check_all(spark) == {"datasets.raw.one": True, "files.lists.x": False}
    assert c.read_dataset(spark, "raw", "one").count() == 1
    for bad in ({"a": "${b.c}"}, {"a": "${a}"}):
        with pytest.raises(ValueError):
            config.Catalog(bad)
    with pytest.raises(KeyError):
        c.dataset_path("raw", "two")


def test_gates_files(tmp_path):
    config.save_gates({"a": [[0, 1], [2, 3], [4, 5]]}, f"{tmp_path}/g.json")
    assert config.load_gates(f"{tmp_path}/g.json") == {"a": [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]}
    assert {k: {g: len(p) for g, p in config.load_gates(channel=k).items()} for k in ("RET", "WNR")} == {"RET": {"RBC": 5, "RET": 4, "PLT": 6}, "WNR": {"WBC": 6, "BASO": 4, "NRBC": 4}}
    with pytest.raises(ValueError):
        config.load_gates(channel="RBC")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.csv").write_text("Sample No.,x\na,1\nb,2\nc,3\n")
    (tmp_path / "t.csv").write_text("Sample No.,x\na,10\nb,14\nc,18\n")
    (tmp_path / "cols.txt").write_text("x\n")
    assert cli.main(["align-table", f"{tmp_path}/s.csv", f"{tmp_path}/t.csv", "--columns", f"{tmp_path}/cols.txt", "--output-dir", f"{tmp_path}/o"], spark) == 0
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/o/aligned").collect()) == ["10.0", "14.0", "18.0"]
    assert cli.main(["profile", f"{tmp_path}/s.csv"], spark) == 0 and cli.main(["compare", f"{tmp_path}/s.csv", f"{tmp_path}/t.csv"], spark) == 0
    assert cli.main(["clean", "--files", f"{tmp_path}/s.csv", "--output-dir", f"{tmp_path}/clean"], spark) == 0
    assert "common" in capsys.readouterr().out


def test_more_names_and_saved_tables(spark, tmp_path):
    df = spark.createDataFrame([(f"{BASE}.116.csv",)], "n string")
    r = df.select(events.channel_of(F.col("n")).alias("c"), events.measured_at(F.col("n")).alias("t")).first()
    assert r.c == "RET" and str(r.t) == "2021-10-02 00:15:15"
    path = tables.write_table(df, str(tmp_path), "x", stamp=False)
    assert tables.read_saved(spark, path).count() == 1
    assert tables.write_table(df, str(tmp_path), "y", "csv").startswith(f"{tmp_path}/y_")


def test_overflow_chains_end_at_a_gap(spark):
    names = ["a.116.csv", "a.116(1).csv", "a.116(2).csv", "a.116(4).csv", "b.116.csv", "b.116(2).csv", "b.116(3).csv", "c.116.csv", "c.116(3).csv", "d_transformed.csv"]
    left = events.overflow_chains(spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(r[0] for r in left.collect()) == sorted(set(names) - {"a.116(4).csv", "c.116(3).csv"})
    many = [("e.116.csv",), *[(f"e.116({i}).csv",) for i in range(1, 105)]]
    assert events.overflow_chains(spark.createDataFrame(many, "name string")).count() == 100


def parsed(raw):
    """Names and events of a binary file."""
    import struct

    assert raw[:6] == b"FCS3.1"
    a, b, c, d = (int(raw[10 + 8 * i : 18 + 8 * i]) for i in range(4))
    pairs = raw[a : b + 1].decode().replace("//", "\0").strip("/").split("/")
    text = {k: v.replace("\0", "/") for k, v in zip(pairs[::2], pairs[1::2], strict=True)}
    n, k = int(text["$TOT"]), int(text["$PAR"])
    assert (int(text["$BEGINDATA"]), int(text["$ENDDATA"])) == (c, d)
    flat = struct.unpack(f"<{n * k}f", raw[c : c + 4 * n * k])
    return text, [flat[i * k : i * k + k] for i in range(n)]


def test_binary_export(spark):
    rows = [("f/1", "S1", "A", 1.0, 2.0, 3.0), ("f/1", "S1", "A", 0.0, 2.0, 3.0), ("f/1", "S1", "A", 4.0, 9.0, 1.0), ("f/1", "S1", "A", 2.0, 2.5, 3.5), ("g", "S2", "A", 0.0, 1.0, 1.0)]
    names = events.channel_columns("RET")
    df = spark.createDataFrame([(r[0], r[1], r[2], *r[3 : 3 + len(names)]) for r in rows], ", ".join(["file_key string", "sample_number string", "analyser_id string", *[f"{n} double" for n in names]]))
    got = {r.file_key: parsed(bytes(r.content)) for r in events.fcs_files(df, "RET").collect()}
    text, values = got["f/1"]
    top = max(max(r[3 : 3 + len(names)]) for r in rows[:4])
    want = [r[3 : 3 + len(names)] for r in rows[:4] if 0 not in r[3 : 3 + len(names)] and top not in r[3 : 3 + len(names)]]
    assert sorted(values) == sorted(want) and text["Filename"] == "f/1" and text["SampleNumber"] == "S1" and [text[f"$P{i + 1}N"] for i in range(len(names))] == names
    assert got["g"][1] == []


def test_saved_arrays_and_matching_tables(spark, tmp_path):
    import numpy as np

    (tmp_path / "x" / "y").mkdir(parents=True)
    np.save(tmp_path / "x" / "a.npy", np.arange(6.0).reshape(3, 2))
    np.save(tmp_path / "x" / "y" / "b.npy", np.arange(2))
    rows = sorted((r.file, r.row, list(r["values"])) for r in tables.read_arrays(spark, str(tmp_path)).collect())
    assert rows == [("a.npy", 0, [0, 1]), ("a.npy", 1, [2, 3]), ("a.npy", 2, [4, 5]), ("b.npy", 0, [0]), ("b.npy", 1, [1])]
    (tmp_path / "x" / "one.csv").write_text("a,b\n1,2\n")
    (tmp_path / "x" / "y" / "two.csv").write_text("b,c\n3,4\n")
    assert sorted(tables.read_matching(spark, str(tmp_path)).select("a", "b", "c").collect(), key=lambda r: r.b) == [("1", "2", None), (None, "3", "4")]


def event_files(folder):
    """Two orders of columns, an overflow chain with a gap, another channel, a broken file."""
    folder.mkdir()
    other = BASE.replace("AB12", "CD34")
    (folder / f"{BASE}.116.csv").write_text("SFL,FSC,RepeatCount\n1,2,0\n3,,0\n5,6,1\n")
    (folder / f"{BASE}.116(1).csv").write_text("RepeatCount,FSC,SFL\n0,8,7\n")
    (folder / f"{BASE}.116(3).csv").write_text("SFL,FSC,RepeatCount\n9,9,0\n")
    (folder / f"{other}.116.csv").write_text("FSC,SFL\n20,10\n40,30\nx,1\n")
    (folder / f"{BASE.replace('RET', 'WDF')}.116.csv").write_text("SSC,SFL,FSC,FSCW,RepeatCount\n1,2,3,4,0\n")
    (folder / f"{BASE.replace('AB12', 'EF56')}.116.csv").write_text("SFL,nothing\n1,2\n")
    return {("AB12", 1.0, 2.0), ("AB12", 7.0, 8.0), ("CD34", 10.0, 20.0), ("CD34", 30.0, 40.0)}


def test_files_are_read_by_their_own_headers(spark, tmp_path, caplog):
    want = event_files(tmp_path / "raw")
    rows = events.read_events(spark, str(tmp_path / "raw"), "RET").collect()
    assert {(r.sample_number, r.SFL, r.FSC) for r in rows} == want and len(rows) == len(want)
    assert "EF56" in caplog.text and "FSC" in caplog.text
    some = events.read_events(spark, str(tmp_path / "raw"), "RET", spark.createDataFrame([("CD34",), ("CD34",)], "s string"))
    assert some.count() == 2 and "AB12" not in str(some.inputFiles())
    with pytest.raises(ValueError):
        events.read_events(spark, str(tmp_path / "raw"), "RET", spark.createDataFrame([("EF56",)], "s string"))


def test_event_source(spark, tmp_path):
    from hemaspark.sources import event_source

    want = event_files(tmp_path / "raw")
    event_source.register(spark)
    df = spark.read.format("events").option("channel", "RET").load(str(tmp_path / "raw"))
    plain = events.read_events(spark, str(tmp_path / "raw"), "RET")
    assert df.columns == plain.columns and dict(df.dtypes) == dict(plain.dtypes)
    key = lambda r: tuple(map(str, r))
    assert sorted(df.collect(), key=key) == sorted(plain.collect(), key=key) and len(want) == df.count()
    assert df.rdd.getNumPartitions() == 3  # a chain each, the broken one as well
    one = spark.read.format("events").option("channel", "RET").load(str(tmp_path / "raw")).where("sample_number = 'CD34' AND SFL > 15")
    assert [r.FSC for r in one.collect()] == [40.0] and one.rdd.getNumPartitions() == 1  # chosen by name
    assert spark.read.format("events").option("channel", "RET").option("samples", "zz").load(str(tmp_path / "raw")).count() == 0
    wdf = spark.read.format("events").option("channel", "WDF").load(str(tmp_path / "raw")).collect()
    assert [(r.SSC, r.FSCW) for r in wdf] == [(1.0, 4.0)]


def test_binary_sink(spark, tmp_path):
    from hemaspark.sources import event_source

    names = events.channel_columns("RET")
    rng = np.random.default_rng(1)
    rows = [(f"f/{k}", f"S{k}", *map(float, r)) for k in range(4) for r in rng.integers(0, 40, (500, len(names)))] + [("g", "S9", *[0.0] * len(names))]
    df = spark.createDataFrame(rows, ", ".join(["file_key string", "sample_number string", *[f"{n} double" for n in names]])).repartition(5)
    event_source.write_fcs(df, str(tmp_path / "out"), "RET")
    want = {r.file_key: sorted(parsed(bytes(r.content))[1]) for r in events.fcs_files(df, "RET").collect()}
    found = {}
    for p in (tmp_path / "out").iterdir():
        text, values = parsed(p.read_bytes())
        found[text["Filename"]] = sorted(values)
    assert found == want and found["g"] == [] and len(found["f/1"]) > 300
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["f%2F0.fcs", "f%2F1.fcs", "f%2F2.fcs", "f%2F3.fcs", "g.fcs"]
    broken = df.withColumn("SFL", F.when(F.col("file_key") == "f/3", F.raise_error(F.lit("lost"))).otherwise(F.col("SFL")))
    with pytest.raises(Exception, match="lost"):
        event_source.write_fcs(broken, str(tmp_path / "failed"), "RET")
    assert not (tmp_path / "failed").exists() or list((tmp_path / "failed").iterdir()) == []
