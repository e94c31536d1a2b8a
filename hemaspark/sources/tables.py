"""Sample tables, sample lists, saved arrays; and what is written."""

from __future__ import annotations

import csv
import logging
import time
from collections import Counter
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, na_to_null

log = logging.getLogger("hemaspark")
ENCODING = "ISO-8859-1"


def mangled(names: list[str]) -> list[str]:
    """Repeated header names get .1, .2, ... behind them, empty ones become Unnamed: <position>."""
    seen: Counter = Counter()
    out: list[str] = []
    for i, n in enumerate(names):
        n = n or f"Unnamed: {i}"
        k = n
        while k in out:
            seen[n] += 1
            k = f"{n}.{seen[n]}"
        out.append(k)
    return out


def header(spark: SparkSession, path: str, sep: str = ",", encoding: str = ENCODING) -> list[str]:
    """Column names of a CSV file: its first line only, read through Spark, so any store will do."""
    row = spark.read.option("encoding", encoding).option("header", False).option("sep", sep).option("quote", "\u0000").option("sep", "\u0001").csv(path).limit(1).collect()
    if not row or row[0][0] is None:
        raise ValueError(f"{path} has no header")
    return mangled(next(csv.reader([row[0][0]], delimiter=sep)))


def read_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = ENCODING) -> DataFrame:
    """A CSV file (or folder of files with the same header) as text columns; missing tokens are null. Repeated names are told apart."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header(spark, path, sep, encoding)])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", encoding).option("sep", sep).csv(path)
    return df.select(*[na_to_null(c(n)).alias(n) for n in df.columns])


def read_tables(spark: SparkSession, paths: list[str] | str, sep: str = ",", encoding: str = ENCODING) -> DataFrame:
    """Several files one after the other, by column name. A file that can't be read is logged and left out; none at all is an error."""
    frames = []
    for p in [paths] if isinstance(paths, str) else paths:
        try:
            frames.append(read_table(spark, p, sep, encoding))
        except Exception as e:  # noqa: BLE001 - the next file may be fine
            log.warning("%s: %s", p, str(e).splitlines()[0])
    if not frames:
        raise ValueError("no file could be read")
    return union_by_name(frames)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample_number): one a line in .txt, the column of that name (or the first) in .csv, a saved array in .npy."""
    if path.endswith(".npy"):
        import io

        import numpy as np

        raw = spark.read.format("binaryFile").load(path).first()["content"]
        values = np.load(io.BytesIO(bytes(raw)), allow_pickle=False)
        return spark.createDataFrame([(str(x),) for x in values.ravel()], "sample_number string")
    if path.endswith(".csv"):
        df = read_table(spark, path)
        return df.select(c("sample_number" if "sample_number" in df.columns else df.columns[0]).alias("sample_number")).where("sample_number is not null")
    return spark.read.text(path).select(F.trim("value").alias("sample_number")).where("sample_number <> ''")


def read_arrays(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(file, row, values) of all saved two-dimensional arrays under a path, files by tasks; one-dimensional ones are a column.
    Arrays of objects are an error, as reading them could run code."""
    import io

    import numpy as np
    import pandas as pd

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf["name"], pdf["content"], strict=True):
                x = np.atleast_1d(np.load(io.BytesIO(raw), allow_pickle=False).astype(float))
                x = x.reshape(len(x), -1)
                for a in range(0, len(x), 10_000):
                    yield pd.DataFrame({"file": name, "row": range(a, min(a + 10_000, len(x))), "values": list(x[a : a + 10_000])})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(rows, "file string, row long, values array<double>")


def read_matching(spark: SparkSession, root: str, glob: str = "*.csv", sep: str = ",", encoding: str = ENCODING) -> DataFrame:
    """All tables under a folder whose names match, one after the other, by column name."""
    paths = [r["path"] for r in listing(spark, root, glob).select("path").orderBy("path").collect()]  # names of files only
    if not paths:
        raise ValueError(f"nothing under {root} matches {glob}")
    return read_tables(spark, paths, sep, encoding)


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, name, size) of all files under a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def catalogue(spark: SparkSession, root: str, qc_only: bool = True, drop_bracketed: bool = True) -> DataFrame:
    """listing with its channel or table; controls only (names with QC) and without names that end in ).csv, as asked."""
    rows = listing(spark, root).withColumn("kind", F.coalesce(F.nullif(F.regexp_extract("name", r"^(RET|PLTF|WDF|WNR|WPC|RBC|PLT)_", 1), F.lit("")), F.when(F.lower("name").endswith(".csv"), F.lit("TABLE"))))
    if qc_only:
        rows = rows.where(F.col("name").contains("QC"))
    return rows.where(~F.col("name").endswith(").csv")) if drop_bracketed else rows


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet", stamp: bool = True, partition_by: list[str] | None = None) -> str:
    """Writes <folder>/<name>[_<time>] as Parquet or CSV and returns the path."""
    path = f"{folder.rstrip('/')}/{name}" + (time.strftime("_%Y%m%d_%H%M%S") if stamp else "")
    w = df.write.mode("errorifexists")
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.option("header", True).csv if fmt == "csv" else w.parquet)(path)
    return path
