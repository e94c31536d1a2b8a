"""Event clouds: one file for each sample and channel, with overflow files."""

from __future__ import annotations

import csv
import logging
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.columns import c, fsc_log, num
from .tables import mangled

log = logging.getLogger("hemaspark")

NAME = r"^([A-Za-z0-9-]+)_\[([^\]]*)\]\[([^\]]*)\]\[(\d{8}_\d{6})\]\[([^\]]*)\]"
OVERFLOW = r"\.116\(\d+\)\.csv$"


def file_facts(name: Column) -> dict[str, Column]:
    """Channel, analyser, batch, time and sample number of a file name; nulls where it isn't such a name."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract(name, NAME, i)), F.lit(""))
    return {"channel": part(1), "analyser_id": part(2), "batch": part(3), "measured_at": F.try_to_timestamp(part(4), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz"), "sample_number": part(5)}


def sample_number(name: Column) -> Column:
    """The last bracket of a file name, looser than file_facts."""
    return F.trim(F.try_element_at(F.regexp_extract_all(name, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), F.lit(-1)))


def measured_at(name: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def channel_of(name: Column) -> Column:
    return F.split(name, "_")[0]


def is_overflow(name: Column) -> Column:
    return name.rlike(OVERFLOW)


def file_key(name: Column) -> Column:
    """The same for a file and its overflow files, whatever their numbers."""
    return F.regexp_replace(name, r"\.116\(\d+\)\.csv$", ".116.csv")


def without_overflow(paths: list[str]) -> list[str]:
    return [p for p in paths if not re.search(OVERFLOW, p)]


def channel_columns(channel: str) -> list[str]:
    if channel not in K.EVENT_COLUMNS:
        raise ValueError(f"unknown channel {channel!r}")
    return K.EVENT_COLUMNS[channel]


def preprocess(df: DataFrame, channel: str, extra: list[str] | None = None) -> DataFrame:
    """A channel's events: complete rows of the first count (RepeatCount 0, where there is such a column), its columns in order.
    PLTF: FSCW is 255 in phase A and may be missing. RBC and PLT: the column Data."""
    extra = extra or []
    names = channel_columns(channel)
    if channel in ("RBC", "PLT"):
        return df.select(*extra, num(df, "Data").alias("Data")).where("Data is not null")
    if "RepeatCount" in df.columns:
        df = df.where(num(df, "RepeatCount") == 0)
    elif channel != "RET":
        raise ValueError(f"{channel} needs RepeatCount")
    value = {n: num(df, n) for n in names}
    if channel == "PLTF":
        value["FSCW"] = F.when(c("Phase") == "A", 255.0).otherwise(value["FSCW"])
    out = df.select(*extra, *[v.alias(n) for n, v in value.items()])
    return out.dropna(subset=[n for n in names if not (channel == "PLTF" and n == "FSCW")])


def overflow_chains(files: DataFrame, name: str = "name") -> DataFrame:
    """The rows of a list of files without overflow files that stand behind a gap: (1) may be missing, from (2) on numbers follow each
    other, up to (99). A file's overflow files are few, so a window for each file holds little."""
    number = F.regexp_extract(c(name), r"\.116\((\d+)\)\.csv$", 1)
    rows = files.withColumns({"_key": file_key(c(name)), "_no": F.when(number != "", number.try_cast("int")).otherwise(0)})
    order = Window.partitionBy("_key", F.col("_no") > 1).orderBy("_no")
    return rows.withColumn("_seen", F.dense_rank().over(order)).where("_no <= 1 or _no = _seen + 1 and _no <= 99").drop("_key", "_no", "_seen")


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, name, line): each file's first line, in one pass for all files."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    first = raw.where("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "n").alias("line"))
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return first.select(plain.alias("path"), F.element_at(F.split(plain, "/"), -1).alias("name"), F.regexp_replace("line", "^\ufeff", "").alias("line"))


def read_events(spark: SparkSession, path: str | list[str], channel: str, samples: DataFrame | None = None) -> DataFrame:
    """All files of a channel as one table: file key and facts of the name beside the events. Overflow files belong to their file,
    up to the first gap in their numbers (see overflow_chains).

    Each file is read by its own header: files with the same header are one scan, and scans are put together by column name. Which
    files are read is decided on their names: those of other channels are left out, and `samples` (a list of numbers) limits
    them, too. A file without the channel's columns is logged and left out; none at all is an error.
    """
    files = headers(spark, path)
    facts = file_facts(F.col("name"))
    files = files.withColumns({"channel": facts["channel"], "sample_number": facts["sample_number"]}).where(F.col("channel").eqNullSafe(F.lit(channel)) | F.col("channel").isNull())
    if samples is not None:
        files = files.join(samples.select(F.col(samples.columns[0]).alias("_sid")).distinct(), F.col("sample_number") == F.col("_sid"), "left_semi")
    files = overflow_chains(files.select("path", "name", "line"), "name")
    needed = set(channel_columns(channel)) - ({"FSCW"} if channel == "PLTF" else set()) | ({"Data"} if channel in ("RBC", "PLT") else set() if channel == "RET" else {"RepeatCount"}) | ({"Phase"} if channel == "PLTF" else set())
    scans = []
    for line, paths in files.groupBy("line").agg(F.sort_array(F.collect_list("path"))).orderBy("line").collect():  # names of files only
        names = mangled(next(csv.reader([line])))
        if missing := sorted(needed - set(names)):
            for p in paths:
                log.warning("%s: no columns %s", p, missing)
            continue
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        literal = [re.sub(r"([][{}*?\\])", r"\\\1", p) for p in paths]  # names hold brackets, which are no patterns here
        raw = spark.read.schema(schema).option("header", True).csv(literal)
        if channel == "PLTF" and "FSCW" not in names:
            raw = raw.withColumn("FSCW", F.lit(None).cast("string"))
        name = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), "/"), -1)
        raw = raw.withColumn("_file", name)
        own = file_facts(F.col("_file"))
        scans.append(preprocess(raw.withColumns(own | {"file_key": file_key(F.col("_file"))}), channel, ["file_key", *own]))
    if not scans:
        if files.isEmpty():  # other channels or samples only
            kinds = {"measured_at": "timestamp_ntz"} | {n: "double" for n in channel_columns(channel) or ["Data"]}
            return spark.createDataFrame([], ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in ["file_key", *facts, *(channel_columns(channel) or ["Data"])]))
        raise ValueError(f"no file of {channel} could be read")
    return reduce(lambda a, b: a.unionByName(b), scans)


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """Clouds of one channel under each other; none, or several channels, is an error."""
    if not frames:
        raise ValueError("nothing to concatenate")
    from .tables import union_by_name

    out = union_by_name(frames)
    if out.select("channel").distinct().limit(2).count() > 1:
        raise ValueError("clouds of more than one channel")
    return out


def write_events(df: DataFrame, path: str, channel: str) -> None:
    """Events by channel and sample; RET also gets FSClog."""
    out = df.withColumn("FSClog", fsc_log(F.col("FSC"))) if channel == "RET" else df
    out.write.mode("errorifexists").partitionBy(*[n for n in ("channel", "sample_number") if n in out.columns]).parquet(path)


def without_extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a 0 and without the table's greatest value in any of the columns, as binary exports leave them out."""
    top = df.agg(F.greatest(*[F.max(c(n)) for n in columns]) if len(columns) > 1 else F.max(c(columns[0]))).first()[0]
    cond = F.lit(True)
    for n in columns:
        cond = cond & (c(n) != 0) & (c(n) != F.lit(top))
    return df.where(cond)


def preprocess_all(spark: SparkSession, paths: dict[str, str | list[str]], folder: str) -> dict[str, str]:
    """Reads and preprocesses the files of each channel in `paths` and writes a table for each: {channel: its path}. A channel's files
    are read and written by all tasks at once, by sample."""
    out = {}
    for channel, path in paths.items():
        out[channel] = f"{folder.rstrip('/')}/{channel}"
        write_events(read_events(spark, path, channel), out[channel], channel)
    return out


FCS = T.StructType([T.StructField("file_key", T.StringType()), T.StructField("n_events", T.LongType()), T.StructField("content", T.BinaryType())])


def fcs_header(count: int, top: np.ndarray, names: list[str], facts: dict[str, str]) -> bytes:
    """Header and text of keywords of a flow cytometry standard file (FCS 3.1) with `count` events of little-endian 32-bit floats, whose
    greatest values are `top`; the data follow."""
    escape = lambda x: str(x).replace("/", "//") or " "
    own = {"$BEGINANALYSIS": 0, "$ENDANALYSIS": 0, "$BEGINSTEXT": 0, "$ENDSTEXT": 0, "$BYTEORD": "1,2,3,4", "$DATATYPE": "F", "$MODE": "L", "$NEXTDATA": 0, "$PAR": len(names), "$TOT": count}
    for i, n in enumerate(names):
        own |= {f"$P{i + 1}B": 32, f"$P{i + 1}E": "0,0", f"$P{i + 1}N": n, f"$P{i + 1}R": int(np.ceil(top[i])) + 1}
    # Offsets are of fixed width, so the text's length doesn't depend on them.
    text = lambda a, b: "/" + "".join(f"{k}/{escape(v)}/" for k, v in ({"$BEGINDATA": f"{a:012d}", "$ENDDATA": f"{b:012d}"} | own | facts).items())
    begin = 58 + len(text(0, 0).encode())
    end = begin + max(4 * count * len(names), 1) - 1
    raw = text(begin, end).encode()
    short = lambda x: f"{x if x < 10**8 else 0:>8d}"
    return f"FCS3.1    {short(58)}{short(begin - 1)}{short(begin)}{short(end)}{short(0)}{short(0)}".encode() + raw


def fcs_bytes(values: np.ndarray, names: list[str], facts: dict[str, str]) -> bytes:
    """A whole file: header, text, data event by event."""
    return fcs_header(len(values), values.max(axis=0) if len(values) else np.zeros(len(names)), names, facts) + np.ascontiguousarray(values, "<f4").tobytes()


def fcs_files(events: DataFrame, channel: str) -> DataFrame:
    """(file_key, n_events, content): a binary file for each file of events (see read_events), without rows that hold a 0 or the file's
    greatest value. A file's events are one sample's, which one task holds."""
    names = channel_columns(channel)
    facts = {"Analyser": "analyser_id", "Date": "measured_at", "SampleNumber": "sample_number"}
    complete = events.dropna(subset=names)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[names].to_numpy(float)
        x = x[(x != 0).all(axis=1)]
        x = x[(x != x.max(initial=-np.inf)).all(axis=1)] if len(x) else x
        own = {k: str(pdf[n].iloc[0]) for k, n in facts.items() if n in pdf} | {"Channel": channel, "Filename": str(pdf["file_key"].iloc[0])}
        return pd.DataFrame([(pdf["file_key"].iloc[0], len(x), fcs_bytes(x, names, own))], columns=FCS.names)

    return complete.groupBy("file_key").applyInPandas(make, FCS)
