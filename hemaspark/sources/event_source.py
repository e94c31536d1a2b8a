"""Event files as a data source and binary event files as a sink of Spark: `spark.read.format("events")`, `df.write.format("fcs")`."""

from __future__ import annotations

import logging
import posixpath
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .. import constants as K
from ..functions.columns import c

log = logging.getLogger("hemaspark")
FACTS = "file_key string, channel string, analyser_id string, batch string, measured_at timestamp_ntz, sample_number string"
#: Rows of a batch that is handed over or written at once.
ROWS = 100_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a path or URI that Python can open (local and mounted folders, s3, gs, hdfs)."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+://", path) else (fs.LocalFileSystem(), path)


def kept_of_chains(names: list[str]) -> dict[str, list[str]]:
    """{file key: a file and its overflow files in order}, up to the first gap in their numbers ((1) may be missing, (99) is the last)."""
    from .events import OVERFLOW

    chains: dict[str, dict[int, str]] = defaultdict(dict)
    for n in names:
        number = re.search(r"\.116\((\d+)\)\.csv$", n)
        chains[re.sub(OVERFLOW, ".116.csv", n)][int(number[1]) if number else 0] = n
    out = {}
    for key, files in chains.items():
        last = 1
        while last + 1 in files and last < 99:
            last += 1
        if own := [files[i] for i in sorted(files) if i <= last]:
            out[key] = own
    return out


@dataclass
class Chain(InputPartition):
    """A file and its overflow files, with what their name says."""

    key: str
    paths: list[str]
    facts: tuple


class EventSource(DataSource):
    """Files of one channel (option channel) under a path (option path, or load's): facts of the name, then the channel's columns.

    A partition is a file with its overflow files, and each file is read by its own header. Option samples: numbers,
    separated by commas; those and filters on sample_number are decided on names, before a file is opened. A file that can't
    be read is logged and left out. Needs a store that Python can open; read_events takes any that Spark can.
    """

    @classmethod
    def name(cls) -> str:
        return "events"

    def schema(self) -> str:
        names = K.EVENT_COLUMNS[self.options["channel"]] or ["Data"]
        return ", ".join([FACTS, *[f"`{n}` double" for n in names]])

    def reader(self, schema: Any) -> EventReader:
        return EventReader(self.options["path"], self.options["channel"], [x for x in self.options.get("samples", "").split(",") if x] or None)


class EventReader(DataSourceReader):
    def __init__(self, path: str, channel: str, samples: list[str] | None) -> None:
        self.path, self.channel, self.samples = path, channel, set(samples) if samples is not None else None
        self.names = K.EVENT_COLUMNS[channel] or ["Data"]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on sample_number choose files; all others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sample_number",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.samples = values if self.samples is None else self.samples & values
            else:
                yield f

    def partitions(self) -> list[Chain]:
        from .events import NAME

        files, root = opened(self.path)
        found = files.get_file_info(root)
        every = [found] if found.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        paths = {posixpath.basename(x.path): x.path for x in sorted(every, key=lambda x: x.path) if x.is_file and x.path.lower().endswith(".csv")}
        out = []
        for key, chain in sorted(kept_of_chains(list(paths)).items()):
            m = re.match(NAME, key)
            own = [x.strip() or None for x in m.groups()] if m else [None] * 5
            if (own[0] in (self.channel, None)) and (self.samples is None or own[4] in self.samples):
                out.append(Chain(key, [paths[n] for n in chain], tuple(own)))
        return out or [Chain("", [], ())]

    def _values(self, path: str) -> np.ndarray:
        """Complete events of one file, by its own header (see events.preprocess)."""
        from pyarrow import csv

        files, at = opened(path if self.path[:1] == "/" else re.sub(r"^([a-z0-9+]+://[^/]*).*", r"\1", self.path) + "/" + path.lstrip("/") if "://" in self.path and not self.path.startswith("file:") else path)
        with files.open_input_stream(at) as raw:
            text = csv.read_csv(raw, csv.ReadOptions(encoding="ISO-8859-1"), convert_options=csv.ConvertOptions(strings_can_be_null=True))
        number = lambda n: np.array([_number(v) for v in text[n].to_pylist()], float) if not pa.types.is_floating(text[n].type) and not pa.types.is_integer(text[n].type) else text[n].to_numpy().astype(float)
        loose = "FSCW" if self.channel == "PLTF" else None
        if missing := [n for n in self.names if n not in text.column_names and n != loose]:
            raise ValueError(f"no columns {missing}")
        x = np.column_stack([number(n) if n in text.column_names else np.full(len(text), np.nan) for n in self.names])
        keep = np.ones(len(x), bool)
        if self.channel not in ("RBC", "PLT"):
            if "RepeatCount" in text.column_names:
                keep = number("RepeatCount") == 0
            elif self.channel != "RET":
                raise ValueError("no column RepeatCount")
        if loose:
            x[np.array(text["Phase"].to_pylist(), object) == "A", self.names.index(loose)] = 255.0
        needed = [i for i, n in enumerate(self.names) if n != loose]
        return x[keep & ~np.isnan(x[:, needed]).any(axis=1)]

    def read(self, chain: Chain) -> Iterator[pa.RecordBatch]:
        for path in chain.paths:
            try:
                x = self._values(path)
            except Exception as e:  # noqa: BLE001 - the next file may be fine
                log.warning("%s: %s", path, str(e).splitlines()[0])
                continue
            channel, analyser, batch, at, sample = chain.facts
            try:
                when = datetime.strptime(at, "%Y%m%d_%H%M%S") if at else None
            except ValueError:
                when = None
            for a in range(0, len(x), ROWS):
                part = x[a : a + ROWS]
                same = lambda v, t: pa.array([v] * len(part), t)  # noqa: B023, E731
                facts = [same(v, pa.string()) for v in (chain.key, channel, analyser, batch)] + [same(when, pa.timestamp("us")), same(sample, pa.string())]
                yield pa.RecordBatch.from_arrays([*facts, *[pa.array(part[:, i], pa.float64(), from_pandas=True) for i in range(x.shape[1])]], names=["file_key", "channel", "analyser_id", "batch", "measured_at", "sample_number", *self.names])


def _number(v: Any) -> float:
    try:
        return float(v)
    except (TypeError, ValueError):
        return float("nan")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FcsSink(DataSource):
    """Binary event files under a folder (option path): one for each file_key, made of rows ordered by it (see write_fcs)."""

    @classmethod
    def name(cls) -> str:
        return "fcs"

    def writer(self, schema: Any, overwrite: bool) -> FcsWriter:
        return FcsWriter(self.options["path"], self.options["channel"], list(schema.names))


class FcsWriter(DataSourceArrowWriter):
    """Tasks write whole files beside the folder's contents, a commit moves all of them, an abort deletes them: no file is there in part.

    Events are written as they come, to a file of data; the header goes before it when a file's last event is known, so a task holds a
    batch and not a file.
    """

    def __init__(self, path: str, channel: str, names: list[str]) -> None:
        self.path, self.channel, self.columns = path.rstrip("/"), channel, names
        self.values = K.EVENT_COLUMNS[channel] or ["Data"]
        self.folder = f"_temporary/{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from .events import fcs_header

        files, root = opened(self.path)
        own = f"{root}/{self.folder}/{uuid.uuid4().hex}"  # of this attempt
        files.create_dir(own, recursive=True)
        done: list[str] = []
        key = stream = None
        facts: dict[str, str] = {}
        count, top = 0, np.zeros(len(self.values))

        def close() -> None:
            stream.close()
            target = f"{own}/{quote(key, safe=' ()[]^~+,=@-')}.fcs"
            with files.open_output_stream(target) as out, files.open_input_stream(f"{own}/data") as raw:
                out.write(fcs_header(count, top, self.values, facts))
                while part := raw.read(1 << 20):
                    out.write(part)
            files.delete_file(f"{own}/data")
            done.append(target)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = rows["file_key"].to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != key or stream is None:
                    if stream is not None:
                        close()
                    key, count, top = keys[a], 0, np.zeros(len(self.values))
                    stream = files.open_output_stream(f"{own}/data")
                    facts = {k: str(rows[n][a].as_py()) for k, n in (("Analyser", "analyser_id"), ("Date", "measured_at"), ("SampleNumber", "sample_number")) if n in rows.column_names} | {"Channel": self.channel, "Filename": key}
                part = rows.slice(a, b - a)
                x = np.column_stack([part[n].to_numpy() for n in self.values])[part["keep"].to_numpy()]
                if len(x):
                    count, top = count + len(x), np.maximum(top, x.max(axis=0)) if count else x.max(axis=0)
                    stream.write(np.ascontiguousarray(x, "<f4").tobytes())
        if stream is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        names = [f for m in messages if m is not None for f in m.files]
        for f in names:
            files.move(f, f"{root}/{posixpath.basename(f)}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.folder}")
        above = f"{root}/_temporary"
        if files.get_file_info(above).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(above)):
            files.delete_dir(above)


def register(spark: SparkSession) -> None:
    """Makes the formats "events" and "fcs" known to a session, and lets filters reach the first."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EventSource, FcsSink):
        spark.dataSource.register(source)


def write_fcs(events: DataFrame, path: str, channel: str) -> None:
    """A binary file for each file of events (see read_events), without rows that hold a 0 or the file's greatest value (of rows without a 0).

    A file's greatest value is aggregated first; then its events meet in one task, ordered, and stream through it. A file of which
    nothing is left is written without events. Files appear when all are complete.
    """
    register(events.sparkSession)
    names = K.EVENT_COLUMNS[channel] or ["Data"]
    rows = events.dropna(subset=names)
    nonzero = F.lit(True)
    for n in names:
        nonzero = nonzero & (c(n) != 0)
    most = F.greatest(*[c(n) for n in names]) if len(names) > 1 else c(names[0])
    tops = rows.groupBy("file_key").agg(F.max(F.when(nonzero, most)).alias("_top"))
    kept = nonzero
    for n in names:
        kept = kept & (c(n) != F.col("_top"))
    facts = [n for n in ("analyser_id", "measured_at", "sample_number") if n in events.columns]
    out = rows.join(tops, "file_key").select("file_key", *[c(n).cast("string").alias(n) for n in facts], *[c(n).cast("double").alias(n) for n in names], F.coalesce(kept, F.lit(False)).alias("keep"))
    out.repartition("file_key").sortWithinPartitions("file_key").write.format("fcs").option("channel", channel).mode("append").save(path)
