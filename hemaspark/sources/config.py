"""Configuration: YAML trees with ${a.b} references, and where data sets are."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from . import tables


def _text(spark: SparkSession | None, path: str) -> str:
    if spark is not None:
        return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    with open(path, encoding="utf-8") as f:
        return f.read()


def resolve(tree: dict) -> dict:
    """References replaced by what they name, again and again; one that names nothing, or itself, is an error."""

    def look(name: str, trail: tuple[str, ...]) -> str:
        if name in trail:
            raise ValueError(f"circular reference {name!r}")
        value = tree
        for part in name.split("."):
            if not isinstance(value, dict) or part not in value:
                raise ValueError(f"unknown reference {name!r}")
            value = value[part]
        return walk(value, (*trail, name))

    def walk(x, trail: tuple[str, ...] = ()):
        if isinstance(x, dict):
            return {k: walk(v, trail) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, trail) for v in x]
        if isinstance(x, str):
            return re.sub(r"\$\{([^}]+)\}", lambda m: str(look(m[1], trail)), x)
        return x

    return walk(tree)


def load_yaml(path: str, spark: SparkSession | None = None) -> dict:
    import yaml

    return yaml.safe_load(_text(spark, path)) or {}


class Catalog:
    """Paths by name: base_paths, datasets by category, files by category."""

    def __init__(self, tree: dict) -> None:
        self.tree = resolve(tree)

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> Catalog:
        return Catalog(load_yaml(path, spark))

    def _get(self, *keys: str) -> str:
        value = self.tree
        for k in keys:
            if not isinstance(value, dict) or k not in value:
                raise KeyError(".".join(keys))
            value = value[k]
        return value

    def base_path(self, name: str) -> str:
        return self._get("base_paths", name)

    def dataset_path(self, category: str, name: str) -> str:
        return self._get("datasets", category, name)

    def file_path(self, category: str, name: str) -> str:
        return self._get("files", category, name)

    def datasets(self, category: str | None = None) -> dict:
        tree = self.tree.get("datasets", {})
        return tree if category is None else tree.get(category, {})

    def files(self, category: str | None = None) -> dict:
        tree = self.tree.get("files", {})
        return tree if category is None else tree.get(category, {})

    def exists(self, spark: SparkSession, path: str) -> bool:
        """Asked of the path's own file system."""
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def check_all(self, spark: SparkSession) -> dict[str, bool]:
        found = {f"datasets.{a}.{b}": p for a, x in self.datasets().items() for b, p in x.items()} | {f"files.{a}.{b}": p for a, x in self.files().items() for b, p in x.items()}
        return {k: self.exists(spark, p) for k, p in found.items()}

    def read_dataset(self, spark: SparkSession, category: str, name: str, pattern: str = "*.csv") -> DataFrame:
        """All CSV files of a data set, by name."""
        path = self.dataset_path(category, name)
        return tables.read_tables(spark, [r["path"] for r in tables.listing(spark, path, pattern).select("path").collect()])

    def read_samples(self, spark: SparkSession, category: str, name: str) -> DataFrame:
        return tables.read_sample_list(spark, self.file_path(category, name))


def gates_from_json(text: str) -> dict[str, list]:
    gates = json.loads(text)
    if not all(isinstance(p, list) and all(len(v) == 2 for v in p) for p in gates.values()):
        raise ValueError("gates are lists of [x, y] by name")
    return {k: [[float(x), float(y)] for x, y in p] for k, p in gates.items()}


def load_gates(path: str | None = None, channel: str | None = None, spark: SparkSession | None = None) -> dict[str, list]:
    """Gates of a JSON file, or a channel's own. (Pickled gates are not read: that would run code.)"""
    if path:
        return gates_from_json(_text(spark, path))
    if channel not in K.GATES:
        raise ValueError(f"no gates for channel {channel!r}")
    return K.GATES[channel]


def save_gates(gates: dict[str, list], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(gates, f)
