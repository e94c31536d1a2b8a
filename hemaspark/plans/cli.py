"""Command line: python -m hemaspark.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

from ..operators import profile
from ..sources import config, events, tables
from . import api


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hemaspark")
    p.add_argument("-v", "--verbose", action="count", default=0)
    s = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: tuple) -> None:
        q = s.add_parser(name, help=text)
        for flags, kw in options:
            q.add_argument(*flags, **kw)

    out = (("--output-dir",), {"default": "./output"})
    command("clean", "clean sample tables", (("--config",), {}), (("--dataset",), {}), (("--files",), {"nargs": "*", "default": []}), out)
    command("fit-events", "fit an event aligner", (("channel",), {}), (("source",), {}), (("target",), {}), (("model",), {}), (("--components",), {"type": int, "default": 60}), (("--reg",), {"type": float, "default": 1e-5}), (("--max-iter",), {"type": int, "default": 200}), (("--n-init",), {"type": int, "default": 3}))
    command("align-events", "apply an event aligner", (("model",), {}), (("source",), {}), out)
    command("align-histograms", "fit and apply a histogram aligner", (("source",), {}), (("target",), {}), (("--source-samples",), {}), (("--target-samples",), {}), out)
    command("align-table", "fit and apply a table aligner", (("source",), {}), (("target",), {}), (("--columns",), {"required": True, "help": "file with a column name a line"}), (("--source-samples",), {}), (("--target-samples",), {}), out)
    command("profile", "describe a table", (("file",), {}), (("--rows",), {"type": int, "default": 100_000}))
    command("compare", "compare two tables", (("first",), {}), (("second",), {}), (("--rows",), {"type": int, "default": 100_000}))
    command("check-paths", "which configured paths exist", (("config",), {}))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    spark = spark or SparkSession.builder.appName("hemaspark").getOrCreate()
    samples = lambda path: tables.read_sample_list(spark, path) if path else None
    if a.command == "clean":
        cleaner = api.SampleCleaner(a.config, output_dir=a.output_dir, spark=spark)
        if a.files:
            cleaner.clean_files(spark, a.files, a.dataset)
        else:
            cleaner.clean_datasets(spark, a.dataset)
    elif a.command == "fit-events":
        model = api.EventAligner(a.channel, a.components, reg=a.reg, max_iter=a.max_iter, n_init=a.n_init)
        api.save_json(model.fit(*(events.read_events(spark, p, a.channel) for p in (a.source, a.target))), a.model)
    elif a.command == "align-events":
        model = api.load_json(api.EventAligner, a.model)
        events.write_events(model.transform(events.read_events(spark, a.source, model.channel)), f"{a.output_dir}/{model.channel}", model.channel)
    elif a.command in ("align-histograms", "align-table"):
        source, target = (tables.read_table(spark, p) for p in (a.source, a.target))
        if a.command == "align-table":
            with open(a.columns, encoding="utf-8") as f:
                model = api.TableAligner([x.strip() for x in f if x.strip()])
            moved = model.fit(source, target, samples(a.source_samples), samples(a.target_samples)).transform(source, passthrough=True)
        else:
            moved = api.HistogramAligner().fit(source, target, samples(a.source_samples), samples(a.target_samples)).transform(source)
        tables.write_table(moved, a.output_dir, "aligned", stamp=False)
    elif a.command == "profile":
        df = profile.sample_for_profile(tables.read_table(spark, a.file), a.rows)
        profile.profile_table(df).show(truncate=False)
        profile.profile_columns(df).show(1000, truncate=False)
    elif a.command == "compare":
        x, y = (profile.sample_for_profile(tables.read_table(spark, p), a.rows) for p in (a.first, a.second))
        profile.compare_columns(x, y).show(1000, truncate=False)
        profile.compare_tables(x, y).show(1000, truncate=False)
    else:
        print(json.dumps(config.Catalog.load(a.config).check_all(spark), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
