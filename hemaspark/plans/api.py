"""The library's classes: configure, fit, transform. Every estimator aggregates on the cluster, solves on the driver, and applies on the cluster."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import any_of, c, forward, gate_last, inverse, is_true, num
from ..operators import clean, encoder, gam, gmm, mixtures, profile, repeats, sampling, stats, transport
from ..sources import config, tables
from ..storage import written

log = logging.getLogger("hemaspark")


@dataclass
class CleanResult:
    """The cleaned table, rows of samples that disagree, rows of samples that disagree once, correlations, missing shares, and how many
    rows each stage dropped (or flagged)."""

    main: DataFrame
    odd: DataFrame | None = None
    one_different: DataFrame | None = None
    report: DataFrame | None = None
    missing: DataFrame | None = None
    dropped: dict[str, int] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)


class StageCounts:
    """Rows that each stage drops, or flags with new drop* columns, as metrics observed while the stages' result is written: no job of
    their own. Spark 4.1 can't send a session that has observed rows to tasks, which Spark ML's logistic models try to when they
    transform; count_stages=False leaves counts out."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation, list[str]]] = []

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        """df after a stage (the first one watched is the input)."""
        before = self._seen[-1][2] if self._seen else df.columns
        flags = [n for n in df.columns if n.startswith("drop") and n not in before]
        seen = Observation()
        self._seen.append((stage, seen, df.columns))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(any_of([is_true(c(n)) for n in flags])).alias("flagged"))

    def dropped(self) -> dict[str, int]:
        """By stage, after the table that was watched has been written."""
        rows = [(stage, seen.get) for stage, seen, _ in self._seen]
        return {stage: old["rows"] - new["rows"] + new["flagged"] for (_, old), (stage, new) in zip(rows, rows[1:], strict=False)}


class SampleCleaner:
    """Cleaning of sample tables.

    clean(df) runs the stages in order: duplicate rows, technical samples, channel masks, unused columns, flags, marks, duplicate
    columns, clotted samples, repeated measurements, sentinels and numbers, redundant columns, correlations. What precedes
    the repeats is written once to the shared folder, as several later stages read it. With keep_drop_rows no row goes: drop* columns
    say why it would.
    """

    def __init__(self, config_path: str | None = None, remove_clotted: bool = True, consolidate: bool = True, remove_correlated: bool = False, std_threshold: float = 1.0, keep_drop_rows: bool = False, one_hot_marks: bool = False, output_dir: str = "./output", output_prefix: str = "cleaned", diagnostics: bool = False, fmt: str = "parquet", spark: SparkSession | None = None, count_stages: bool = True) -> None:
        tree = config.load_yaml(config_path, spark) if config_path else {}
        proc, out = tree.get("processing", {}), tree.get("output", {})
        self.tree = tree
        self.remove_clotted = proc.get("remove_clotintube", remove_clotted)
        self.consolidate = proc.get("remove_multimeasurementsamples", consolidate)
        self.remove_correlated = proc.get("remove_correlated", remove_correlated)
        self.std_threshold = proc.get("std_threshold", std_threshold)
        self.keep_drop_rows = proc.get("keep_drop_rows", keep_drop_rows)
        self.one_hot_marks = proc.get("make_dummy_marks", one_hot_marks)
        self.output_dir, self.output_prefix = out.get("directory", output_dir), out.get("filename_prefix", output_prefix)
        self.diagnostics, self.fmt, self.count_stages = diagnostics, fmt, count_stages
        self.last: CleanResult | None = None

    def prepared(self, df: DataFrame, counts: StageCounts | None = None) -> DataFrame:
        """The stages before the repeats: one plan, two shuffles (duplicates; none for the rest)."""
        watch = counts.watch if counts else lambda df, stage: df
        df = watch(clean.first_of_duplicate_columns(df), "input")
        df = watch(clean.drop_duplicate_rows(df), "duplicates")
        df = watch(clean.remove_technical_samples(df, flag=self.keep_drop_rows), "technical samples")
        if clean.DISCRETE in df.columns:
            df = clean.mask_channels(df)
        df = clean.process_marks(clean.encode_flags(clean.drop_unused_columns(df)), one_hot=self.one_hot_marks)
        return watch(clean.remove_clotted(df, flag=self.keep_drop_rows), "clotted") if self.remove_clotted else df

    def clean(self, df: DataFrame) -> CleanResult:
        counts, odd, one = StageCounts(), None, None
        table = written(self.prepared(df, counts if self.count_stages else None), "prepared")
        if self.consolidate:
            table, odd, one = repeats.consolidate_repeats(table, self.std_threshold, flag=self.keep_drop_rows, shared=True)
            table = written(counts.watch(table, "repeats") if self.count_stages else table, "consolidated")
            odd, one = repeats.anonymised(odd), repeats.anonymised(one)
        table = clean.drop_redundant(clean.promote_numeric(clean.null_sentinels(table)))
        report = profile.correlation_report(table)
        if self.remove_correlated:
            table = profile.drop_correlated(table, report)
        if self.keep_drop_rows:
            table = clean.drop_union(table)
        self.last = CleanResult(table, odd, one, report, clean.missing_share(table), counts.dropped())
        for stage, n in self.last.dropped.items():
            log.info("%s: %d rows dropped", stage, n)
        return self.last

    def clean_files(self, spark: SparkSession, paths: list[str] | str, dataset: str | None = None, save: bool = True) -> DataFrame:
        result = self.clean(tables.read_tables(spark, paths))
        if save:
            name = f"{self.output_prefix}_{dataset}" if dataset else self.output_prefix
            result.files["main"] = tables.write_table(result.main, self.output_dir, name, self.fmt)
            if self.diagnostics:
                for k, t in {"odd": result.odd, "one_different": result.one_different, "correlations": result.report}.items():
                    if t is not None:
                        result.files[k] = tables.write_table(t, self.output_dir, f"{name}_{k}", self.fmt)
        return result.main

    def clean_datasets(self, spark: SparkSession, dataset: str | None = None) -> dict[str, DataFrame]:
        """Data sets of the configuration: the one asked for, else the one it names, else all."""
        inputs = self.tree.get("input", {})
        wanted = dataset or inputs.get("use_dataset")
        return {d["name"]: self.clean_files(spark, d["files"], d["name"]) for d in inputs.get("datasets", []) if not wanted or d["name"] == wanted}


def _standards(df: DataFrame, samples: DataFrame | None, id_col: str) -> DataFrame:
    return df if samples is None else clean.only_samples(df, samples, id_col)


class TableAligner:
    """Columns of a source table moved to a target's median and MAD."""

    def __init__(self, columns: list[str], id_col: str = clean.ID) -> None:
        self.columns, self.id_col = list(columns), id_col
        self.source: dict = {}
        self.target: dict = {}

    def fit(self, source: DataFrame, target: DataFrame, source_samples: DataFrame | None = None, target_samples: DataFrame | None = None) -> TableAligner:
        names = [n for n in self.columns if n in source.columns and n in target.columns]
        pick = lambda df, s: _standards(df, s, self.id_col).select(*[num(df, n).alias(n) for n in names])
        self.source, self.target = (stats.mad_parameters(pick(df, s), names) for df, s in ((source, source_samples), (target, target_samples)))
        return self

    def transform(self, df: DataFrame, passthrough: bool = False) -> DataFrame:
        if not self.source:
            raise RuntimeError("not fitted")
        return stats.align_columns(df, self.source, self.target, passthrough)

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "id_col": self.id_col, "source": self.source, "target": self.target})

    @staticmethod
    def from_json(text: str) -> TableAligner:
        d = json.loads(text)
        out = TableAligner(d["columns"], d["id_col"])
        out.source, out.target = d["source"], d["target"]
        return out


class EventAligner:
    """Event clouds of a channel moved from a source to a target by mixtures and optimal transport.

    Mixtures are fitted on all events of a side but those at the ends of the scale, by rounds on the cluster (see
    operators.mixtures), or on `max_samples` drawn by hash if asked. They start from fits on `start_samples` events,
    n_init of them, whose first means are spread over the gates' populations if there are gates. A stratified draw has
    `max_samples` events (a million by default). The second side starts from the first's mixture with `cascade`. With
    `folder` rounds are saved, and a fit that was broken off goes on. Transforming covers all events.
    """

    def __init__(self, channel: str, n_components: int = 64, covariance: str = "full", reg: float = 1e-6, max_iter: int = 100, n_init: int = 1, max_samples: int | None = None, start_samples: int = 20_000, tol: float = 1e-3, folder: str | None = None, gates: dict[str, list] | None = None, use_gates: bool = True, allocation: str = "equal", stratified: bool = False, least_per_gate: int = 50_000, balance: str = "sqrt", cascade: bool = True, method: str = "rand", preserve_rare: bool = True, rare_threshold: float | None = None, omega_threshold: float | None = None, cost: str = "wasserstein", columns: list[str] | None = None, seed: int = 0) -> None:
        self.columns = columns or K.EVENT_COLUMNS[channel]
        self.settings = {k: v for k, v in locals().items() if k not in ("self", "columns")}
        self.channel, self.method, self.preserve_rare, self.seed = channel, method, preserve_rare, seed
        self.rare = K.RARE_THRESHOLD.get(channel, 0.01) if rare_threshold is None else rare_threshold
        self.omega = K.OMEGA_THRESHOLD.get(channel, 0.05) if omega_threshold is None else omega_threshold
        self.axes = K.GATE_AXES.get(channel, tuple(self.columns[:2]))
        self.gates = (gates or K.GATES.get(channel)) if use_gates else None
        self.transport: gmm.Transport | None = None

    def _events(self, df: DataFrame) -> DataFrame:
        """The events that a side is fitted on, with their population as _label (null without gates)."""
        s = self.settings
        df = clean.saturation_filter(df.select(*[num(df, n).alias(n) for n in self.columns]).dropna(), self.columns)
        label = gate_last(c(self.axes[0]), c(self.axes[1]), self.gates) if self.gates else None
        if label is not None and s["stratified"]:
            df = sampling.stratified_sample(df, label, s["max_samples"] or 1_000_000, s["least_per_gate"], s["balance"], seed=self.seed)
        elif s["max_samples"]:
            df = sampling.exact_sample(df, s["max_samples"], seed=self.seed)
        return written(df.select("*", (label if label is not None else F.lit(None).cast("int")).alias("_label")), "events")

    def _fit_side(self, df: DataFrame, start: gmm.Mixture | None, name: str) -> gmm.Mixture:
        s, rows = self.settings, self._events(df)
        k, shape = s["n_components"], {"covariance": s["covariance"], "reg": s["reg"], "max_iter": s["max_iter"]}
        few = sampling.exact_sample(rows, s["start_samples"], self.columns, self.seed).toPandas()  # start_samples rows at most
        x, labels = few[self.columns].to_numpy(float), few["_label"].to_numpy()
        if start is not None:
            starts = [gmm.fit(x, k, start=start, seed=self.seed, **shape)]
        else:
            means = lambda seed: gmm.means_by_label(x, labels, k, s["allocation"], seed) if self.gates else None
            starts = [gmm.fit(x, k, means=means(self.seed + i), seed=self.seed + i, **shape) for i in range(s["n_init"])]
        return mixtures.fit(rows, self.columns, starts, s["covariance"], s["max_iter"], s["tol"], s["reg"], folder=f"{s['folder'].rstrip('/')}/{name}" if s["folder"] else None)

    def fit(self, source: DataFrame, target: DataFrame) -> EventAligner:
        first = self._fit_side(source, None, "source")
        second = self._fit_side(target, first if self.settings["cascade"] else None, "target")
        self.transport = gmm.transport_between(first, second, self.settings["cost"])
        return self

    def transform(self, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
        if self.transport is None:
            raise RuntimeError("not fitted")
        return transport.transport_events(df, self.columns, self.transport, self.method, self.omega, self.preserve_rare, self.rare, keys, self.seed)

    def validate(self, source: DataFrame, target: DataFrame, moved: DataFrame | None = None) -> dict:
        return transport.validate(source, target, moved if moved is not None else self.transform(source), self.columns, self.transport.target)

    def to_json(self) -> str:
        return json.dumps({"settings": self.settings, "columns": self.columns, "transport": self.transport.to_json() if self.transport else None})

    @staticmethod
    def from_json(text: str) -> EventAligner:
        d = json.loads(text)
        out = EventAligner(columns=d["columns"], **d["settings"])
        out.transport = gmm.Transport.from_json(d["transport"]) if d["transport"] else None
        return out


def fit_channels(sources: dict[str, DataFrame], targets: dict[str, DataFrame], fitted: dict[str, EventAligner] | None = None, **settings) -> dict[str, EventAligner]:
    """An aligner for each channel; those that are fitted already are kept."""
    return {ch: (fitted or {}).get(ch) or EventAligner(ch, **settings).fit(sources[ch], targets[ch]) for ch in sources}


class HistogramAligner:
    """Impedance histograms (RBC_RAW_*, PLT_RAW_*) moved from a source to a target.

    Three components for each side, begun at fixed places, fitted on the summed histogram's weighted bins (PLT on a logarithmic scale).
    """

    FIRST = {"RBC": [[1.0], [35.0], [80.0]], "PLT": [[4.5], [3.0], [2.5]]}

    def __init__(self, sample_size: int = 10_000, id_col: str = clean.ID, seed: int = 0, cost: str = "wasserstein") -> None:
        self.sample_size, self.id_col, self.seed, self.cost = sample_size, id_col, seed, cost
        self.transports: dict[str, gmm.Transport] = {}

    def fit(self, source: DataFrame, target: DataFrame, source_samples: DataFrame | None = None, target_samples: DataFrame | None = None) -> HistogramAligner:
        for prefix, means in self.FIRST.items():
            sides = []
            for df, s in ((source, source_samples), (target, target_samples)):
                counts = [r["count"] for r in transport.histogram_sum(_standards(df, s, self.id_col), prefix).orderBy("bin").collect()]
                x, w = transport.weighted_bins(np.array(counts), self.sample_size, prefix == "PLT")
                sides.append(gmm.fit(x, 3, sample_weight=w, means=means, max_iter=500, tol=1e-6))
            self.transports[prefix] = gmm.transport_between(*sides, self.cost)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.transports:
            raise RuntimeError("not fitted")
        for prefix, t in self.transports.items():
            df = transport.transport_histograms(df, prefix, t, self.sample_size, prefix == "PLT", [self.id_col], self.seed)
        return df

    def to_json(self) -> str:
        return json.dumps({"args": [self.sample_size, self.id_col, self.seed, self.cost], "transports": {k: t.to_json() for k, t in self.transports.items()}})

    @staticmethod
    def from_json(text: str) -> HistogramAligner:
        d = json.loads(text)
        out = HistogramAligner(*d["args"])
        out.transports = {k: gmm.Transport.from_json(t) for k, t in d["transports"].items()}
        return out


class CovariateCorrector:
    """Covariate effects taken off features, by group if asked, with additive models of penalised splines.

    reference_condition: Column predicates over covariates ({name: condition}), all of which hold for the rows whose mean is added back; else the
    mean of the fitted rows is. transforms: {feature: log | logit | none}; "auto" takes logit for names with PCT or % whose values
    are all in [0, 1], decided once when fitted.
    """

    def __init__(self, covariates: list[str], features: list[str] | None = None, group: str | None = None, terms: list[tuple] | None = None, n_splines: int | dict[str, int] = gam.DEFAULT_SPLINES, cyclic: tuple[str, ...] = (), lam: float = gam.LAMBDA, transforms: dict[str, str] | str = "none", centralise: float | None = None, reference_condition: dict[str, Column] | None = None, normalise_groups: bool = False, reference_group: str | None = None, least: int = 10) -> None:
        if terms:
            gam.check_terms(terms, covariates)
        self.covariates, self.features, self.group, self.terms = list(covariates), features, group, terms
        self.n_splines, self.cyclic, self.lam, self.transforms = n_splines, tuple(cyclic), lam, transforms
        self.centralise, self.reference_condition, self.least = centralise, reference_condition, least
        self.normalise, self.reference_group = normalise_groups, reference_group
        self.kinds: dict[str, str] = {}
        #: gam.FITS, the reference of each feature's models where a condition gives one, and (grp, offsets).
        self.fits: DataFrame | None = None
        self.references: list[float | None] | None = None
        self.offsets: DataFrame | None = None
        self.design: gam.Design | None = None

    def _kinds(self, df: DataFrame) -> dict[str, str]:
        if self.transforms == "auto":
            names = [n for n in self.features if "PCT" in n or "%" in n]
            if not names:
                return dict.fromkeys(self.features, "none")
            row = df.agg(*[f(num(df, n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("l", F.min), ("h", F.max))]).first()
            fits = {n for i, n in enumerate(names) if row[f"l{i}"] is not None and row[f"l{i}"] >= 0 and row[f"h{i}"] <= 1}
            return {n: "logit" if n in fits else "none" for n in self.features}
        return {n: self.transforms if isinstance(self.transforms, str) else self.transforms.get(n, "none") for n in self.features}

    def _forward(self, df: DataFrame) -> DataFrame:
        return df.select(*[forward(num(df, n), self.kinds[n]).alias(n) if n in self.kinds else c(n) for n in df.columns])

    def fit(self, df: DataFrame) -> CovariateCorrector:
        if self.features is None:
            skip = {*self.covariates, self.group}
            self.features = [n for n, k in df.dtypes if profile.is_numeric(k) and n not in skip]
        self.kinds = self._kinds(df)
        x = self._forward(df)
        self.design = gam.make_design(x, self.covariates, self.terms, self.n_splines, self.cyclic, self.lam)
        bands = self._bands(x) if self.centralise is not None else None
        self.fits = written(gam.solved(gam.grams(x, self.features, self.design, self.group, bands), self.design, self.least), "fits")
        if self.reference_condition is not None:
            from ..functions.columns import all_of

            row = x.agg(*[F.avg(F.when(all_of(list(self.reference_condition.values())), c(n))).alias(f"_{i}") for i, n in enumerate(self.features)]).first()
            self.references = list(row)
        self.offsets = None
        if self.normalise and self.group:
            found = stats.offsets_by_group(self._corrected(x).where(c(self.group).isNotNull()), self.group, self.features, self.reference_group)
            self.offsets = written(found.select(F.col("grp").cast("string").alias("grp"), "offsets"), "offsets")
        return self

    def _bands(self, x: DataFrame) -> dict:
        complete = x
        for n in self.covariates:
            complete = complete.where(num(complete, n).isNotNull())
        rows = stats.median_mad(complete, self.features, [self.group] if self.group else None).collect()
        return {(self.features.index(r["column"]), str(r[self.group]) if self.group else ""): (r["median"] - self.centralise * r["mad"], r["median"] + self.centralise * r["mad"]) for r in rows if r["median"] is not None}

    def _corrected(self, x: DataFrame) -> DataFrame:
        ref = F.col("mean") if self.references is None else F.get(F.array(*[F.lit(r).cast("double") for r in self.references]), F.col("feature"))
        fits = self.fits.select("grp", "feature", "coef", ref.alias("ref")).where("ref is not null")
        return gam.apply_corrections(x, self.features, self.design, fits, self.group, self.offsets)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.design is None:
            raise RuntimeError("not fitted")
        out = self._corrected(self._forward(df))
        return out.select(*[inverse(c(n), self.kinds[n]).alias(n) if n in self.features else c(n) for n in out.columns])

    def fit_of(self, feature: str, group: str | None = None) -> gam.Fit:
        """One model: a row of the fits."""
        row = self.fits.where((F.col("feature") == self.features.index(feature)) & (F.col("grp") == ("" if group is None else str(group)))).first()
        if row is None:
            raise KeyError((feature, group))
        return gam.Fit.of(row)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def partial_dependence(self, feature: str, covariate: str, group: str | None = None, n: int = 100) -> dict[str, np.ndarray]:
        """Grid, effect and 95 % interval of the covariate's own term (the first that is of it alone)."""
        fit, d = self.fit_of(feature, group), self.design
        k = next((i for i, t in enumerate(d.terms) if t[1:] == (covariate,) or list(t[1:]) == [covariate]), None)
        if k is None:
            raise ValueError(f"{covariate!r} has no term of its own")
        axis = d.axes[covariate]
        grid = np.array(axis.levels) if axis.kind == "f" else np.linspace(axis.low, axis.high, n)
        x = np.zeros((len(grid), len(d.covariates)))
        x[:, d.covariates.index(covariate)] = grid
        at = 1 + sum(d.sizes()[:k])
        part = slice(at, at + d.sizes()[k])
        b = d.term(k, x)
        effect = b @ fit.coef[part]
        half = 1.96 * np.sqrt(np.maximum(0, fit.sigma2 * np.einsum("ij,jk,ik->i", b, fit.inverse[part, part], b)))
        return {"grid": grid, "effect": effect, "low": effect - half, "high": effect + half}

    def to_json(self) -> str:
        """Everything but reference_condition, which only fitting needs. The text is as large as the models of all features and groups."""
        d = self.design
        state = {n: getattr(self, n) for n in ("covariates", "features", "group", "terms", "n_splines", "cyclic", "lam", "transforms", "centralise", "reference_group", "least")}
        rows = lambda t: [list(r) for r in t.collect()] if t is not None else None
        return json.dumps({"state": state, "normalise": self.normalise, "kinds": self.kinds, "fits": rows(self.fits), "references": self.references, "offsets": rows(self.offsets), "terms": [list(t) for t in d.terms], "axes": {k: vars(a) for k, a in d.axes.items()}})

    @staticmethod
    def from_json(text: str) -> CovariateCorrector:
        d = json.loads(text)
        s = d["state"]
        out = CovariateCorrector(**{**s, "terms": [tuple(t) for t in s["terms"]] if s["terms"] else None, "cyclic": tuple(s["cyclic"])}, normalise_groups=d["normalise"])
        out.kinds = d["kinds"]
        out.design = gam.Design(s["covariates"], [tuple(t) for t in d["terms"]], {k: gam.Axis(**a) for k, a in d["axes"].items()}, s["lam"])
        spark = SparkSession.active()
        out.fits = spark.createDataFrame([tuple(r) for r in d["fits"]], gam.FITS)
        out.references = d["references"]
        out.offsets = spark.createDataFrame([tuple(r) for r in d["offsets"]], "grp string, offsets array<double>") if d["offsets"] is not None else None
        return out


class DomainEncoder:
    """Domain-invariant codes: fitted on a bounded sample of rows by hash, applied to all."""

    def __init__(self, columns: list[str], tasks: list[str], domains: list[str], max_samples: int = 200_000, seed: int = 0, **settings) -> None:
        self.columns, self.tasks, self.domains, self.max_samples, self.seed, self.settings = columns, tasks, domains, max_samples, seed, settings
        self.model: encoder.Encoder | None = None
        self.levels: dict[str, list] = {}

    def fit(self, df: DataFrame, validation: DataFrame | None = None, max_epochs: int = 50, patience: int | None = None) -> DomainEncoder:
        labels = [*self.tasks, *self.domains]
        rows = lambda d: sampling.exact_sample(d.select(*[num(d, n).alias(n) for n in self.columns], *[c(n).cast("string").alias(f"_{n}") for n in labels]).dropna(), self.max_samples, seed=self.seed).toPandas()
        pdf = rows(df)
        self.levels = {n: sorted(pdf[f"_{n}"].unique()) for n in labels}
        code = lambda p, names: np.column_stack([p[f"_{n}"].map({v: i for i, v in enumerate(self.levels[n])}).fillna(0).astype(int) for n in names])
        self.model = encoder.Encoder(len(self.columns), num_tasks=tuple(len(self.levels[n]) for n in self.tasks), num_domains=tuple(len(self.levels[n]) for n in self.domains), random_state=self.seed, **self.settings)
        held = rows(validation) if validation is not None else None
        self.model.fit(pdf[self.columns].to_numpy(float), code(pdf, self.tasks), code(pdf, self.domains), (held[self.columns].to_numpy(float), code(held, self.tasks)) if held is not None else None, max_epochs, patience)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("not fitted")
        return encoder.apply(df, self.columns, self.model)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.model.to_bytes())
        with open(f"{path}.json", "w", encoding="utf-8") as f:
            json.dump({"columns": self.columns, "tasks": self.tasks, "domains": self.domains, "levels": self.levels, "seed": self.seed, "settings": self.settings}, f)

    @staticmethod
    def load(path: str) -> DomainEncoder:
        with open(f"{path}.json", encoding="utf-8") as f:
            d = json.load(f)
        out = DomainEncoder(d["columns"], d["tasks"], d["domains"], seed=d["seed"], **d["settings"])
        out.levels = d["levels"]
        with open(path, "rb") as f:
            out.model = encoder.Encoder.from_bytes(f.read())
        return out


def save_json(model, path: str) -> None:
    """A fitted aligner or corrector as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(model.to_json())


def load_json(kind: type, path: str):
    with open(path, encoding="utf-8") as f:
        return kind.from_json(f.read())
