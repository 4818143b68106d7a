"""Parse, encode, reduce, cluster, label: one run over a log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.fnv import DEFAULT_INIT
from logsift.operators import anomaly as labelling
from logsift.operators.density import cluster_centroids, dbscan, optics
from logsift.operators.kmeans import kmeans
from logsift.operators.points import append_centroids, plot_points
from logsift.operators.profile import profile
from logsift.operators.svd import (
    centroid_distance,
    reconstruction_anomaly_score,
    tsvd,
    variance_ratios,
)
from logsift.plans.formats import TOKEN_ARRAYS, imapd_count_rows, parse_format, widen
from logsift.plans.model import BESIDE, CARRIED, LINE, LogModel, Step, encode, key_columns
from logsift.scratch import materialize
from logsift.sources.results import save_results

SVD_OPTIONS = {
    "tsvd": {"n_components"},
    "tsvd_srss": {"maximum", "split"},
    "tsvd_distance": set(),
    "tsvd_score": {"score_components"},
}


@dataclass
class Stage:
    """What a stage hands on: its output matrix, named tables, centroids, and what it fitted."""

    output: DataFrame
    columns: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    centroids: DataFrame | None = None
    fitted: Step | None = None


def _svd_stage(table: DataFrame, columns: list[str], kind: str, **options) -> Stage:
    spark = table.sparkSession
    unknown = set(options) - SVD_OPTIONS[kind] - {"normalize"}
    if unknown:
        raise ValueError(f"stage {kind!r} has no options {sorted(unknown)}")
    normalize = options.get("normalize", True)
    components = {
        "tsvd": options.get("n_components", 2),
        "tsvd_srss": options.get("maximum", 3),
        "tsvd_distance": len(columns),
        "tsvd_score": len(columns),
    }[kind]
    svd = tsvd(table, columns, components, normalize)
    us = svd.transform(table)
    tables = {"US": us, **svd.tables(spark), "variance_ratios": variance_ratios(table, svd)}
    if kind == "tsvd_srss":
        fitted = Step(
            "srss", list(columns), svd=svd, split=options.get("split", 1), maximum=components
        )
        reduced = fitted.apply(table)
        return Stage(reduced, ["r0", "r1"], {**tables, "srss_reduction": reduced}, None, fitted)
    if kind == "tsvd_distance":
        tables["distance"] = centroid_distance(us, svd.reduced_columns).select(
            *key_columns(us), "distance"
        )
    if kind == "tsvd_score":
        scored = reconstruction_anomaly_score(table, columns, options.get("score_components", 2))
        tables["anomaly_score"] = scored.select(*key_columns(us), "score")
    return Stage(us, svd.reduced_columns, tables, None, Step("svd", list(columns), svd=svd))


def _kmeans_stage(table: DataFrame, columns: list[str], **options) -> Stage:
    fitted = kmeans(table, columns, **options)
    clustered = fitted.transform(table)
    centroids = fitted.centroid_table(table.sparkSession)
    tables = {
        "KMeans_Results": clustered.select(*key_columns(clustered), "cluster"),
        "KMeans_Centroids": centroids,
    }
    step = Step("scale", list(columns), fitted.scaler)
    return Stage(clustered.drop("cluster"), columns, tables, centroids, step)


def _density_stage(table: DataFrame, columns: list[str], kind: str, **options) -> Stage:
    run = dbscan if kind == "dbscan" else optics
    labelled = materialize(run(table.drop(LINE), columns, **options), kind)
    centroids = cluster_centroids(labelled, columns)
    name = kind.upper()
    tables = {
        f"{name}_Results": labelled.select(*key_columns(labelled), "label", "is_core"),
        f"{name}_Centroids": centroids,
    }
    if "sample" in labelled.columns:
        tables[f"{name}_Samples"] = labelled.select("sample", *columns, "weight")
    return Stage(labelled.drop("label", "is_core"), columns, tables, centroids)


def run_stage(table: DataFrame, columns: list[str], stage: str | Callable, options: dict) -> Stage:
    """A named stage, or any function of a DataFrame that keeps ``line_no``."""
    if callable(stage):
        output = stage(table)
        kept = [c for c in output.columns if c not in BESIDE]
        return Stage(output, kept, {"custom": output}, None, Step("custom", function=stage))
    if stage in ("tsvd", "tsvd_srss", "tsvd_distance", "tsvd_score"):
        return _svd_stage(table, columns, stage, **options)
    if stage == "kmeans":
        return _kmeans_stage(table, columns, **options)
    if stage in ("dbscan", "optics"):
        return _density_stage(table, columns, stage, **options)
    raise ValueError(f"unknown stage {stage!r}")


@dataclass
class LogRun:
    """Tables of one run; ``output`` is the matrix that plots and labels use."""

    tables: dict[str, DataFrame]
    output: DataFrame
    columns: list[str]
    centroids: DataFrame | None
    options: dict[str, object] = field(default_factory=dict)
    model: LogModel | None = None

    def points(self, dims: int = 2, labels: DataFrame | None = None, how: str = "left") -> DataFrame:
        """Point table of the output matrix, with the centroids if there are any."""
        points = plot_points(self.output, self.columns, dims, labels, how)
        if self.centroids is None:
            return points
        return append_centroids(points, self.centroids, self.columns)

    def save(self, path: str, file_format: str = "csv", mode: str = "overwrite") -> None:
        """Write all tables and the options of the run."""
        save_results(self.tables, path, self.options, file_format, mode)

    def fitted(self) -> LogModel:
        """What labels later lines; an error if the run cannot."""
        if self.model is None:
            raise ValueError("the run has no label step that can be applied to new lines")
        return self.model

    def score(self, lines: DataFrame) -> DataFrame:
        """Label new lines with the fitted scaling, components and centroids.

        ``malformed`` lines have label 1 and no distances; ``overflow`` tells of lines with more
        parts than any line of the run, whose last part holds the rest.
        """
        return self.fitted().score(lines)

    def save_model(self, path: str) -> int:
        """Store what was fitted as the next version under ``path``; see ``load_model``."""
        return self.fitted().save(self.output.sparkSession, path)


@dataclass
class LogPipeline:
    """Parser, first stage, optional second stage, optional label step.

    ``anomaly`` is ``euclidean`` or ``cosine`` and needs a stage with exactly two centroids;
    ``orient`` swaps the labels if most failed requests carry label 1 (needs a format with
    a status). With mode PERMISSIVE lines that do not parse are in the table ``corrupt_lines``
    and, unless ``corrupt_in_reduced`` is false, in the reduced log; DROPMALFORMED leaves them
    out. ``profiles`` adds the column profiles before and after encoding.
    """

    log_format: str
    reduce: str | Callable = "tsvd"
    then: str | Callable | None = None
    anomaly: str | None = None
    orient: bool = True
    mode: str = "PERMISSIVE"
    corrupt_in_reduced: bool = True
    profiles: bool = False
    reduce_options: dict = field(default_factory=dict)
    then_options: dict = field(default_factory=dict)
    hash_init: int = DEFAULT_INIT
    hash_engine: str = "arrow"

    def _options(self) -> dict[str, object]:
        named = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: getattr(v, "__name__", v) for k, v in named.items()}

    def _parsed(self, lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows that parsed, and the lines that did not (or None), from one parse."""
        if self.log_format == "imapd_counts":
            events = materialize(parse_format(lines, "imapd_auth", self.mode), "events")
            good = events.where("_corrupt is null") if "_corrupt" in events.columns else events
            counts = materialize(imapd_count_rows(good), "raw")
            bad = events if "_corrupt" in events.columns else None
        else:
            marked = lines.withColumn(LINE, F.col("value"))
            events = counts = materialize(parse_format(marked, self.log_format, self.mode), "raw")
            bad = events if "_corrupt" in events.columns else None
            if bad is not None:
                counts = events.where("_corrupt is null").drop("_corrupt")
        if bad is None:
            return counts, None
        keys = [c for c in lines.columns if c != "value"]
        return counts, bad.where("_corrupt is not null").select(*keys, F.col("_corrupt").alias("value"))

    def run(self, lines: DataFrame, labels: DataFrame | None = None) -> LogRun:
        """All tables of the run. The raw table and the features are written once and reread."""
        raw, corrupt = self._parsed(lines)
        widths = _widths(raw)
        encoded = encode(raw, self.log_format, widths, self.hash_init, self.hash_engine)
        features = materialize(encoded, "features")
        columns = [c for c in features.columns if c not in BESIDE]
        tables = {
            "raw_data": widen(raw.drop(LINE), self.log_format, widths),
            "ml_ready_data": features.drop(CARRIED, LINE),
        }
        if corrupt is not None:
            tables["corrupt_lines"] = corrupt
        if self.profiles:
            tables["raw_profile"] = profile(tables["raw_data"])
            tables["ml_ready_profile"] = profile(tables["ml_ready_data"])
        if labels is not None:
            tables["label_data"] = labels

        first = run_stage(features, columns, self.reduce, self.reduce_options)
        tables.update({k: t.drop(LINE) for k, t in first.tables.items()})
        last = first
        if self.then is not None:
            last = run_stage(first.output, first.columns, self.then, self.then_options)
            tables.update({k: t.drop(LINE) for k, t in last.tables.items()})
        run = LogRun(tables, last.output.drop(LINE), last.columns, last.centroids, self._options())
        if self.anomaly is None:
            return run
        if last.centroids is None:
            raise ValueError("the label step needs a stage with centroids")

        centers = labelling.two_centroids(last.centroids, last.columns)
        steps = [first.fitted] if self.then is None else [first.fitted, last.fitted]
        settings = (self.mode, self.hash_init, self.hash_engine)
        model = LogModel(
            self.log_format, self.anomaly, widths, steps, list(last.columns), centers, False, *settings
        )
        # the swap is decided once on this log and then kept for later lines
        if self.orient and CARRIED in last.output.columns:
            swap = labelling.labels_reversed(model.finish(last.output), CARRIED).head()[0]
            model = replace(model, swap=swap)
        done = model.finish(last.output)
        distances = [c for c in ("d0", "d1", "s0", "s1") if c in done.columns]
        tables["anomaly_reduction_results"] = done.select(*key_columns(done), *distances)
        anomalies = done.select(*key_columns(done), "label")
        tables["identified_anomalies"] = anomalies
        if self.log_format != "imapd_counts" and "line_no" in done.columns and "sample" not in done.columns:
            if LINE in done.columns:
                cells = [F.col(LINE).alias("value") if c == "value" else c for c in lines.columns]
                reduced = done.where("label = 1").select(*cells)
            else:
                reduced = labelling.reduce_log(lines, anomalies)
            if corrupt is not None and self.corrupt_in_reduced:
                reduced = reduced.unionByName(corrupt.select(*lines.columns))
            tables["reduced_log"] = reduced

        if all(step is not None for step in steps):
            run.model = model
        return run


def _widths(raw: DataFrame) -> dict[str, int]:
    """Longest row of each token array, all in one aggregate."""
    arrays = [
        f.name for f in raw.schema.fields if f.name in TOKEN_ARRAYS and f.dataType.typeName() == "array"
    ]
    if not arrays:
        return {}
    row = raw.agg(*[F.max(F.size(a)).alias(a) for a in arrays]).head()
    return {a: row[a] or 0 for a in arrays}
