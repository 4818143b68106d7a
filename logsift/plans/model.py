"""The fitted part of a run: labels for later lines, stored, loaded, and applied to streams.

A stored model is a set of small tables written by Spark into a folder of its own, and after them a
manifest with the next version number that names the folder, the tables and their row counts. The
manifest is what makes the version exist: it is written under another name and renamed, which fails
if a concurrent save took the number, so a save that stops early leaves nothing that can be loaded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from logsift.functions.fnv import DEFAULT_INIT
from logsift.operators import anomaly as labelling
from logsift.operators.features import KEY_COLUMNS, hash_encode, select_features
from logsift.operators.scaling import Scaler
from logsift.operators.svd import TruncatedSvd, srss
from logsift.plans.formats import parse_format, widen
from logsift.scratch import file_system

CARRIED = "status_class"  # status of the line, kept beside the features for orientation
LINE = "_line"  # the line itself, so that the reduced log is a filter and no join
MALFORMED, OVERFLOW = "malformed", "overflow"  # what is told of later lines
BESIDE = (*KEY_COLUMNS, CARRIED, LINE, MALFORMED, OVERFLOW)
# Changes when stored tables mean something else.
LAYOUT = 1
TABLES = {
    "options": "name string, value string",
    "widths": "array string, width int",
    "steps": "step int, kind string, split int, maximum int",
    "columns": "step int, place int, name string, mean double, deviation double",
    "components": "step int, component int, singular_value double, values array<double>",
    "centroids": "cluster int, values array<double>",
}


@dataclass(frozen=True)
class Step:
    """One fitted stage: ``scale``, ``svd``, ``srss`` (two of its options) or a ``custom`` function."""

    kind: str
    columns: list[str] = field(default_factory=list)
    scaler: Scaler | None = None
    svd: TruncatedSvd | None = None
    split: int | None = None
    maximum: int | None = None
    function: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, table: DataFrame) -> DataFrame:
        if self.kind == "custom":
            return self.function(table)
        if self.kind == "scale":
            return self.scaler.transform(table) if self.scaler else table
        reduced = self.svd.transform(table)
        if self.kind == "svd":
            return reduced
        return srss(reduced, self.svd.reduced_columns, self.split, self.maximum)


def key_columns(table: DataFrame) -> list[str]:
    return [c for c in (*KEY_COLUMNS, "sample") if c in table.columns]


def encode(raw: DataFrame, log_format: str, widths: dict[str, int], init: int, engine: str) -> DataFrame:
    """Parsed rows as numeric features; status and what stands beside the features are kept."""
    chosen = select_features(widen(raw, log_format, widths), log_format)
    if "status" in chosen.columns:
        chosen = chosen.withColumn(CARRIED, F.col("status"))
    names = [c for c in chosen.columns if c not in BESIDE]
    return hash_encode(chosen, names, init, engine)


def label(matrix: DataFrame, columns: list[str], centroids, anomaly: str) -> DataFrame:
    if anomaly == "euclidean":
        return labelling.classify_euclidean(labelling.euclidean_to_centroids(matrix, columns, centroids))
    if anomaly == "cosine":
        return labelling.classify_cosine(labelling.cosine_to_centroids(matrix, columns, centroids))
    raise ValueError(f"anomaly must be 'euclidean' or 'cosine', got {anomaly!r}")


@dataclass(frozen=True)
class LogModel:
    """Widths, scaling, components, centroids and orientation of a run."""

    log_format: str
    anomaly: str
    widths: dict[str, int]
    steps: list[Step]
    columns: list[str]
    centroids: list[list[float]]
    swap: bool = False
    mode: str = "PERMISSIVE"
    hash_init: int = DEFAULT_INIT
    hash_engine: str = "arrow"

    def finish(self, matrix: DataFrame) -> DataFrame:
        """The output matrix with distances and oriented labels."""
        marked = label(matrix, self.columns, self.centroids, self.anomaly)
        return marked.withColumn("label", F.lit(1) - F.col("label")) if self.swap else marked

    def score(self, lines: DataFrame, with_line: bool = False) -> DataFrame:
        """Labels of new lines, batch or stream, by a projection without shuffle.

        ``malformed`` lines have label 1 and no distances; ``overflow`` tells of lines with more
        parts than any line of the run, whose last part holds the rest. ``with_line`` adds ``value``.
        """
        if with_line:
            lines = lines.withColumn(LINE, F.col("value"))
        parsed = parse_format(lines, self.log_format, self.mode)
        bad = F.col("_corrupt").isNotNull() if "_corrupt" in parsed.columns else F.lit(False)
        long = [F.coalesce(F.size(a) > n, F.lit(False)) for a, n in self.widths.items()]
        told = {MALFORMED: bad, OVERFLOW: reduce(or_, long, F.lit(False))}
        matrix = encode(parsed.withColumns(told), self.log_format, self.widths, self.hash_init, self.hash_engine)
        for step in self.steps:
            matrix = step.apply(matrix)
        marked = self.finish(matrix)
        cells = [F.when(~F.col(MALFORMED), F.col(c)).alias(c) for c in ("d0", "d1", "s0", "s1") if c in marked.columns]
        labels = F.when(F.col(MALFORMED), 1).otherwise(F.col("label")).alias("label")
        line = [F.col(LINE).alias("value")] if with_line else []
        return marked.select(*key_columns(marked), *line, *cells, labels, MALFORMED, OVERFLOW)

    def _rows(self) -> dict[str, list[tuple]]:
        options = {
            "log_format": self.log_format, "anomaly": self.anomaly, "swap": self.swap, "mode": self.mode,
            "hash_init": self.hash_init, "hash_engine": self.hash_engine,
        }
        rows: dict[str, list[tuple]] = {name: [] for name in TABLES}
        rows["options"] = [(k, json.dumps(v)) for k, v in options.items()]
        rows["widths"] = list(self.widths.items())
        for i, step in enumerate(self.steps):
            if step.kind == "custom":
                raise ValueError("a run with a function of its own as a stage cannot be stored")
            rows["steps"].append((i, step.kind, step.split, step.maximum))
            scaler = step.svd.scaler if step.svd else step.scaler
            for j, name in enumerate(step.columns):
                fitted = (scaler.means[j], scaler.deviations[j]) if scaler else (None, None)
                rows["columns"].append((i, j, name, *fitted))
            if step.svd:
                pairs = zip(step.svd.singular_values, step.svd.components, strict=True)
                rows["components"] += [(i, j, s, list(c)) for j, (s, c) in enumerate(pairs)]
        rows["columns"] += [(len(self.steps), j, name, None, None) for j, name in enumerate(self.columns)]
        rows["centroids"] = [(i, list(c)) for i, c in enumerate(self.centroids)]
        return rows

    def save(self, spark: SparkSession, path: str) -> int:
        """Store as the next version under ``path`` and return its number."""
        rows, folder = self._rows(), f"tables-{uuid.uuid4().hex}"
        for name, schema in TABLES.items():
            spark.createDataFrame(rows[name], schema).coalesce(1).write.parquet(f"{path}/{folder}/{name}")
        manifest = {"layout": LAYOUT, "folder": folder, "rows": {name: len(r) for name, r in rows.items()}}
        return _commit(spark, path, json.dumps(manifest))


def _commit(spark: SparkSession, path: str, text: str) -> int:
    """Put ``text`` under the next free version number, whole or not at all."""
    base = f"{path}/_versions"
    fs, jvm_path = file_system(spark, base)
    fs.mkdirs(jvm_path(base))
    hidden = jvm_path(f"{base}/.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    version = max(model_versions(spark, path), default=0) + 1
    while True:
        target = jvm_path(f"{base}/{version:08d}.json")
        if not fs.exists(target) and fs.rename(hidden, target):
            return version
        version += 1


def model_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored versions, ascending."""
    base = f"{path}/_versions"
    fs, jvm_path = file_system(spark, base)
    if not fs.exists(jvm_path(base)):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(jvm_path(base))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def load_model(spark: SparkSession, path: str, version: int | None = None) -> LogModel:
    """The stored model of that version, by default the last one."""
    versions = model_versions(spark, path)
    if not versions or version not in (None, *versions):
        raise FileNotFoundError(f"no model {'' if version is None else f'version {version} '}under {path}")
    text = spark.read.text(f"{path}/_versions/{version or versions[-1]:08d}.json", wholetext=True).head()[0]
    manifest = json.loads(text)
    if manifest["layout"] != LAYOUT:
        raise ValueError(f"model layout {manifest['layout']} is not {LAYOUT}")
    rows: dict[str, list[Row]] = {}
    for name, schema in TABLES.items():  # tables of a few rows
        rows[name] = spark.read.schema(schema).parquet(f"{path}/{manifest['folder']}/{name}").collect()
        if len(rows[name]) != manifest["rows"][name]:
            raise ValueError(f"table {name} has {len(rows[name])} rows, not {manifest['rows'][name]}")
    options = {r.name: json.loads(r.value) for r in rows["options"]}
    of_step: dict[int, list[Row]] = {}
    for r in sorted(rows["columns"], key=lambda r: (r.step, r.place)):
        of_step.setdefault(r.step, []).append(r)
    steps = [_step(r, of_step[r.step], rows["components"]) for r in sorted(rows["steps"], key=lambda r: r.step)]
    return LogModel(
        widths={r.array: r.width for r in rows["widths"]},
        steps=steps,
        columns=[r.name for r in of_step[len(steps)]],
        centroids=[list(r["values"]) for r in sorted(rows["centroids"], key=lambda r: r.cluster)],
        **options,
    )


def _step(row: Row, columns: list[Row], components: list[Row]) -> Step:
    names = [c.name for c in columns]
    scaler = None
    if columns[0].mean is not None:
        scaler = Scaler(names, [c.mean for c in columns], [c.deviation for c in columns], 0)
    if row.kind == "scale":
        return Step("scale", names, scaler)
    mine = sorted((c for c in components if c.step == row.step), key=lambda c: c.component)
    svd = TruncatedSvd(names, scaler, [c.singular_value for c in mine], [list(c["values"]) for c in mine])
    return Step(row.kind, names, svd=svd, split=row.split, maximum=row.maximum)
