"""Queries and SQL for features, reduction, clustering, labels and points."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from logsift.checks.parsing import ACCESS_CTE, AUTH_CTE
from logsift.checks.views import DIMS, line_stream, lines, matrix, rounded, table, view_sql
from logsift.functions.fnv import fnv1_64_unit
from logsift.operators.access_log import parse_access
from logsift.operators.anomaly import (
    classify_cosine,
    classify_euclidean,
    cosine_to_centroids,
    euclidean_to_centroids,
    labels_reversed,
    orient_labels,
    reduce_log,
    two_centroids,
)
from logsift.operators.density import cluster_centroids, cluster_sizes, dbscan, optics
from logsift.operators.features import hash_encode, select_features
from logsift.operators.kmeans import kmeans
from logsift.operators.near_duplicates import combine_near_duplicates
from logsift.operators.points import align_by_line, append_centroids, plot_points, thin_points
from logsift.operators.profile import profile
from logsift.operators.scaling import fit_scaler, standardize
from logsift.operators.svd import (
    centroid_distance,
    reconstruct,
    reconstruction_anomaly_score,
    reconstruction_error,
    srss,
    tsvd,
    tsvd_centroid_distance,
    tsvd_srss,
    variance_ratios,
)
from logsift.plans.model import LogModel, Step, load_model
from logsift.plans.pipeline import LogPipeline
from logsift.scratch import materialize, scratch_path
from logsift.streaming.scoring import read_scored, score_stream

E = [f"e{i}" for i in range(DIMS)]
PLANE = ["e0", "e1"]
EPS, MIN_SAMPLES = 0.2, 8
RTOL = 0.05
ACCESS_FEATURES = ["remote_host", "request", "bytes_sent", "status", "referer", "user_agent"]


def _round_all(df, columns, *others):
    return df.select(*others, *[rounded(c) for c in columns])


# ---------------------------------------------------------------- features


def page_hashes_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.round(fnv1_64_unit("url"), 6).alias("url_hash"))


def page_hashes_native_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.round(fnv1_64_unit("url", engine="native"), 6).alias("url_hash"))


def _access_features(spark, sf_dir):
    parsed = parse_access(lines(spark, sf_dir, "access_lines"), "DROPMALFORMED")
    return hash_encode(select_features(parsed, "access"))


def hash_encode_query(spark, sf_dir):
    return _round_all(_access_features(spark, sf_dir), ACCESS_FEATURES, "line_no")


def standardize_query(spark, sf_dir):
    return _round_all(standardize(matrix(spark, sf_dir), E), E, "line_no")


def standardize_access_query(spark, sf_dir):
    columns = ["bytes_sent", "status"]
    return _round_all(standardize(_access_features(spark, sf_dir), columns), columns, "line_no")


def profile_query(spark, sf_dir):
    parsed = parse_access(lines(spark, sf_dir, "access_lines"), "DROPMALFORMED")
    found = profile(select_features(parsed, "access"))
    numbers = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return _round_all(found, numbers, "column", "count", "unique", "top", "freq")


# ---------------------------------------------------------------- reduction


def tsvd_query(spark, sf_dir):
    source = matrix(spark, sf_dir).select("line_no", *PLANE)
    return _round_all(tsvd(source, PLANE, 2).transform(source), ["c0", "c1"], "line_no")


def tsvd_unscaled_query(spark, sf_dir):
    source = matrix(spark, sf_dir).select("line_no", *PLANE)
    return _round_all(tsvd(source, PLANE, 2, normalize=False).transform(source), ["c0", "c1"], "line_no")


def tsvd_rebuilt_query(spark, sf_dir):
    """With all components US x VT is the standardised matrix again."""
    source = matrix(spark, sf_dir).select("line_no", *E)
    return _round_all(reconstruct(source, tsvd(source, E, DIMS)), E, "line_no")


def tsvd_access_query(spark, sf_dir):
    """The features are read three times (scaling, X'X, projection), so they are written once."""
    source = materialize(_access_features(spark, sf_dir), "features")
    return tsvd(source, ACCESS_FEATURES, 2).transform(source)


def svd_tables_query(spark, sf_dir):
    source = matrix(spark, sf_dir).select("line_no", *PLANE)
    svd = tsvd(source, PLANE, 2, normalize=False)
    parts = svd.tables(spark)
    joined = parts["S"].join(parts["VT"], "component").join(parts["T"], "component")
    return _round_all(joined, ["singular_value", *PLANE, "t"], "component")


def variance_ratios_query(spark, sf_dir):
    source = matrix(spark, sf_dir)
    found = variance_ratios(source, tsvd(source, PLANE, 2, normalize=False))
    return _round_all(found, ["variance_ratio"], "component")


def reconstruction_error_query(spark, sf_dir):
    source = matrix(spark, sf_dir)
    return _round_all(reconstruction_error(source, tsvd(source, PLANE, 1, normalize=False)), ["error"])


def srss_query(spark, sf_dir):
    return _round_all(srss(matrix(spark, sf_dir), E, 1, 3), ["r0", "r1"], "line_no")


def tsvd_srss_query(spark, sf_dir):
    _, reduced = tsvd_srss(matrix(spark, sf_dir).select("line_no", *PLANE), PLANE, 1, 2, normalize=False)
    return _round_all(reduced, ["r0", "r1"], "line_no")


def centroid_distance_query(spark, sf_dir):
    return _round_all(centroid_distance(matrix(spark, sf_dir), E), ["distance"], "line_no")


def tsvd_centroid_distance_query(spark, sf_dir):
    """A full decomposition turns the space, so distances to the mean stay what they were."""
    _, found = tsvd_centroid_distance(matrix(spark, sf_dir).select("line_no", *E), E)
    return _round_all(found, ["distance"], "line_no")


def anomaly_score_query(spark, sf_dir):
    source = matrix(spark, sf_dir).select("line_no", *PLANE)
    return _round_all(reconstruction_anomaly_score(source, PLANE, 1), ["score"], "line_no")


# ---------------------------------------------------------------- clustering


def kmeans_query(spark, sf_dir):
    source = matrix(spark, sf_dir).select("line_no", *E)
    return kmeans(source, E, 2).transform(source)


def kmeans_labels_query(spark, sf_dir):
    """Label rows have at most four different points, so four clusters are these points."""
    source = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("line_no"), "quality", "toxic")
    fitted = kmeans(source, ["quality", "toxic"], 4, normalize=False)
    return fitted.transform(source).select("line_no", "cluster")


def _plane(spark, sf_dir):
    return matrix(spark, sf_dir).select("line_no", *PLANE)


def dbscan_query(spark, sf_dir):
    found = dbscan(_plane(spark, sf_dir), PLANE, EPS, MIN_SAMPLES)
    return found.select("line_no", "label", "is_core")


def optics_query(spark, sf_dir):
    found = optics(_plane(spark, sf_dir), PLANE, EPS, MIN_SAMPLES)
    return found.select("line_no", "label", "is_core")


def dbscan_mail_query(spark, sf_dir):
    """Mail log, parsed and hashed, clustered in all its columns."""
    run = LogPipeline("mail", "dbscan").run(lines(spark, sf_dir, "mail_lines"))
    return run.tables["DBSCAN_Results"]


def combine_query(spark, sf_dir):
    source = _coarse(spark, sf_dir)
    found = combine_near_duplicates(source, PLANE, RTOL)
    return _round_all(found, PLANE, "sample", "weight")


def _coarse(spark, sf_dir):
    source = matrix(spark, sf_dir)
    return source.select("line_no", *[F.round(c, 1).alias(c) for c in PLANE])


def dbscan_combined_query(spark, sf_dir):
    found = dbscan(_coarse(spark, sf_dir), PLANE, 0.5, MIN_SAMPLES, rtol=RTOL)
    return found.select("sample", "weight", "label", "is_core")


def _given_clusters(spark, sf_dir):
    """Labels of the embeddings as clusters, label 9 standing for noise."""
    source = matrix(spark, sf_dir)
    return source.withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))


def cluster_centroids_query(spark, sf_dir):
    return _round_all(cluster_centroids(_given_clusters(spark, sf_dir), E), E, "cluster")


def cluster_sizes_query(spark, sf_dir):
    return cluster_sizes(_given_clusters(spark, sf_dir))


# ---------------------------------------------------------------- labels and points


def _centroids(spark, sf_dir):
    return cluster_centroids(matrix(spark, sf_dir).where("label < 2"), E)


def _euclidean(spark, sf_dir):
    return euclidean_to_centroids(matrix(spark, sf_dir).drop("label"), E, _centroids(spark, sf_dir))


def _cosine(spark, sf_dir):
    return cosine_to_centroids(matrix(spark, sf_dir).drop("label"), E, _centroids(spark, sf_dir))


def euclidean_query(spark, sf_dir):
    return _round_all(_euclidean(spark, sf_dir), ["d0", "d1"], "line_no")


def cosine_query(spark, sf_dir):
    return _round_all(_cosine(spark, sf_dir), ["s0", "s1"], "line_no")


def classify_euclidean_query(spark, sf_dir):
    return classify_euclidean(_euclidean(spark, sf_dir)).select("line_no", "label")


def classify_cosine_query(spark, sf_dir):
    return classify_cosine(_cosine(spark, sf_dir)).select("line_no", "label")


def orient_euclidean_query(spark, sf_dir):
    return orient_labels(classify_euclidean(_euclidean(spark, sf_dir))).select("line_no", "label")


def orient_cosine_query(spark, sf_dir):
    return orient_labels(classify_cosine(_cosine(spark, sf_dir))).select("line_no", "label")


def reduce_log_query(spark, sf_dir):
    """Lines of the access log whose status class is not success."""
    log = lines(spark, sf_dir, "access_lines")
    parsed = parse_access(log, "DROPMALFORMED")
    labels = parsed.select("line_no", F.when(F.col("status") == 0.2, 0).otherwise(1).alias("label"))
    return reduce_log(log, labels)


def _line_labels(spark, sf_dir):
    """Labels of the label table, matched by number."""
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.col("doc_id").alias("line_no"), F.col("toxic").alias("label"))


def plot_points_query(spark, sf_dir):
    points = plot_points(matrix(spark, sf_dir), E, 2, _line_labels(spark, sf_dir))
    return _round_all(points, ["x", "y"], "line_no", "log_line", "label")


def plot_points_3d_query(spark, sf_dir):
    points = plot_points(matrix(spark, sf_dir), E, 3, _line_labels(spark, sf_dir), "inner")
    return _round_all(points, ["x", "y", "z"], "line_no", "log_line", "label")


def thin_points_query(spark, sf_dir):
    """Two points of each of 8 x 8 x 8 boxes and label, with the rows they stand for."""
    points = plot_points(matrix(spark, sf_dir), E, 3, _line_labels(spark, sf_dir))
    return _round_all(thin_points(points, 2, 8), ["x", "y", "z", "weight"], "line_no", "log_line", "label")


def append_centroids_query(spark, sf_dir):
    points = append_centroids(plot_points(matrix(spark, sf_dir), E, 2), _centroids(spark, sf_dir), E)
    return _round_all(points, ["x", "y"], "line_no", "log_line", "label")


def align_query(spark, sf_dir):
    left = matrix(spark, sf_dir).select("line_no", "e0")
    return _round_all(align_by_line(left, _line_labels(spark, sf_dir)), ["e0"], "line_no", "label")


# ---------------------------------------------------------------- pipeline


def pipeline_run(spark, sf_dir):
    return LogPipeline("access_url", "tsvd", "kmeans", "euclidean").run(
        lines(spark, sf_dir, "access_lines")
    )


def pipeline_query(spark, sf_dir):
    """Access log to anomaly labels: parse, hash, SVD, k-means, distances, orientation."""
    return pipeline_run(spark, sf_dir).tables["identified_anomalies"]


def reduced_log_query(spark, sf_dir):
    return pipeline_run(spark, sf_dir).tables["reduced_log"]


def distance_labels_query(spark, sf_dir):
    """Access log to labels by two given centroids: the mean failed and mean good request."""
    columns = ["bytes_sent", "status", "referer"]
    source = standardize(
        _access_features(spark, sf_dir).withColumn("class", F.col("status")), columns
    )
    group = F.when(F.col("class") == 0.2, 1).otherwise(0)
    centroids = cluster_centroids(source.withColumn("label", group), columns)
    labelled = classify_euclidean(euclidean_to_centroids(source, columns, centroids))
    return orient_labels(labelled, "class").select("line_no", "label")


def _distance_model(spark, sf_dir):
    """The model of ``distance_labels_query``."""
    columns = ["bytes_sent", "status", "referer"]
    features = _access_features(spark, sf_dir).withColumn("class", F.col("status"))
    scaler = fit_scaler(features, columns)
    source = materialize(scaler.transform(features), "scaled")
    group = F.when(F.col("class") == 0.2, 1).otherwise(0)
    centroids = two_centroids(cluster_centroids(source.withColumn("label", group), columns), columns)
    model = LogModel("access", "euclidean", {}, [Step("scale", columns, scaler)], columns, centroids)
    return replace(model, swap=labels_reversed(model.finish(source), "class").head()[0])


def stored_model_query(spark, sf_dir):
    """Labels by a model that was stored and loaded."""
    path = scratch_path(spark, "model")
    _distance_model(spark, sf_dir).save(spark, path)
    return load_model(spark, path).score(lines(spark, sf_dir, "access_lines")).select("line_no", "label")


def score_stream_query(spark, sf_dir):
    """The same labels over a stream of the files of the table."""
    path, model = scratch_path(spark, "scored"), _distance_model(spark, sf_dir)
    score_stream(model, line_stream(spark, sf_dir, "access_lines"), path, availableNow=True).awaitTermination()
    return read_scored(spark, path, model).select("line_no", "label")


# Standardised whole vectors are about 8 to 12 apart.
WHOLE_EPS = 9.6


def dbscan_whole_query(spark, sf_dir):
    """All 64 values of the vectors."""
    found = dbscan(matrix(spark, sf_dir).select("line_no", *E), E, WHOLE_EPS, MIN_SAMPLES)
    return found.select("line_no", "label", "is_core")


def optics_whole_query(spark, sf_dir):
    found = optics(matrix(spark, sf_dir).select("line_no", *E), E, WHOLE_EPS, MIN_SAMPLES)
    return found.select("line_no", "label", "is_core")


def tsvd_row_energy_query(spark, sf_dir):
    """All components together hold the squared length of every standardised row."""
    source = matrix(spark, sf_dir).select("line_no", *E)
    svd = tsvd(source, E, DIMS)
    cells = F.array(*svd.reduced_columns)
    energy = F.aggregate(cells, F.lit(0.0), lambda a, c: a + c * c)
    return svd.transform(source).select("line_no", F.round(energy, 6).alias("energy"))


# The same operators over all values of the vectors as above over PLANE.
REDUCED = 2


def _whole(spark, sf_dir):
    return matrix(spark, sf_dir).select("line_no", *E)


def tsvd_whole_query(spark, sf_dir):
    source = _whole(spark, sf_dir)
    return _round_all(tsvd(source, E, REDUCED).transform(source), ["c0", "c1"], "line_no")


def tsvd_unscaled_whole_query(spark, sf_dir):
    source = _whole(spark, sf_dir)
    return _round_all(tsvd(source, E, REDUCED, normalize=False).transform(source), ["c0", "c1"], "line_no")


def svd_tables_whole_query(spark, sf_dir):
    parts = tsvd(_whole(spark, sf_dir), E, DIMS, normalize=False).tables(spark)
    joined = parts["S"].join(parts["VT"], "component").join(parts["T"], "component")
    return _round_all(joined, ["singular_value", *E, "t"], "component")


def energy_total_whole_query(spark, sf_dir):
    """The squared singular values add up to the squares of all cells."""
    values = tsvd(_whole(spark, sf_dir), E, DIMS, normalize=False).tables(spark)["S"]
    return values.agg(F.round(F.sum(F.col("singular_value") * F.col("singular_value")), 6).alias("energy"))


def variance_ratios_whole_query(spark, sf_dir):
    source = _whole(spark, sf_dir)
    return _round_all(variance_ratios(source, tsvd(source, E, REDUCED, normalize=False)), ["variance_ratio"], "component")


def reconstruction_error_whole_query(spark, sf_dir):
    source = _whole(spark, sf_dir)
    return _round_all(reconstruction_error(source, tsvd(source, E, REDUCED, normalize=False)), ["error"])


def tsvd_srss_whole_query(spark, sf_dir):
    _, reduced = tsvd_srss(_whole(spark, sf_dir), E, 1, REDUCED, normalize=False)
    return _round_all(reduced, ["r0", "r1"], "line_no")


def tsvd_srss_default_query(spark, sf_dir):
    """Three components of all 64 values, the default."""
    _, reduced = tsvd_srss(_whole(spark, sf_dir), E, normalize=False)
    return _round_all(reduced, ["r0", "r1"], "line_no")


def tsvd_wide_query(spark, sf_dir):
    """The products of every two of the first 24 values, 300 columns, reduced to four."""
    pairs = [(i, j) for i in range(24) for j in range(i, 24)]
    names = [f"p{i}_{j}" for i, j in pairs]
    products = [(F.col(E[i]) * F.col(E[j])).alias(n) for (i, j), n in zip(pairs, names)]
    source = _whole(spark, sf_dir).select("line_no", *products)
    fitted = tsvd(source, names, 4)
    return _round_all(fitted.transform(source), fitted.reduced_columns, "line_no")


def anomaly_score_whole_query(spark, sf_dir):
    return _round_all(reconstruction_anomaly_score(_whole(spark, sf_dir), E, REDUCED), ["score"], "line_no")


def combine_whole_query(spark, sf_dir):
    return _round_all(combine_near_duplicates(_whole(spark, sf_dir), E, RTOL), E, "sample", "weight")


def dbscan_combined_whole_query(spark, sf_dir):
    found = dbscan(_whole(spark, sf_dir), E, WHOLE_EPS, MIN_SAMPLES, rtol=RTOL)
    return found.select("sample", "weight", "label", "is_core")


def corrupt_lines_query(spark, sf_dir):
    """Every seventh access line is broken on purpose; the run keeps them as a table."""
    log = lines(spark, sf_dir, "access_lines")
    broken = F.when(F.col("line_no") % 7 == 0, F.concat(F.lit("broken "), "value")).otherwise(F.col("value"))
    run = LogPipeline("access", "tsvd").run(log.withColumn("value", broken))
    return run.tables["corrupt_lines"].select("line_no", "value")


def imapd_counts_query(spark, sf_dir):
    """The counts per address and user as rows of a run, numbered in the order of the table."""
    run = LogPipeline("imapd_counts", "tsvd").run(lines(spark, sf_dir, "imapd_lines"))
    return run.tables["raw_data"].select("line_no", "login", "badlogin", "failed", "IP", "userid")


QUERIES = {
    "fnv1_64_unit": page_hashes_query,
    "fnv1_64_unit_native": page_hashes_native_query,
    "hash_encode": hash_encode_query,
    "standardize": standardize_query,
    "standardize_access": standardize_access_query,
    "profile": profile_query,
    "tsvd": tsvd_query,
    "tsvd_unscaled": tsvd_unscaled_query,
    "tsvd_rebuilt": tsvd_rebuilt_query,
    "tsvd_access": tsvd_access_query,
    "energy_curve": svd_tables_query,
    "variance_ratios": variance_ratios_query,
    "reconstruction_error": reconstruction_error_query,
    "srss": srss_query,
    "tsvd_srss": tsvd_srss_query,
    "centroid_distance": centroid_distance_query,
    "tsvd_centroid_distance": tsvd_centroid_distance_query,
    "reconstruction_anomaly_score": anomaly_score_query,
    "kmeans": kmeans_query,
    "kmeans_labels": kmeans_labels_query,
    "dbscan": dbscan_query,
    "dbscan_combined": dbscan_combined_query,
    "dbscan_mail": dbscan_mail_query,
    "combine_near_duplicates": combine_query,
    "optics": optics_query,
    "cluster_centroids": cluster_centroids_query,
    "cluster_sizes": cluster_sizes_query,
    "euclidean_to_centroids": euclidean_query,
    "cosine_to_centroids": cosine_query,
    "classify_euclidean": classify_euclidean_query,
    "classify_cosine": classify_cosine_query,
    "orient_labels_euclidean": orient_euclidean_query,
    "orient_labels_cosine": orient_cosine_query,
    "reduce_log": reduce_log_query,
    "plot_points": plot_points_query,
    "plot_points_3d": plot_points_3d_query,
    "thin_points": thin_points_query,
    "append_centroids": append_centroids_query,
    "align_by_line": align_query,
    "log_pipeline": pipeline_query,
    "log_pipeline_reduced_log": reduced_log_query,
    "log_distance_labels": distance_labels_query,
    "stored_model_labels": stored_model_query,
    "score_stream": score_stream_query,
    "log_pipeline_corrupt_lines": corrupt_lines_query,
    "dbscan_whole": dbscan_whole_query,
    "optics_whole": optics_whole_query,
    "tsvd_row_energy": tsvd_row_energy_query,
    "tsvd_whole": tsvd_whole_query,
    "tsvd_unscaled_whole": tsvd_unscaled_whole_query,
    "energy_curve_whole": svd_tables_whole_query,
    "energy_total_whole": energy_total_whole_query,
    "variance_ratios_whole": variance_ratios_whole_query,
    "reconstruction_error_whole": reconstruction_error_whole_query,
    "tsvd_srss_whole": tsvd_srss_whole_query,
    "tsvd_srss_default": tsvd_srss_default_query,
    "tsvd_wide": tsvd_wide_query,
    "reconstruction_anomaly_score_whole": anomaly_score_whole_query,
    "combine_near_duplicates_whole": combine_whole_query,
    "dbscan_combined_whole": dbscan_combined_whole_query,
    "imapd_counts_pipeline": imapd_counts_query,
}


# ---------------------------------------------------------------- SQL


def fnv_sql(text: str) -> str:
    """FNV-1 64 over the bytes of ``text`` in 128-bit integers, scaled to [0, 1]."""
    hexed = f"hex(encode({text}))"
    digit = "(instr('0123456789ABCDEF', substr({0}, {1}, 1)) - 1)"
    high, low = digit.format(hexed, "2 * i - 1"), digit.format(hexed, "2 * i")
    octets = (
        f"list_transform(range(1, CAST(length({hexed}) // 2 + 1 AS BIGINT)), lambda i: CAST({high} * 16 + {low} AS HUGEINT))"
    )
    step = "xor((h * 1099511628211) % 18446744073709551616::HUGEINT, b)"
    value = f"list_reduce(list_concat([0::HUGEINT], {octets}), lambda h, b: {step})"
    return f"CAST({value} AS DOUBLE) / 18446744073709551616.0::DOUBLE"


def r6(expression: str, alias: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {alias}"


def hashed_once(cte: str, source: str, columns: list[str]) -> str:
    """CTE ``hashes(v, h)`` over the distinct values of the text columns of ``source``."""
    values = " UNION ".join(f"SELECT coalesce({c}, 'None') AS v FROM {source}" for c in columns)
    return f"{cte}, vals AS ({values}), hashes AS (SELECT v, {fnv_sql('v')} AS h FROM vals)"


TEXTS = ["remote_host", "request", "referer", "user_agent"]
FEATURES_CTE = (
    hashed_once(ACCESS_CTE, "access", TEXTS)
    + ", feats AS (SELECT a.line_no, "
    + ", ".join(f"h_{c}.h AS {c}" for c in TEXTS)
    + ", coalesce(a.bytes_sent, 0)::DOUBLE AS bytes_sent, a.status FROM access a "
    + " ".join(f"JOIN hashes h_{c} ON h_{c}.v = coalesce(a.{c}, 'None')" for c in TEXTS)
    + ")"
)
M = view_sql("matrix")


def z(column: str) -> str:
    return f"({column} - avg({column}) OVER ()) / stddev_pop({column}) OVER ()"


Z_CTE = f"{M}, z AS (SELECT line_no, {', '.join(f'{z(c)} AS {c}' for c in E)} FROM matrix)"


def svd_cte(source: str) -> str:
    """Two-column SVD in closed form: ``v`` has one row with values and vectors of both components."""
    return f"""g AS (SELECT sum(e0 * e0) AS a, sum(e0 * e1) AS b, sum(e1 * e1) AS c, count(*) AS n FROM {source}),
l AS (SELECT a, b, c, ((a + c) + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l0, ((a + c) - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1 FROM g),
raw AS (SELECT l0, l1, b AS p0, l0 - a AS q0, b AS p1, l1 - a AS q1 FROM l),
unit AS (SELECT l0, l1, p0 / sqrt(p0 * p0 + q0 * q0) AS p0, q0 / sqrt(p0 * p0 + q0 * q0) AS q0, p1 / sqrt(p1 * p1 + q1 * q1) AS p1, q1 / sqrt(p1 * p1 + q1 * q1) AS q1 FROM raw),
sgn AS (SELECT *, CASE WHEN (CASE WHEN abs(p0) >= abs(q0) - 1e-9 THEN p0 ELSE q0 END) < 0 THEN -1 ELSE 1 END AS s0,
  CASE WHEN (CASE WHEN abs(p1) >= abs(q1) - 1e-9 THEN p1 ELSE q1 END) < 0 THEN -1 ELSE 1 END AS s1 FROM unit),
v AS (SELECT sqrt(l0) AS sv0, sqrt(l1) AS sv1, p0 * s0 AS p0, q0 * s0 AS q0, p1 * s1 AS p1, q1 * s1 AS q1, l0, l1 FROM sgn),
us AS (SELECT m.line_no, m.e0, m.e1, m.e0 * v.p0 + m.e1 * v.q0 AS c0, m.e0 * v.p1 + m.e1 * v.q1 AS c1 FROM {source} m, v)"""


def density_sql(source_cte: str, eps: float, min_samples: int, label: str, columns=PLANE) -> str:
    """Pairs, core rows, reachability, numbering and the border rule over table ``m(line_no, .., w)``."""
    gap = " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in columns)
    return f"""WITH RECURSIVE {source_cte},
p AS (SELECT x.line_no AS i, y.line_no AS j, y.w FROM m x JOIN m y ON {gap} <= {eps!r}::DOUBLE * {eps!r}::DOUBLE),
core AS (SELECT i FROM p GROUP BY i HAVING sum(w) >= {min_samples}),
cp AS (SELECT i, j FROM p WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach(i, r) AS (SELECT i, i FROM core UNION SELECT cp.j, reach.r FROM reach JOIN cp ON cp.i = reach.i),
comp AS (SELECT i, min(r) AS s FROM reach GROUP BY i),
num AS (SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS k FROM (SELECT DISTINCT s FROM comp)),
adj AS (SELECT p.i, min(comp.s) AS s FROM p JOIN comp ON comp.i = p.j GROUP BY p.i),
labelled AS (SELECT m.*, n1.k AS core_k, n2.k AS border_k, adj.s AS start FROM m LEFT JOIN comp ON comp.i = m.line_no LEFT JOIN num n1 ON n1.s = comp.s
  LEFT JOIN adj ON adj.i = m.line_no LEFT JOIN num n2 ON n2.s = adj.s)
SELECT {label} FROM labelled"""


DBSCAN_LABEL = "CAST(coalesce(core_k, border_k, -1) AS INTEGER) AS label, core_k IS NOT NULL AS is_core"
OPTICS_LABEL = "CAST(coalesce(core_k, CASE WHEN start < line_no THEN border_k END, -1) AS INTEGER) AS label, core_k IS NOT NULL AS is_core"
WHOLE_CTE = f"{M}, m AS (SELECT line_no, {', '.join(f'{z(c)} AS {c}' for c in E)}, 1 AS w FROM matrix)"
PLANE_CTE = f"{M}, m AS (SELECT line_no, {z('e0')} AS e0, {z('e1')} AS e1, 1 AS w FROM matrix)"


def combine_cte(source: str) -> str:
    """Sequential walk over ``source(e0, e1)`` in sorted order; ``combined`` has one row per sample."""
    return f"""rows_ AS (SELECT row_number() OVER (ORDER BY e0, e1) AS n, e0, e1 FROM {source}),
walk(n, r0, r1, sample) AS (SELECT n, e0, e1, 0 FROM rows_ WHERE n = 1 UNION ALL
  SELECT t.n, CASE WHEN t.far THEN t.e0 ELSE t.r0 END, CASE WHEN t.far THEN t.e1 ELSE t.r1 END, CASE WHEN t.far THEN t.sample + 1 ELSE t.sample END FROM (
    SELECT x.n, x.e0, x.e1, w.r0, w.r1, w.sample, sqrt((x.e0 - w.r0) * (x.e0 - w.r0) + (x.e1 - w.r1) * (x.e1 - w.r1)) > {RTOL!r}::DOUBLE * (sqrt(w.r0 * w.r0 + w.r1 * w.r1) + {RTOL!r}::DOUBLE) AS far
    FROM walk w JOIN rows_ x ON x.n = w.n + 1) t),
combined AS (SELECT CAST(sample AS BIGINT) AS sample, r0 AS e0, r1 AS e1, count(*) AS weight FROM walk GROUP BY sample, r0, r1)"""


def combine_whole_cte(source: str) -> str:
    """The walk of ``combine_cte`` over all columns."""
    cells = ", ".join(E)
    return f"""rows_ AS (SELECT row_number() OVER (ORDER BY {cells}) AS n, [{cells}] AS x FROM {source}),
walk(n, r, sample) AS (SELECT n, x, 0 FROM rows_ WHERE n = 1 UNION ALL
  SELECT t.n, CASE WHEN t.far THEN t.x ELSE t.r END, CASE WHEN t.far THEN t.sample + 1 ELSE t.sample END FROM (
    SELECT y.n, y.x, w.r, w.sample, list_distance(y.x, w.r) > {RTOL!r}::DOUBLE * (sqrt(list_inner_product(w.r, w.r)) + {RTOL!r}::DOUBLE) AS far
    FROM walk w JOIN rows_ y ON y.n = w.n + 1) t),
combined AS (SELECT CAST(sample AS BIGINT) AS sample, {', '.join(f'r[{i + 1}] AS {c}' for i, c in enumerate(E))}, count(*) AS weight FROM walk GROUP BY sample, r)"""


COARSE_CTE = f"{M}, coarse AS (SELECT line_no, round(e0, 1) AS e0, round(e1, 1) AS e1 FROM matrix)"
CENTROID_CTE = f"{M}, cen AS (SELECT label, {', '.join(f'avg({c}) AS {c}' for c in E)} FROM matrix WHERE label < 2 GROUP BY label)"


def _distance(alias: str) -> str:
    return "sqrt(" + " + ".join(f"(m.{c} - {alias}.{c}) * (m.{c} - {alias}.{c})" for c in E) + ")"


def _cosine_sql(alias: str) -> str:
    product = " + ".join(f"m.{c} * {alias}.{c}" for c in E)
    sizes = " * ".join("sqrt(" + " + ".join(f"{t}.{c} * {t}.{c}" for c in E) + ")" for t in ("m", alias))
    return f"({product}) / ({sizes})"


BOTH = "FROM matrix m, (SELECT * FROM cen WHERE label = 0) z0, (SELECT * FROM cen WHERE label = 1) z1"
EUCLIDEAN_CTE = f"{CENTROID_CTE}, d AS (SELECT m.line_no, m.status, {_distance('z0')} AS d0, {_distance('z1')} AS d1 {BOTH}), lab AS (SELECT *, CASE WHEN d0 < d1 THEN 0 ELSE 1 END AS label FROM d)"
COSINE_CTE = f"{CENTROID_CTE}, d AS (SELECT m.line_no, m.status, {_cosine_sql('z0')} AS s0, {_cosine_sql('z1')} AS s1 {BOTH}), lab AS (SELECT *, CASE WHEN s0 > s1 THEN 0 ELSE 1 END AS label FROM d)"
FLIP = "CASE WHEN (SELECT count_if(status <> 0.2 AND label = 1) > count_if(status <> 0.2 AND label = 0) FROM lab) THEN 1 - label ELSE label END"
PROFILE_TEXTS = ["remote_host", "request", "referer", "user_agent"]


def profile_sql() -> str:
    nothing = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("mean", "std", '"min"', "q25", "q50", "q75", '"max"'))
    texts = [
        f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM access) AS "count", (SELECT count(DISTINCT {c}) FROM access) AS "unique",
(SELECT {c} FROM access WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
(SELECT max(n) FROM (SELECT count(*) AS n FROM access WHERE {c} IS NOT NULL GROUP BY {c})) AS freq, {nothing}"""
        for c in PROFILE_TEXTS
    ]
    numbers = [
        f"""SELECT '{c}', count({c}), NULL, NULL, NULL, {r6(f'avg({c}::DOUBLE)', 'mean')}, {r6(f'stddev_samp({c}::DOUBLE)', 'std')}, {r6(f'min({c}::DOUBLE)', '"min"')},
{', '.join(r6(f'quantile_cont({c}::DOUBLE, {q})', n) for n, q in (('q25', 0.25), ('q50', 0.5), ('q75', 0.75)))}, {r6(f'max({c}::DOUBLE)', '"max"')} FROM access"""
        for c in ("bytes_sent", "status")
    ]
    return f"WITH {ACCESS_CTE} " + " UNION ALL ".join(texts + numbers)


LABEL_JOIN = "LEFT JOIN labels t ON t.doc_id = m.line_no"
ZD = [f"(f.{c} - s.m_{c}) / s.d_{c}" for c in ("bytes_sent", "status", "referer")]
DISTANCE_LABELS_SQL = f"""WITH {FEATURES_CTE},
s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}' for c in ('bytes_sent', 'status', 'referer'))} FROM feats),
x AS (SELECT f.line_no, f.status, {ZD[0]} AS a, {ZD[1]} AS b, {ZD[2]} AS c FROM feats f, s),
good AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM x WHERE status = 0.2), bad AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM x WHERE status <> 0.2),
lab AS (SELECT x.line_no, x.status, CASE WHEN sqrt((x.a - bad.a) ** 2 + (x.b - bad.b) ** 2 + (x.c - bad.c) ** 2) < sqrt((x.a - good.a) ** 2 + (x.b - good.b) ** 2 + (x.c - good.c) ** 2) THEN 0 ELSE 1 END AS label FROM x, good, bad)
SELECT line_no, CAST({FLIP} AS INTEGER) AS label FROM lab"""

URL_HASH_SQL = f"SELECT page_id, round({fnv_sql('url')}, 6) AS url_hash FROM pages"

ORACLES = {
    "energy_total_whole": f"WITH {M} SELECT round({' + '.join(f'sum({c} * {c})' for c in E)}, 6) AS energy FROM matrix",
    "combine_near_duplicates_whole": f"WITH RECURSIVE {M}, {combine_whole_cte('matrix')} SELECT sample, weight, {', '.join(r6(c, c) for c in E)} FROM combined",
    "dbscan_combined_whole": density_sql(
        f"{Z_CTE}, {combine_whole_cte('z')}, m AS (SELECT sample AS line_no, {', '.join(E)}, weight AS w FROM combined)",
        WHOLE_EPS,
        MIN_SAMPLES,
        "line_no AS sample, w AS weight, " + DBSCAN_LABEL,
        E,
    ),
    "dbscan_whole": density_sql(WHOLE_CTE, WHOLE_EPS, MIN_SAMPLES, "line_no, " + DBSCAN_LABEL, E),
    "optics_whole": density_sql(WHOLE_CTE, WHOLE_EPS, MIN_SAMPLES, "line_no, " + OPTICS_LABEL, E),
    "tsvd_row_energy": f"WITH {Z_CTE} SELECT line_no, round({' + '.join(f'{c} * {c}' for c in E)}, 6) AS energy FROM z",
    "log_pipeline_corrupt_lines": f"WITH {view_sql('access_lines')} SELECT line_no, 'broken ' || value AS value FROM access_lines WHERE line_no % 7 = 0",
    "imapd_counts_pipeline": f"WITH {AUTH_CTE}, counts AS (SELECT count_if(what = 0)::BIGINT AS login, count_if(what = 1)::BIGINT AS badlogin, count_if(what = 2)::BIGINT AS failed, \"IP\", userid FROM auth GROUP BY \"IP\", userid) SELECT row_number() OVER (ORDER BY \"IP\"::VARCHAR, userid) AS line_no, login, badlogin, failed, \"IP\", userid FROM counts",
    "fnv1_64_unit": URL_HASH_SQL,
    "fnv1_64_unit_native": URL_HASH_SQL,
    "hash_encode": f"WITH {FEATURES_CTE} SELECT line_no, {', '.join(r6(c, c) for c in ACCESS_FEATURES)} FROM feats",
    "standardize": f"WITH {Z_CTE} SELECT line_no, {', '.join(r6(c, c) for c in E)} FROM z",
    "standardize_access": f"WITH {ACCESS_CTE}, f AS (SELECT line_no, coalesce(bytes_sent, 0)::DOUBLE AS bytes_sent, status FROM access) SELECT line_no, {r6(z('bytes_sent'), 'bytes_sent')}, {r6(z('status'), 'status')} FROM f",
    "profile": profile_sql(),
    "tsvd": f"WITH {Z_CTE}, {svd_cte('z')} SELECT line_no, {r6('c0', 'c0')}, {r6('c1', 'c1')} FROM us",
    "tsvd_unscaled": f"WITH {M}, {svd_cte('matrix')} SELECT line_no, {r6('c0', 'c0')}, {r6('c1', 'c1')} FROM us",
    "tsvd_rebuilt": f"WITH {Z_CTE} SELECT line_no, {', '.join(r6(c, c) for c in E)} FROM z",
    "energy_curve": f"""WITH {M}, {svd_cte('matrix')} SELECT 0::INTEGER AS component, {r6('sv0', 'singular_value')}, {r6('p0', 'e0')}, {r6('q0', 'e1')}, {r6('l0 / (l0 + l1)', 't')} FROM v
UNION ALL SELECT 1, {r6('sv1', 'singular_value')}, {r6('p1', 'e0')}, {r6('q1', 'e1')}, {r6('1.0::DOUBLE', 't')} FROM v""",
    "variance_ratios": f"""WITH {M}, {svd_cte('matrix')}, t AS (SELECT var_pop(e0) + var_pop(e1) AS v FROM matrix)
SELECT 0::INTEGER AS component, {r6('var_pop(c0) / (SELECT v FROM t)', 'variance_ratio')} FROM us UNION ALL SELECT 1, {r6('var_pop(c1) / (SELECT v FROM t)', 'variance_ratio')} FROM us""",
    "reconstruction_error": f"WITH {M}, {svd_cte('matrix')} SELECT {r6('sv1', 'error')} FROM v",
    "srss": f"WITH {M} SELECT line_no, {r6('sqrt(e0 * e0)', 'r0')}, {r6('sqrt(e1 * e1 + e2 * e2)', 'r1')} FROM matrix",
    "tsvd_srss": f"WITH {M}, {svd_cte('matrix')} SELECT line_no, {r6('sqrt(c0 * c0)', 'r0')}, {r6('sqrt(c1 * c1)', 'r1')} FROM us",
    "centroid_distance": f"WITH {M}, c AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in E)} FROM matrix) SELECT m.line_no, {r6(_distance('c'), 'distance')} FROM matrix m, c",
    "tsvd_centroid_distance": f"WITH {Z_CTE} SELECT line_no, {r6('sqrt(' + ' + '.join(f'{c} * {c}' for c in E) + ')', 'distance')} FROM z",
    "reconstruction_anomaly_score": f"WITH {M}, {svd_cte('matrix')}, loss AS (SELECT line_no, c1 * c1 AS x FROM us) SELECT line_no, {r6('(x - (SELECT min(x) FROM loss)) / ((SELECT max(x) FROM loss) - (SELECT min(x) FROM loss))', 'score')} FROM loss",
    "kmeans_labels": "WITH g AS (SELECT quality, toxic, row_number() OVER (ORDER BY count(*) DESC, quality, toxic) - 1 AS k FROM labels GROUP BY quality, toxic) SELECT l.doc_id AS line_no, CAST(g.k AS INTEGER) AS cluster FROM labels l JOIN g ON g.quality = l.quality AND g.toxic = l.toxic",
    "dbscan": density_sql(PLANE_CTE, EPS, MIN_SAMPLES, "line_no, " + DBSCAN_LABEL),
    "optics": density_sql(PLANE_CTE, EPS, MIN_SAMPLES, "line_no, " + OPTICS_LABEL),
    "combine_near_duplicates": f"WITH RECURSIVE {COARSE_CTE}, {combine_cte('coarse')} SELECT sample, weight, {r6('e0', 'e0')}, {r6('e1', 'e1')} FROM combined",
    "dbscan_combined": density_sql(
        f"{COARSE_CTE}, zc AS (SELECT {z('e0')} AS e0, {z('e1')} AS e1 FROM coarse), {combine_cte('zc')}, m AS (SELECT sample AS line_no, e0, e1, weight AS w FROM combined)",
        0.5,
        MIN_SAMPLES,
        "line_no AS sample, w AS weight, " + DBSCAN_LABEL,
    ),
    "cluster_centroids": f"WITH {M} SELECT CAST(label AS INTEGER) AS cluster, {', '.join(r6(f'avg({c})', c) for c in E)} FROM matrix WHERE label <> 9 GROUP BY label",
    "cluster_sizes": f"WITH {M} SELECT count(DISTINCT label) FILTER (label <> 9) AS n_clusters, count_if(label = 9)::BIGINT AS n_noise FROM matrix",
    "euclidean_to_centroids": f"WITH {EUCLIDEAN_CTE} SELECT line_no, {r6('d0', 'd0')}, {r6('d1', 'd1')} FROM d",
    "cosine_to_centroids": f"WITH {COSINE_CTE} SELECT line_no, {r6('s0', 's0')}, {r6('s1', 's1')} FROM d",
    "classify_euclidean": f"WITH {EUCLIDEAN_CTE} SELECT line_no, label FROM lab",
    "classify_cosine": f"WITH {COSINE_CTE} SELECT line_no, label FROM lab",
    "orient_labels_euclidean": f"WITH {EUCLIDEAN_CTE} SELECT line_no, {FLIP} AS label FROM lab",
    "orient_labels_cosine": f"WITH {COSINE_CTE} SELECT line_no, {FLIP} AS label FROM lab",
    "reduce_log": f"WITH {ACCESS_CTE} SELECT l.line_no, l.value FROM access_lines l JOIN access a ON a.line_no = l.line_no WHERE a.status <> 0.2",
    "plot_points": f"WITH {M} SELECT m.line_no, 'Log Line: ' || m.line_no AS log_line, coalesce(CAST(t.toxic AS VARCHAR), '0') AS label, {r6('m.e0', 'x')}, {r6('m.e1', 'y')} FROM matrix m {LABEL_JOIN}",
    "thin_points": f"""WITH {M}, points AS (SELECT m.line_no, coalesce(CAST(t.toxic AS VARCHAR), '0') AS label, m.e0 AS x, m.e1 AS y, m.e2 AS z FROM matrix m {LABEL_JOIN}),
 ends AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points),
 boxed AS (SELECT p.*, least(floor((x - x0) * (8 / (x1 - x0))), 7) AS bx, least(floor((y - y0) * (8 / (y1 - y0))), 7) AS by_, least(floor((z - z0) * (8 / (z1 - z0))), 7) AS bz FROM points p, ends),
 ranked AS (SELECT *, count(*) OVER (PARTITION BY label, bx, by_, bz) AS n, row_number() OVER (PARTITION BY label, bx, by_, bz ORDER BY md5(line_no::VARCHAR), line_no) AS k FROM boxed)
 SELECT line_no, 'Log Line: ' || line_no AS log_line, label, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')}, {r6('n / least(n, 2)', 'weight')} FROM ranked WHERE k <= 2""",
    "plot_points_3d": f"WITH {M} SELECT m.line_no, 'Log Line: ' || m.line_no AS log_line, CAST(t.toxic AS VARCHAR) AS label, {r6('m.e0', 'x')}, {r6('m.e1', 'y')}, {r6('m.e2', 'z')} FROM matrix m JOIN labels t ON t.doc_id = m.line_no",
    "append_centroids": f"""WITH {CENTROID_CTE} SELECT line_no, 'Log Line: ' || line_no AS log_line, '0' AS label, {r6('e0', 'x')}, {r6('e1', 'y')} FROM matrix
UNION ALL SELECT (SELECT max(line_no) FROM matrix) + 1 + label, 'Log Line: ' || ((SELECT max(line_no) FROM matrix) + 1 + label), 'Centroid ' || label, {r6('e0', 'x')}, {r6('e1', 'y')} FROM cen""",
    "align_by_line": f"WITH {M} SELECT m.line_no, t.toxic AS label, {r6('m.e0', 'e0')} FROM matrix m {LABEL_JOIN}",
    "log_distance_labels": DISTANCE_LABELS_SQL,
    "stored_model_labels": DISTANCE_LABELS_SQL,
    "score_stream": DISTANCE_LABELS_SQL,
}
