"""logsift: log reduction and anomaly labelling on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel with the plan, so executors need no install of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from logsift.functions.fnv import fnv1_64_unit
from logsift.operators.access_log import (
    parse_access,
    split_request,
    split_url,
    split_user_agent,
    status_class,
)
from logsift.operators.anomaly import (
    classify_cosine,
    classify_euclidean,
    cosine_to_centroids,
    euclidean_to_centroids,
    orient_labels,
    reduce_log,
)
from logsift.operators.density import (
    cluster_centroids,
    cluster_sizes,
    dbscan,
    optics,
)
from logsift.operators.error_log import parse_error_log
from logsift.operators.features import expand_tokens, hash_encode, select_features
from logsift.operators.imapd_log import (
    imapd_auth_counts,
    imapd_auth_events,
    parse_imapd,
    parse_imapd_filtered,
)
from logsift.operators.kmeans import kmeans
from logsift.operators.mail_log import parse_mail
from logsift.operators.near_duplicates import combine_near_duplicates
from logsift.operators.points import align_by_line, append_centroids, plot_points, thin_points
from logsift.operators.profile import profile
from logsift.operators.scaling import fit_scaler, standardize
from logsift.operators.svd import (
    centroid_distance,
    energy_curve,
    reconstruction_anomaly_score,
    reconstruction_error,
    srss,
    tsvd,
    tsvd_centroid_distance,
    tsvd_srss,
    variance_ratios,
)
from logsift.operators.syslog import parse_messages
from logsift.plans.model import LogModel, load_model, model_versions
from logsift.plans.pipeline import LogPipeline
from logsift.sources.labels import read_labels
from logsift.sources.log_lines import read_log_lines
from logsift.sources.results import save_results
from logsift.streaming.auth_counts import read_auth_counts, stream_auth_counts
from logsift.streaming.scoring import read_scored, score_stream, stream_log_lines

__all__ = [
    name for name in dir() if not name.startswith("_") and name not in ("sys", "cloudpickle")
]
