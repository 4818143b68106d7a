"""URL verdicts: longest host and path rule, else gradient-boosted trees on lexical features.

A rule names a host and the start of a path; it fits the host and all its subdomains. Where no rule
fits, trees decide. They are trained on the labelled URLs, which are all those that a rule decides
(or any table of urls with labels), by Spark's distributed gradient boosting. Features are those of
the text alone: lengths, depth, shares of digits and other characters, entropy, parameter counts,
and for host suffix, first path part and leading host part the share of blocked URLs among the
labelled ones, smoothed towards the overall share. In training these shares are counted outside the
fold of the row. Everything is fitted on all labelled URLs.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule;
without any labelled URL, or with labels of one kind only, everything undecided gets the common
label (allow if there is none); repeated rows each have their own verdict; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.scratch import materialize

# Host and path of each rule with its verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
TREES, DEPTH, SEED = 20, 4, 7
# Folds, by the hash of the URL, outside of which a training row's shares are counted.
FOLDS = 5
# Labelled URLs of a task that fits trees.
ROWS_PER_TASK = 10_000
# Labelled URLs that an unseen suffix counts for at the overall share.
SMOOTHING = 10.0
# Most values of a suffix that are broadcast; more are joined by a shuffle.
BROADCAST_VALUES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    has = F.coalesce(F.instr("url", "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return pages.select(
        "page_id", "url", F.when(has, host).otherwise(empty).alias("host"), F.when(has, path).otherwise(empty).alias("path")
    )


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: dict[str, str] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


SUFFIXES = ("suffix", "first_part", "lead")
LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "host_depth", "digits", "others",
    "entropy", "parameters", "hyphens", "has_fragment", "secure",
)


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host, path) and the lexical features and suffix values."""
    text = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda column, pattern: F.length(column) - F.length(F.regexp_replace(column, pattern, ""))
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def information(c):
        share = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
        return -share * F.log2(share)

    entropy = F.aggregate(F.transform(F.array_distinct(chars), information), F.lit(0.0), lambda a, b: a + b)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return urls.select(
        "*",
        F.length(text).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        F.size(labels).cast("double").alias("host_depth"),
        (count(text, "[0-9]") / size).alias("digits"),
        (count(text, "[^A-Za-z0-9]") / size).alias("others"),
        entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise((F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).cast("double")).alias("parameters"),
        (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.instr(text, "#").cast("boolean").cast("double").alias("has_fragment"),
        text.startswith("https").cast("double").alias("secure"),
        F.substring_index("host", ".", -2).alias("suffix"),
        F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")).alias("first_part"),
        labels.getItem(0).alias("lead"),
    )


def _shares(train: DataFrame, name: str, overall: float) -> tuple[DataFrame, DataFrame]:
    """Share of blocked URLs by value: (of all rows, of the rows outside each fold), smoothed.

    A training row takes the second one, so that its own label is no part of its features.
    """
    sums = train.groupBy(name, "fold").agg(F.sum("label").alias("_b"), F.count("*").alias("_n"))
    every = sums.groupBy(name).agg(F.sum("_b").alias("_all_b"), F.sum("_n").alias("_all_n"))
    smooth = lambda b, n: (b + F.lit(SMOOTHING * overall)) / (n + F.lit(SMOOTHING))
    outside = sums.join(every, name).select(
        name, "fold", smooth(F.col("_all_b") - F.col("_b"), F.col("_all_n") - F.col("_n")).alias(f"{name}_share")
    )
    return every.select(name, smooth(F.col("_all_b"), F.col("_all_n")).alias(f"{name}_share")), outside


def _joined(table: DataFrame, shares: dict[str, DataFrame], keys: list[str], overall: float) -> DataFrame:
    for name, known in shares.items():
        table = table.join(known, [name, *keys], "left")
        table = table.withColumn(f"{name}_share", F.coalesce(f"{name}_share", F.lit(overall)))
    return table


def trained_scores(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """``urls`` with ``block_score``: trees trained on ``labelled`` (url, host, path, label of 0 or 1).

    The rows are dealt by the hash of their URL into a number of partitions that follows from their
    number alone, so the trees do not depend on how the rows lay before.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    train = materialize(features(labelled.select("url", "host", "path", "label")).withColumn("fold", fold), "train")
    totals = train.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = totals["n"], totals["blocked"] or 0
    overall = blocked / n if n else 0.0
    if blocked in (0, n):
        return urls.withColumn("block_score", F.lit(float(overall)))
    known, outside = {}, {}
    for name in SUFFIXES:
        whole, other = (materialize(t, "shares") for t in _shares(train, name, overall))
        few = other.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
        known[name], outside[name] = (F.broadcast(t) if few else t for t in (whole, other))
    columns = [*LEXICAL, *(f"{name}_share" for name in SUFFIXES)]
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    place = F.xxhash64("url").alias("place")
    ready = assemble.transform(_joined(train, outside, ["fold"], overall))
    ready = ready.select("features", F.col("label").cast("double"), "url", place)
    ready = ready.repartition(-(-n // ROWS_PER_TASK), "place").sortWithinPartitions("place", "url")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.2)
    model = trees.fit(ready.select("features", "label"))
    scored = model.transform(assemble.transform(_joined(features(urls), known, [], overall)))
    kept = [*urls.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("block_score")]
    return scored.select(*kept)


def judged_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row of ``pages`` (page_id, url)."""
    named = parts(pages).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    decided = verdict_of(F.col("rule"), rules)
    labelled = named.where("rule is not null").withColumn("label", (decided == "block").cast("int"))
    scored = trained_scores(named, labelled)
    guess = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(decided, guess).alias("verdict"), "block_score")
