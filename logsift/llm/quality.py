"""Quality by weak supervision.

Counts of a text are taken in one pass. Rules over the counts vote for good (1) or bad (-1) or
abstain (0); each looks for one defect or for one sign of running text. Documents with equal votes
are one case, and there are at most 2^rules cases, so expectation-maximisation over the cases
estimates how often each rule votes on good and on bad documents and how many are good; no labels
are needed. The posterior probability of being good then decides, in place of a filter that all
rules must pass.

Words are runs without the blanks \\x20 and \\x09-\\x0D. Defined results: a null or empty text has
counts of 0 and fails the base rule; repeated rows are judged each by itself; an empty table gives
no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import WordHashes, rolled, text_bytes
from logsift.scratch import materialize

REPEATED = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_distinct", "n_stutter", "n_marks", "n_upper", "n_lower",
)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeated_words(words: list[bytes], hashes: WordHashes, size: int = REPEATED) -> int:
    """Words inside windows of ``size`` words that occur at least twice."""
    if len(words) <= size:
        return 0
    windows = rolled(hashes.of(words), size)
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if counts.max() < 2:
        return 0
    edges = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(counts[which] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row of ``docs`` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or b""
                words = text.split()
                lines = [line for line in text.split(b"\n") if line.strip()]
                without = [len(text) - len(text.translate(None, some)) for some in (SYMBOLS, _UPPER, _LOWER)]
                out.append(
                    (
                        len(words),
                        len(b"".join(words).decode("utf-8", "replace")),
                        without[0],
                        len(lines) - len(set(lines)),
                        repeated_words(words, hashes),
                        len(lines),
                        len(set(words)),
                        sum(map(eq, words, words[1:])),
                        text.count(b"!") + text.count(b"?"),
                        without[1],
                        without[2],
                    )
                )
            columns = zip(*out, strict=True) if out else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]],
                names=["doc_id", *COUNTS],
            )

    return text_bytes(docs).mapInArrow(rows, ", ".join(f"{c} long" for c in ("doc_id", *COUNTS)))


def rules() -> dict[str, Column]:
    """Vote of each rule; all abstain where they see nothing of theirs."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    symbols, marks = F.col("n_symbols") / n, F.col("n_marks") / n
    upper = F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    repeats, copies = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines
    length, variety = F.col("word_chars") / n, F.col("n_distinct") / n
    defects = {
        "symbols": symbols >= 0.2,
        "marks": marks >= 0.2,
        "capitals": upper >= 0.4,
        "repeats": repeats >= 0.3,
        "stutter": F.col("n_stutter") / n >= 0.2,
        "copied_lines": (F.col("n_dup_lines") >= 5) & (copies >= 0.3),
        "word_length": (length < 2) | (length > 14),
        "variety": (F.col("n_words") >= 40) & (variety <= 0.25),
    }
    calm = (symbols <= 0.1) & (marks <= 0.1) & (upper <= 0.25)
    signs = {
        "plain": calm & (symbols <= 0.05) & (marks <= 0.05) & (repeats <= 0.2),
        "fresh": calm & (repeats <= 0.1) & (copies <= 0.05) & (variety >= 0.35),
    }
    return {k: F.when(c, -1).otherwise(0) for k, c in defects.items()} | {
        k: F.when(c, 1).otherwise(0) for k, c in signs.items()
    }


def base_failed() -> Column:
    """Fixed rule: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def fit_votes(votes: np.ndarray, weights: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Posterior of good for each case (row of votes in -1, 0, 1), by expectation-maximisation.

    Each rule has an accuracy, the chance that a vote of it is right, which starts at 0.9 and keeps
    one pseudo-vote in ten at that value; it is at least one half, as a rule may be useless but not
    inverted. An abstention says nothing and both classes are equally likely beforehand, because
    most defects are seen by one rule alone, and a class share would drown such a vote.
    """
    voted = np.abs(votes).astype(float)
    number = weights @ voted + 1e-9
    accuracy = np.full(votes.shape[1], 0.9)
    posterior = np.full(len(votes), 0.5)
    for _ in range(rounds):
        new = 1 / (1 + np.exp(-np.clip(votes @ np.log(accuracy / (1 - accuracy)), -500, 500)))
        right = np.where(votes > 0, new[:, None], 1 - new[:, None]) * voted
        accuracy = np.clip((weights @ right + 0.09 * number) / (1.1 * number), 0.5, 0.999)
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-9:
            break
    return posterior


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, votes, quality (posterior of good), base_failed and kept of every row."""
    votes = rules()
    counted = materialize(
        text_counts(docs).withColumn("votes", F.concat_ws(",", *[v.cast("string") for v in votes.values()])),
        "counted",
    )
    cases = counted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if cases:
        table = np.array([[int(v) for v in c["votes"].split(",")] for c in cases])
        quality = fit_votes(table, np.array([c["n"] for c in cases], float))
    else:
        quality = []
    schema = T.StructType([T.StructField("votes", T.StringType()), T.StructField("quality", T.DoubleType())])
    known = docs.sparkSession.createDataFrame(
        [(c["votes"], float(q)) for c, q in zip(cases, quality, strict=True)], schema
    )
    # At most 2^10 rows are broadcast.
    out = counted.join(F.broadcast(known), "votes").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
