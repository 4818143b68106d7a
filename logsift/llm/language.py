"""Language by mixture inference.

Counts of byte trigrams by language are learned from labelled documents. A document is then a
mixture: expectation-maximisation finds the proportions of the languages under which its trigrams
are most likely. The set of languages is chosen by likelihood less a penalty for each further one,
so a few borrowed words do not make a second language.

Proportions of learned languages alone add up to 1 for any text. ``background`` tells how much of it
they do not explain: the share of a uniform distribution over the buckets that is mixed with them. It
plays no part in the prediction; ``in_known_language`` rejects a text with more than MOST_BACKGROUND.

Trigrams run over the lower-cased text with everything in ASCII but letters taken as a blank, and
fall into 2^16 buckets, which bounds the model by languages x buckets.

Defined results: a null text or one without a letter is ``und`` with score 0 and background 1; so is
every document if nothing was learned; any other text has a learned language; documents without
``lang`` are not learned from; repeated rows each have their own result; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import pieces, text_batches, trimmed

UNKNOWN = "und"
BUCKETS = 1 << 16
# Text that is judged together and goes out in one batch.
PIECE_BYTES = 1 << 20
ROUNDS = 25
# Overlapping trigrams are no independent witnesses: about one in three counts.
OVERLAP = 3.0
# On sf0.01 the background takes less than 0.001 of every document, and 0.39 of Finnish, 0.50 of
# Turkish, 0.85 of random letters and 0.98 or more of other scripts.
MOST_BACKGROUND = 0.3
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram that is not all blanks."""
    data = b" ".join((b"", *text.lower().encode("utf-8", "replace").translate(_BLANKS).split(), b""))
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    codes = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    return (codes * np.uint32(2654435761)) >> np.uint32(16)


def held_out(folds: int, key: str = "doc_id") -> Column:
    """True for the rows kept for testing: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def language_counts(docs: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts by language of (text, lang), from every row with both."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at])],
                names=["lang", "bucket", "n"],
            )

    known = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = known.mapInArrow(trimmed(rows), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    with text_batches(docs.sparkSession):
        found = sums.collect()  # at most languages x BUCKETS rows
    for lang, bucket, n in found:
        out.setdefault(lang, np.zeros(BUCKETS))[bucket] = n
    return out


class Mixture:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        table = np.stack([counts[n] for n in self.names]) + 0.5
        self.chance = table / table.sum(axis=1, keepdims=True)

    def proportions(self, chance: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """(most likely proportions, log-likelihood) of trigrams with these chances by language."""
        share = np.full(len(chance), 1 / len(chance))
        total = weights.sum()
        for _ in range(ROUNDS if len(chance) > 1 else 0):
            mixed = share @ chance
            new = share * (chance @ (weights / mixed)) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        return share, float(weights @ np.log(share @ chance))

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float], float]:
        """(language, score, proportions of the chosen languages, background)."""
        if not text or not any(map(str.isalpha, text)):
            return NOTHING
        grams = trigrams(text)
        if len(grams) > 4096:
            found = np.bincount(grams, minlength=BUCKETS)
            at = np.flatnonzero(found)
            weights = found[at].astype(float)
        else:
            at, number = np.unique(grams, return_counts=True)
            weights = number.astype(float)
        weights /= OVERLAP
        chance = self.chance[:, at]
        total = weights.sum()
        price = 0.5 * np.log(total + 2)
        beside = self.proportions(np.vstack([chance, np.full(len(at), 1 / BUCKETS)]), weights)[0][-1]
        share, best = self.proportions(chance, weights)
        order = np.argsort(-share, kind="stable")
        # Languages join in the order of their share as long as the penalised likelihood grows.
        chosen = order[:1]
        shares, value = self.proportions(chance[chosen], weights)
        for n in range(2, len(order) + 1):
            if best - price * (n - 1) <= value - price * (len(chosen) - 1):
                break
            more, gained = self.proportions(chance[order[:n]], weights)
            if gained - price * (n - 1) <= value - price * (len(chosen) - 1):
                break
            chosen, shares, value = order[:n], more, gained
        top = int(np.argmax(shares))
        # One trigram in doubt spread over all languages keeps short texts from full certainty.
        score = (shares[top] * total + 1 / len(self.names)) / (total + 1)
        mix = {self.names[k]: float(s) for k, s in zip(chosen, shares, strict=True)}
        return self.names[chosen[top]], float(min(1.0, score)), mix, float(beside)


# What is said of a text without a letter.
NOTHING = (UNKNOWN, 0.0, {}, 1.0)
PREDICTED = "doc_id long, lang_pred string, score double, proportions map<string, double>, background double"


def predict_languages(docs: DataFrame, counts: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, proportions, background) from the text of each row alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Mixture(counts) if counts else None
        for batch in pieces(batches, PIECE_BYTES):
            found = [model.predict(t) if model else NOTHING for t in batch.column(1).to_pylist()]
            names, scores, mixes, beside = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array([list(m.items()) for m in mixes], pa.map_(pa.string(), pa.float64())),
                    pa.array(beside, pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score", "proportions", "background"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(rows), PREDICTED)


def in_known_language(
    docs: DataFrame, counts: dict[str, np.ndarray], least: float = 0.5, background: float = MOST_BACKGROUND
) -> DataFrame:
    """The rows of ``docs``, all columns, that a learned language explains.

    At most ``background`` of the text is explained by none, and the main language has ``least`` of
    the rest or more.
    """
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Mixture(counts) if counts else None
        for batch in pieces(batches, PIECE_BYTES):
            found = [model.predict(t) if model else NOTHING for t in batch.column(at).to_pylist()]
            kept = [n != UNKNOWN and b <= background and s * (1 - b) >= least for n, s, _, b in found]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(trimmed(rows), docs.schema)
