"""Column helpers for cutting log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def token(tokens: Column, index: int | Column) -> Column:
    """Element by 0-based index, NULL past the end."""
    return F.get(tokens, F.lit(index) if isinstance(index, int) else index)


def count_of(text: Column, part: str) -> Column:
    """How often a one-character ``part`` occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def before(text: Column, part: str) -> Column:
    """The text up to the first ``part``, or all of it."""
    return F.split_part(text, F.lit(part), F.lit(1))


def rest_from(tokens: Column, start: Column | int) -> Column:
    """Tokens from 0-based ``start`` on."""
    begin = F.lit(start) if isinstance(start, int) else start
    return F.slice(tokens, begin + 1, F.greatest(F.size(tokens) - begin, F.lit(0)))


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def handle_malformed(
    df: DataFrame,
    good: Column,
    outputs: list[str],
    keep: list[str],
    mode: str,
    line: str = "value",
    wanted: Column | None = None,
) -> DataFrame:
    """Apply the malformed-line mode of the Spark readers to parsed ``outputs``.

    PERMISSIVE nulls the outputs and puts the line in ``_corrupt``, DROPMALFORMED
    removes the line, FAILFAST stops the job. Lines that are not ``wanted`` are removed
    in every mode.

    Rows are removed by a generator, not a filter: Catalyst would push a filter below the
    parsing and so parse every line twice.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    good = F.coalesce(good, F.lit(False))
    cells = F.array(F.struct(*[F.col(c) for c in outputs]))
    if mode == "DROPMALFORMED":
        keeps = good if wanted is None else good & wanted
        return df.select(*keep, F.inline(F.when(keeps, cells)))
    if mode == "FAILFAST":
        message = F.concat(F.lit("malformed log line: "), F.coalesce(F.col(line), F.lit("NULL")))
        rows = F.when(good, cells).otherwise(F.raise_error(message))
        return df.select(*keep, F.inline(rows if wanted is None else F.when(wanted, rows)))
    checked = df.withColumn("_good", good)
    earlier = F.col("_corrupt") if "_corrupt" in df.columns else F.lit(None).cast("string")
    columns = [
        *[F.when(F.col("_good"), F.col(c)).alias(c) for c in outputs],
        F.coalesce(earlier, F.when(~F.col("_good"), F.col(line))).alias("_corrupt"),
    ]
    keep = [c for c in keep if c != "_corrupt"]
    if wanted is None:
        return checked.select(*keep, *columns)
    return checked.select(*keep, F.inline(F.when(wanted, F.array(F.struct(*columns)))))
