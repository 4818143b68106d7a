"""Arithmetic over a fixed list of columns, kept as plain code-generated expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def squared_norm(columns: list[Column]) -> Column:
    return total([c * c for c in columns])


def squared_distance(left: list[Column], right: list[Column]) -> Column:
    return total([(a - b) * (a - b) for a, b in zip(left, right)])


def dot(left: list[Column], right: list[Column]) -> Column:
    return total([a * b for a, b in zip(left, right)])


def literals(values) -> list[Column]:
    return [F.lit(float(v)) for v in values]
