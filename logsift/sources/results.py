"""Writer of result tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Options with which Spark reads the CSV tables back.
CSV_READ = {"header": True, "escape": '"', "multiLine": True, "nullValue": "\\N"}


def flat_columns(table: DataFrame) -> DataFrame:
    """Arrays of known cells as JSON text, so that every format can hold the table."""
    columns = []
    for field in table.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "vectorudt":
            column = F.to_json(vector_to_array(column))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        columns.append(column.alias(field.name))
    return table.select(*columns)


def save_results(
    tables: dict[str, DataFrame],
    path: str,
    options: dict[str, object] | None = None,
    file_format: str = "csv",
    mode: str = "overwrite",
) -> None:
    """Write each named table under ``path/name`` and the options used under ``path/options``.

    ``csv`` has a header; a missing value is an empty field, an empty string a quoted one, and a
    quote inside a field is doubled. Line breaks stay in their quoted fields, which Spark reads
    back with ``CSV_READ`` and pandas or DuckDB as they are.
    """
    if not tables:
        return
    if file_format not in ("csv", "parquet"):
        raise ValueError(f"file_format must be 'csv' or 'parquet', got {file_format!r}")
    named = dict(tables)
    if options is not None:
        spark: SparkSession = next(iter(tables.values())).sparkSession
        rows = [(key, str(value)) for key, value in sorted(options.items())]
        named["options"] = spark.createDataFrame(rows, "name STRING, value STRING")
    for name, table in named.items():
        if file_format == "csv":
            writer = flat_columns(table).write.mode(mode)
            writer.options(header=True, escape='"').csv(f"{path}/{name}")
        else:
            table.write.mode(mode).parquet(f"{path}/{name}")
