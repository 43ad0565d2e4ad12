"""Writers of results."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.sources.named_files import NAME, NamedFiles


def json_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each split; excluded records keep their reason_to_exclude."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def columnar(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def named_files(df: DataFrame, path: str, file: Column, order: list[str], kind: str, **options: str) -> None:
    """One file for each value of ``file``, a path under ``path``, its rows in order; all files are there or none.

    ``path`` is on a file system that all workers share. A file's rows pass through one task as a stream.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    ready = df.withColumn(NAME, file).repartition(NAME).sortWithinPartitions(NAME, *order)
    writer = ready.write.format("named_files").mode("overwrite").option("path", path).option("kind", kind)
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.save()


def json_per_key(df: DataFrame, path: str, key: str, order: list[str], value: str | None = None, head: dict[str, Any] | None = None, under: str | None = None) -> None:
    """``<key>.json`` for each key: the list of its records in order, or an object of ``head`` that holds the list ``under`` a name.

    With ``value`` the records are that column's JSON texts. A slash in a key is written as %2F.
    """
    options = {"head": json.dumps(head or {}), **({"under": under} if under else {}), **({"value": value} if value else {})}
    safe = F.replace(F.replace(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    named_files(df, path, F.concat(safe, F.lit(".json")), order, "json", **options)


def grouped_files(df: DataFrame, path: str, key: str, order: list[str], rows: int, prefix: str = "", kind: str = "arrow") -> None:
    """Files of ``rows`` rows of one key in order, ``<key>/<prefix>000000.<kind>`` and on; the last of a key has the rest."""
    named_files(file_groups(df, key, order, rows, prefix), path, F.concat(F.col(key).cast("string"), F.lit("/"), F.col("file_id"), F.lit(f".{kind}")), order, kind)


def file_groups(df: DataFrame, key: str, order: list[str], rows: int, prefix: str) -> DataFrame:
    """``df`` with the name of the file of ``rows`` rows that each row goes to."""
    from dialoom.operators.windows import fixed_groups

    out = fixed_groups(df, [key], order, rows, "_file")
    return out.withColumn("file_id", F.concat(F.lit(prefix), F.lpad(F.col("_file").cast("string"), 6, "0"))).drop("_file")


def metrics(df: DataFrame, path: str) -> None:
    """A one-row table of metrics as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
