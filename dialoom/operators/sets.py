"""Unions with repetition, differences and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_union(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """All parts' rows, those of each part as often as its factor says."""
    out = None
    for df, times in parts:
        own = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))) if times > 0 else df.limit(0).withColumn("copy", F.lit(1))
        out = own if out is None else out.unionByName(own)
    return out


def without_train(splits: Column) -> Column:
    """Splits without 'train' where val or test is among them."""
    return F.when(F.arrays_overlap(splits, F.array(F.lit("val"), F.lit("test"))), F.array_except(splits, F.array(F.lit("train")))).otherwise(splits)


def done_and_todo(work: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(Work with a result, work without one)."""
    ids = done.select(key).distinct()
    return work.join(ids, key, "left_semi"), work.join(ids, key, "left_anti")


def members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key).distinct(), key, "left_semi")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def with_each(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Every row with each of a list of labels, in a column of that name; an explode, not a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
