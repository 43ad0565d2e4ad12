"""Filters and projections of annotation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_listed(df: DataFrame, column: str, listed: DataFrame, strip_prefix: str = "") -> DataFrame:
    """Rows whose id is not in the one column of ``listed``; a prefix is stripped before comparing."""
    ids = listed.select(F.col(listed.columns[0]).alias("_listed")).distinct()
    own = F.when(F.col(column).startswith(strip_prefix), F.substring(F.col(column), len(strip_prefix) + 1, 1_000_000)).otherwise(F.col(column)) if strip_prefix else F.col(column)
    return df.join(ids, own == F.col("_listed"), "left_anti")


def contains_any(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(column).contains(p) for p in parts]))


def starts_with_any(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in parts]))


def keep_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def not_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose value differs; nulls differ from every value."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def not_among(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def essential(df: DataFrame, column: str = "is_relevant") -> DataFrame:
    """Rows marked essential; a missing mark is unknown and goes."""
    return df.where(F.coalesce(F.col(column), F.lit("unk")) == "essential")


def coverage(steps: DataFrame, keys: list[str], start: str, end: str, duration: str) -> DataFrame:
    """Per key, the share of the duration that its steps cover; null where the duration is 0."""
    return steps.groupBy(*keys).agg(F.try_divide(F.sum(F.col(end) - F.col(start)), F.max(duration)).alias("ann_ratio"), F.count("*").alias("num_steps"))


def gate_ratio(df: DataFrame, least: float = 0.5) -> DataFrame:
    """All rows with reason_to_exclude: null for those that go on."""
    low = F.coalesce(F.col("ann_ratio") < least, F.lit(True))
    return df.withColumn("reason_to_exclude", F.when(low, F.concat(F.lit("ann_ratio below "), F.lit(str(least)))))


def by_votes(votes: DataFrame, key: str, label: str, pos: str, wanted: int = 1) -> DataFrame:
    """Keys whose most frequent label, the first seen of equals, is ``wanted`` with at least floor(n / 2) votes."""
    counts = votes.groupBy(key, label).agg(F.count("*").alias("cnt"), F.min(pos).alias("first_pos"))
    total = counts.groupBy(key).agg(F.sum("cnt").alias("n"), F.max_by(F.struct(F.col(label).alias("top"), "cnt"), F.struct(F.col("cnt"), -F.col("first_pos"))).alias("best"))
    return total.where((F.col("best.top") == wanted) & (F.col("best.cnt") >= F.floor(F.col("n") / 2))).select(key, F.col("best.cnt").alias("votes"), "n")


def turns_before(turns: Column, end: Column) -> Column:
    """The turns of an array that are not after ``end``."""
    return F.filter(turns, lambda t: t["time"] <= end)


def in_centre(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes (x, y, w, h) that are not wholly outside the central square of their image (width, height)."""
    side = F.least("width", "height") * F.lit(share)
    x0, x1 = (F.col("width") - side) / 2, (F.col("width") + side) / 2
    y0, y1 = (F.col("height") - side) / 2, (F.col("height") + side) / 2
    outside = (F.col("x") + F.col("w") < x0) | (F.col("x") > x1) | (F.col("y") + F.col("h") < y0) | (F.col("y") > y1)
    return df.where(~outside)


def at_least(df: DataFrame, score: str, least: float) -> DataFrame:
    return df.where(F.col(score) >= least)


def complete_types(df: DataFrame, key: str, kind: str, n: int) -> DataFrame:
    """Rows of keys that have ``n`` kinds."""
    full = df.groupBy(key).agg(F.count_distinct(kind).alias("_kinds")).where(F.col("_kinds") == n).select(key)
    return df.join(full, key, "left_semi")


def having_frames(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return df.join(manifest.select(key).distinct(), key, "left_semi")


def without_empty_reference(df: DataFrame, refs: str) -> DataFrame:
    """Pairs none of whose tokenised references is empty."""
    return df.where(~F.exists(F.col(refs), lambda r: F.length(r) == 0))


def within_summary_budget(df: DataFrame, tokens: str, most: int = 768) -> DataFrame:
    return df.where(F.col(tokens) <= most)


def domain_of(scene: Column) -> Column:
    return F.when(scene == "kitchen", "cooking").otherwise("lab")


def row_limit_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
