"""Sorts, limits, top-k, seeded orders and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators.running import group_key, places


def top_one(df: DataFrame, keys: list[str], score: str, pos: str) -> DataFrame:
    """The row of highest score of each key, the first by ``pos`` of equals; partial aggregation, no sort."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(pos))).alias("_best"))
    return best.select("_best.*")


def _with_size(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with _rn, the place among the key's rows, and _n, their number; a key's rows are spread over tasks."""
    ranked = places(df, keys, order, "_rn").withColumn("_key", group_key(keys))
    sizes = df.groupBy(group_key(keys).alias("_of")).agg(F.count("*").alias("_n"))
    return ranked.join(sizes, F.col("_key") == F.col("_of")).drop("_key", "_of")


def share_of(df: DataFrame, keys: list[str], order: list[Column], ratio: float) -> DataFrame:
    """The first ceil(n ratio) rows of each key; with a ratio over 1 all rows, int(ratio) times."""
    if ratio > 1:
        return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(int(ratio)))))
    return _with_size(df, keys, order).where(F.col("_rn") <= F.ceil(F.col("_n") * F.lit(ratio))).drop("_rn", "_n").withColumn("copy", F.lit(1))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def seeded_key(ids: Column, seed: int = 42) -> Column:
    """A stable pseudo-random order: the md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ids.cast("string")))


def split_by_share(df: DataFrame, key: str, order: list[Column], share: float = 0.5, first: str = "val", rest: str = "test") -> DataFrame:
    """``df`` with split: of each key's rows in order the first int(share n) are ``first``."""
    return _with_size(df, [key], order).withColumn("split", F.when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(share)), first).otherwise(rest)).drop("_rn", "_n")


def global_row_number(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Rows with their place in the total order, without a window over the whole table."""
    return places(df, [], [F.col(c) for c in order], name)


def split_at(df: DataFrame, order: list[str], n: int, first: str = "train", rest: str = "val") -> DataFrame:
    """The first n rows in order are ``first``, the rest ``rest``."""
    return global_row_number(df, order).withColumn("split", F.when(F.col("row_no") <= n, first).otherwise(rest)).drop("row_no")


def sample_share(df: DataFrame, keys: list[str], rate: float, ids: Column, order: list[str]) -> DataFrame:
    """max(int(rate (n - 1)), 1) rows of each key, chosen by a seeded hash."""
    ranked = _with_size(df, keys, [seeded_key(ids), *[F.col(c) for c in order]])
    return ranked.where(F.col("_rn") <= F.greatest(F.floor((F.col("_n") - 1) * F.lit(rate)), F.lit(1))).drop("_rn", "_n")


def sample_rows(df: DataFrame, keys: list[str], n: int, ids: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(seeded_key(ids))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def strided(start: Column, end: Column, ratio: float) -> Column:
    """k = max(1, int(n ratio)) numbers of [start, end), max(1, n // k) apart."""
    n = end - start
    k = F.greatest(F.lit(1), F.floor(n * F.lit(ratio)).cast("int"))
    step = F.greatest(F.lit(1), F.floor(n / k).cast("int"))
    return F.when(n > 0, F.slice(F.sequence(start.cast("int"), (end - 1).cast("int"), step), F.lit(1), k)).otherwise(F.array().cast("array<int>"))


def up_to_time(df: DataFrame, keys: list[str], time: str, most: float) -> DataFrame:
    """Rows up to and with each key's first one at or after ``most``."""
    cut = df.groupBy(*keys).agg(F.min(F.when(F.col(time) >= most, F.col(time))).alias("_cut"))
    return df.join(cut, keys).where(F.col("_cut").isNull() | (F.col(time) <= F.col("_cut"))).drop("_cut")


def top_distinct(df: DataFrame, group: str, entity: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group, one for each entity."""
    best = df.withColumn("_e", F.row_number().over(Window.partitionBy(group, entity).orderBy(*order))).where("_e = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k).drop("_e")


def shard(df: DataFrame, key: str, order: list[str], rank: int, n: int) -> DataFrame:
    """Every n-th row of a key from ``rank`` on."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).where(F.pmod("_rn", F.lit(n)) == rank).drop("_rn")
