"""Running totals and places inside groups of any size, in total order, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.session import written

_GROUP, _WEIGHT, _SALT, _PART, _LOCAL = (f"_running_{x}" for x in ("group", "weight", "salt", "part", "local"))


def _changes(keys: pa.Array) -> np.ndarray:
    """Places, but the first, at which another group begins; null is one group."""
    a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
    differ = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.not_equal(a.is_null(), b.is_null()), pc.not_equal(a, b))
    return np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1


def _local_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's running totals: rows come sorted, and a group's total goes on from batch to batch."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(_GROUP)
        at = _changes(keys)
        sums = np.cumsum(batch.column(_WEIGHT).to_numpy(zero_copy_only=False))
        before = np.zeros(len(sums), np.int64)
        before[at] = sums[at - 1]
        out = sums - np.maximum.accumulate(before)
        if last is not None and last[0] == keys[0].as_py():
            out[: at[0] if len(at) else len(out)] += total
        last, total = (keys[-1].as_py(),), int(out[-1])
        yield batch.append_column(_LOCAL, pa.array(out, pa.int64()))


def running_total(df: DataFrame, group: Column, order: list[Column], weight: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``name``: the sum of ``weight`` over the group's rows up to and with this one; the table that it reads, for ``discard``).

    Rows are dealt by ranges of (group, order), so a group of any size spans as many tasks as it needs; each
    task sums its own rows, and the tasks' sums for each group, one row for each pair that meets, give the
    offsets. The ranges are drawn once: rows are written with their task's number. Null is one group; rows equal in ``order``
    are numbered as they come, so they must be alike to the caller. ``weight`` is a whole number of at least 0; ``group`` a plain value.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    given = df.withColumns({_GROUP: group, _WEIGHT: weight.cast("long"), _SALT: F.monotonically_increasing_id()})
    by = [_GROUP, *order, _SALT]
    ranged = given.repartitionByRange(n, *by).sortWithinPartitions(*by).drop(_SALT).withColumn(_PART, F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField(_LOCAL, T.LongType())])
    table = written(ranged.mapInArrow(_local_totals, schema))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy(F.col(_PART).alias("_p"), F.col(_GROUP).alias("_g")).agg(F.sum(_WEIGHT).alias("_s"))
    offsets = sums.select("_p", "_g", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_running_offset"))
    met = table.join(offsets, (F.col(_PART) == F.col("_p")) & F.col(_GROUP).eqNullSafe(F.col("_g")))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(_LOCAL) + F.col("_running_offset")).alias(name)), table


def group_key(keys: list[str]) -> Column:
    """One plain value for several keys, nulls among them."""
    return F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"})


def places(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 1 on, among its key's rows in order."""
    return running_total(df, group_key(keys) if keys else F.lit(0), order, F.lit(1), name)[0]
