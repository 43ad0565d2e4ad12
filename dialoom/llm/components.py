"""Connected components by label propagation with pointer jumping, in DataFrame operations."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.session import delete_path, ensure_checkpoint_dir

#: Edges that a task joins to trees at a time.
EDGES = 1 << 18


def cut(df: DataFrame, merged: bool = True) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder: no lineage, and none of a plan's constraints, which grow from round to round.

    If ``merged``, its rows are dealt once more, in parts of the size that adaptive execution aims at, so that many tasks of few rows leave few files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.hint("rebalance") if merged else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """As ``cut``, dealt by ``key`` into ``n`` buckets or more, so that later groups and joins by ``key`` do not deal it again."""
    spark = df.sparkSession
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))  # with fewer, Spark would deal both sides of a join
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing that is still to run reads them."""
    for df in cuts:
        delete_path(df.sparkSession, df.cut_path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does when the driver collects its garbage; those of the last job only once another one has run."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): every node of ``edges`` with the least node of its component.

    Each round a node takes the least label among its neighbours, and then its label's label,
    so the rounds grow as the logarithm of the longest path. Nulls and loops are no edges;
    without edges there are no rows. Each round's table is written, so a lost executor repeats one round at most.
    Rows are two nodes wide; the joins that a hub or a giant component's label makes uneven have it on their left
    side, which adaptive execution splits.
    """
    there = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = cut(there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b", "left").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "m").alias("new"), labels["label"].alias("old"))
        top = labels.select(F.col("id").alias("new"), F.col("label").alias("up"))
        fresh = cut(step.join(top, "new", "left").select("id", F.least("new", "up").alias("label"), "old"))
        drop(labels)
        if fresh.where(F.col("label") != F.col("old")).limit(1).count() == 0:
            drop(both)
            return fresh.select("id", "label")
        labels = fresh


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b) and the least node of its component."""
    code, nodes = pd.factorize(np.concatenate([a, b]), sort=True)
    left, right, root = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while len(left):
        np.minimum.at(root, np.maximum(root[left], root[right]), np.minimum(root[left], root[right]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    return nodes, nodes[root]


def _trees(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (id, label) of ``roots`` for ``most`` edges of a task at a time."""
        held, size = [], 0
        for frame in batches:
            for at in range(0, len(frame), most):
                part = frame.iloc[at : at + most]
                if held and size + len(part) > most:
                    yield _tree(held)
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield _tree(held)

    return run


def _tree(held: list[pd.DataFrame]) -> pd.DataFrame:
    edges = pd.concat(held, ignore_index=True)
    nodes, root = roots(edges["a"].to_numpy(), edges["b"].to_numpy())
    return pd.DataFrame({"id": nodes, "label": root})


def joined_components(edges: DataFrame) -> DataFrame:
    """(id, label) as of ``connected_components``, out of a written table (a, b).

    Tasks first join EDGES edges each to trees, without a shuffle. Nodes of several trees link these trees' roots, and only such
    links, none if there is one tree's worth of edges, go through the rounds.
    """
    there = edges.select("a", "b").where("a is not null and b is not null and a != b")
    kind = edges.schema["a"].dataType.simpleString()
    parts = -(-edges.count() // EDGES)
    trees = cut(there.coalesce(max(1, parts)).mapInPandas(_trees(EDGES), f"id {kind}, label {kind}"), merged=False)
    if parts <= 1:
        return trees
    known = cut(trees.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("last")), merged=False)
    met = known.where("label != last").select("id", F.col("label").alias("a"))
    between = cut(trees.join(met, "id").select("a", F.col("label").alias("b")).where("a != b").distinct())
    upper = connected_components(between).select(F.col("id").alias("label"), F.col("label").alias("up"))
    out = cut(known.join(upper, "label", "left").select("id", F.coalesce("up", "label").alias("label")))
    drop(trees, known, between)
    return out
