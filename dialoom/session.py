"""Session construction and the settings every operator relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "dialoom", cpus: str | int | None = None, shuffle: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow exchange switched on.

    The master and the number of shuffle partitions are the cluster's own unless ``cpus`` (or BENCH_CPUS) or ``shuffle`` is given.
    """
    cores = cpus or os.environ.get("BENCH_CPUS")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("DIALOOM_DRIVER_MEMORY", "8g"))
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; ``sf_dir`` may be any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names. Only a local session, whose tasks all run on this machine, may do without."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", "")
        if not configured and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or "/tmp/checkpoints/dialoom")
    found = context._jsc.sc().getCheckpointDir()
    return found.get()


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that this engine wrote, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, whatever reads it. ``discard`` deletes it, or else the end of the program."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written``, once nothing that is still to run reads them."""
    for df in tables:
        delete_path(df.sparkSession, df.cut_path)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Py4JError, OSError):  # the session may be gone
            delete_path(spark, path)


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """About how many bytes ``df`` reads: the sizes of its plan's sources, or, where a source has none, a count over ``column``."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if all(s < 1 << 60 for s in sizes):
        return sum(sizes)
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)
