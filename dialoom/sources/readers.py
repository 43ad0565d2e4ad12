"""Readers of annotation files as DataFrames, with explicit schemas and explicit positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str, schema: T.StructType, root: str | None = None) -> DataFrame:
    """Rows of a whole-file JSON list, or of the list under ``root``."""
    if root is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    outer = T.StructType([T.StructField(root, T.ArrayType(schema))])
    return spark.read.schema(outer).option("multiLine", True).json(path).select(F.explode(root).alias("_r")).select("_r.*")


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Line-delimited JSON; a broken line keeps its text in _corrupt_record."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]) if "_corrupt_record" not in schema.names else schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_directory(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record for each file, with the number that names the file."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.", 1).try_cast("long").alias("file_id"))


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def headerless(spark: SparkSession, path: str, schema: T.StructType, separator: str = "\t") -> DataFrame:
    return spark.read.schema(schema).option("header", False).option("sep", separator).csv(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not empty."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value != ''")


def tick_lines(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, text) of lines of tab-separated ticks of 100 ns and a text."""
    part = F.split(F.trim("value"), "\t")
    return spark.read.text(path).where("trim(value) != ''").select((F.get(part, F.lit(0)).try_cast("long") / 1e7).alias("start"), (F.get(part, F.lit(1)).try_cast("long") / 1e7).alias("end"), F.get(part, F.lit(2)).alias("text"))


def timing_pair(spark: SparkSession, path: str) -> DataFrame:
    """(file, duration) of files that hold a start and an end tick on two lines."""
    part = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("file"), ((F.get(part, F.lit(1)).try_cast("long") - F.get(part, F.lit(0)).try_cast("long")) / 1e7).alias("duration"))


def literal_list(column: str) -> Column:
    """An array column from a text such as ``['a', "it's"]``, in either kind of quotes; null if it is no list."""
    quoted = F.regexp_extract_all(column, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""), F.lit(0))
    plain = F.transform(quoted, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
    return F.when(F.trim(column).rlike(r"(?s)^\[.*\]$"), plain)


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """An Excel sheet, read on the driver; needs an Excel reader for pandas."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def frames(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A frame table (video_uid, frame_idx, ...), the rows [start, end) of it by a filter that reaches the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("frame_idx") >= start)
    return df if end is None else df.where(F.col("frame_idx") < end)


def checked_frames(frames_df: DataFrame, samples: DataFrame) -> DataFrame:
    """Frames of each sample; a sample that reaches beyond its video's frames is an error."""
    last = frames_df.groupBy("video_uid").agg((F.max("frame_idx") + 1).alias("_n"))
    sized = samples.join(last, "video_uid", "left")
    bad = F.when(F.col("_n").isNull() | (F.col("end_frame_idx") > F.col("_n")) | (F.col("start_frame_idx") < 0), F.raise_error(F.concat(F.lit("frames out of range in "), F.col("video_uid"))))
    sized = sized.withColumn("_ok", F.coalesce(bad.cast("boolean"), F.lit(True))).where("_ok").drop("_n", "_ok")
    return sized.join(frames_df, "video_uid").where("frame_idx >= start_frame_idx and frame_idx < end_frame_idx")


def sampled(frames_df: DataFrame, rate: float, fps: float) -> DataFrame:
    """Every step-th frame with its new number, step = int((int(rate) + 0.5) // fps)."""
    step = int((int(rate) + 0.5) // fps)
    return frames_df.where(F.col("frame_idx") % step == 0).withColumn("sample_idx", (F.col("frame_idx") / step).cast("long"))


def decode_videos(files: DataFrame, decode: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(path, frame_idx, frame) from binary files (path, content) and a decoder."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                images = decode(bytes(content))
                yield pd.DataFrame({"path": path, "frame_idx": range(len(images)), "frame": images})

    return files.select("path", "content").mapInPandas(run, "path string, frame_idx long, frame binary")


#: Listers of source files by data set: each takes (spark, root) and returns (path, output).
LISTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def lister(name: str, pattern: str, output: str = r"$1.parquet"):
    """Registers a lister for files that match a glob; the output's name is made from the file's stem."""

    def listed(spark: SparkSession, root: str) -> DataFrame:
        df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
        return df.select("path", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"^(.*)\.[^.]*$", output).alias("output"))

    LISTERS[name] = listed
    return listed


# The video files of each data set.
for _name, _glob in {"ego4d": "*.mp4", "epickitchens": "*.MP4", "holoassist": "Export_py*.mp4", "egoexolearn": "*.mp4", "wtag": "*.mp4", "assembly101": "*.mp4", "epfl": "*.mp4", "sthsth": "*.webm"}.items():
    lister(_name, _glob)


def resume(work: DataFrame, results: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(Done, to do): work with and without a readable result."""
    good = results.where(F.col("_corrupt_record").isNull()) if "_corrupt_record" in results.columns else results
    ids = good.select(key).distinct()
    return work.join(ids, key, "left_semi"), work.join(ids, key, "left_anti")
