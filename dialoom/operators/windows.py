"""Order-dependent operators: every one is partitioned by a key, so no window spans the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _so_far(keys: list[str], order: list[str]) -> Window:
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def unanswered(df: DataFrame, keys: list[str], order: list[str], asks: Column, answers: Column, time: str, within: float) -> DataFrame:
    """``df`` with unanswered: a question whose next row is no answer or comes later than ``within``; a key's last row never counts."""
    w = _w(keys, order)
    out = df.withColumn("_answers", answers)
    late = ~F.lead("_answers").over(w) | (F.lead(time).over(w) - F.col(time) > within)
    return out.withColumn("unanswered", asks & F.lead(time).over(w).isNotNull() & late).drop("_answers")


def gaps(df: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    return df.withColumn("gap", F.col(time) - F.lag(time).over(_w(keys, order)))


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    previous = F.lag(value).over(_w(keys, order))
    first = F.row_number().over(_w(keys, order)) == 1
    return df.withColumn("_new", first | ~F.col(value).eqNullSafe(previous)).where("_new").drop("_new")


def islands(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str = "run_no") -> DataFrame:
    """``df`` with the number of the run of equal values that each row is in, from 1."""
    w = _w(keys, order)
    change = F.row_number().over(w) == 1
    for v in values:
        change = change | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    return df.withColumn("_change", change.cast("int")).withColumn(name, F.sum("_change").over(_so_far(keys, order))).drop("_change")


def merge_runs(df: DataFrame, keys: list[str], order: list[str], values: list[str], item: str, separator: str) -> DataFrame:
    """One row for each run of equal values, its items joined in order."""
    runs = islands(df, keys, order, values)
    place = F.struct(*order, F.col(item).alias("_item"))
    out = runs.groupBy(*keys, "run_no", *values).agg(F.sort_array(F.collect_list(place)).alias("_all"), F.count("*").alias("n"))
    return out.withColumn("items", F.array_join(F.transform("_all", lambda x: x["_item"].cast("string")), separator)).drop("_all")


def first_in_group(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each value once for each group, where it is first."""
    return df.withColumn("_rn", F.row_number().over(_w([*keys, value], order))).where("_rn = 1").drop("_rn")


def greedy_groups(df: DataFrame, keys: list[str], order: list[str], size: str, most: int, name: str = "clip_id") -> DataFrame:
    """Rows with the number of their clip: sizes add up in order, and a clip ends with the row that takes the sum over ``most``.

    One fold over each key's ordered sizes; a key's rows are gathered, other keys' are not touched.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("id"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, row: Column) -> Column:
        total = acc["sum"] + row[size].cast("long")
        full = total > most
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(total).alias("sum"), F.when(full, acc["id"] + 1).otherwise(acc["id"]).alias("id"), F.concat(acc["ids"], F.array(acc["id"])).alias("ids"))

    ids = rows.withColumn("_ids", F.aggregate("_rows", start, step, lambda a: a["ids"]))
    flat = ids.select(*keys, F.explode(F.arrays_zip("_rows", "_ids")).alias("_z"))
    return flat.select(*keys, *[F.col(f"_z._rows.{c}").alias(c) for c in rest], F.col("_z._ids").alias(name))


def fixed_groups(df: DataFrame, keys: list[str], order: list[str], n: int, name: str = "clip_id") -> DataFrame:
    return df.withColumn(name, F.floor((F.row_number().over(_w(keys, order)) - 1) / n).cast("int"))


def with_context(df: DataFrame, keys: list[str], order: list[str], n: int, text: str, before: int = 5, after: int = 4) -> DataFrame:
    """One row for each clip of n rows, with the texts from ``before`` rows ahead of it to ``after`` rows behind."""
    numbered = df.withColumn("_rn", F.row_number().over(_w(keys, order)))
    around = numbered.select(*keys, "_rn", F.col(text).alias("_text"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    spread = around.withColumn("clip_id", F.explode(F.sequence(F.greatest(F.floor((F.col("_rn") - 1 - after) / n), F.lit(0)), F.floor((F.col("_rn") - 1 + before) / n))))
    kept = spread.where((F.col("clip_id") * n < F.col("_n")) & F.col("_rn").between(F.col("clip_id") * n + 1 - before, F.least((F.col("clip_id") + 1) * n, F.col("_n")) + after))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_text"))), lambda x: x["_text"])
    return kept.groupBy(*keys, F.col("clip_id").cast("int").alias("clip_id")).agg(F.array_join(lines, "\n").alias("description"), F.count("*").alias("n_lines"))


def frame_positions(df: DataFrame, keys: list[str], order: list[str], time: str, fps: float, length: str, offset: str | None = None) -> DataFrame:
    """Rows with their frame numbers, strictly rising and cut off at the length: start and end of the frames before each row.

    f_k = max(s + k, k + max over j <= k of (raw_j - j)) with raw_j = min(floor(t_j fps), length - 1), s the first frame; rows with f_k >= length go.
    """
    first = F.floor(F.col(offset) * fps) if offset else F.lit(0).cast("long")
    k = F.row_number().over(_w(keys, order))
    out = df.withColumn("_s", first).withColumn("_k", k).withColumn("_raw", F.least(F.floor(F.col(time) * fps), F.col(length) - 1))
    out = out.withColumn("frame_end", F.greatest(F.col("_s") + F.col("_k"), F.col("_k") + F.max(F.col("_raw") - F.col("_k")).over(_so_far(keys, order))))
    out = out.where(F.col("frame_end") < F.col(length))
    return out.withColumn("frame_start", F.coalesce(F.lag("frame_end").over(_w(keys, order)), F.col("_s"))).drop("_s", "_k", "_raw")


def framed(df: DataFrame, keys: list[str], order: list[str], time: str, fps: float, length: str, offset: str | None = None, knowledge: Column | None = None) -> DataFrame:
    """Timed turns (role, content) as conversations of frames: (keys, pos, role, content, start, end).

    Before each turn stands the frames turn that leads to it; with ``knowledge``, a system turn with it follows the first user turn. Turns beyond the last frame go.
    """
    placed = frame_positions(df, keys, order, time, fps, length, offset)
    shown = F.struct(F.lit("frames").alias("role"), F.lit(None).cast("string").alias("content"), F.col("frame_start").alias("start"), F.col("frame_end").alias("end"))
    said = lambda role, text: F.struct(role.alias("role"), text.alias("content"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    parts = F.array(shown, said(F.col("role"), F.col("content")))
    if knowledge is not None:
        first = (F.col("role") == "user") & (F.sum((F.col("role") == "user").cast("int")).over(_so_far(keys, order)) == 1)
        parts = F.when(first & (knowledge != ""), F.concat(parts, F.array(said(F.lit("system"), knowledge)))).otherwise(parts)
    out = placed.withColumn("_parts", parts).select(*keys, *order, F.posexplode("_parts").alias("_part", "_turn"))
    return out.select(*keys, F.row_number().over(_w(keys, [*order, "_part"])).alias("pos"), "_turn.*")


def insert_after_first(df: DataFrame, keys: list[str], order: list[str], role: str, wanted: str, new_role: str, pos: str = "pos") -> DataFrame:
    """Rows numbered anew, with a row of ``new_role`` after each key's first row of the wanted role."""
    seen = F.sum((F.col(role) == wanted).cast("int")).over(_so_far(keys, order))
    marked = df.withColumn("_first", (F.col(role) == wanted) & (seen == 1)).withColumn("_rn", F.row_number().over(_w(keys, order)))
    own = marked.withColumn("_part", F.explode(F.when(F.col("_first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    out = own.withColumn(role, F.when(F.col("_part") == 1, F.lit(new_role)).otherwise(F.col(role)))
    return out.withColumn(pos, F.row_number().over(_w(keys, ["_rn", "_part"]))).drop("_first", "_rn", "_part")


def last_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the last value that is not null up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_so_far(keys, order)))


def head_and_tail(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first and the last k / 2 rows of each key."""
    half = k // 2
    out = df.withColumn("_rn", F.row_number().over(_w(keys, order))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return out.where((F.col("_rn") <= half) | (F.col("_rn") > F.col("_n") - half)).drop("_rn", "_n")


def row_index(df: DataFrame, keys: list[str], order: list[str], fps: float = 2.0) -> DataFrame:
    """The running frame number from 0 and its time (n + 1) / fps."""
    out = df.withColumn("frame_no", F.row_number().over(_w(keys, order)) - 1)
    return out.withColumn("stream_time", (F.col("frame_no") + 1) / fps)


def merge_frame_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Turns without the assistant's, neighbouring frames turns as one: (role, start, end, n)."""
    kept = df.where(F.col("role") != "assistant")
    w = _w(keys, order)
    joined = (F.col("role") == "frames") & F.coalesce(F.lag("role").over(w) == "frames", F.lit(False))
    runs = kept.withColumn("_new", (~joined).cast("int")).withColumn("run_no", F.sum("_new").over(_so_far(keys, order)))
    return runs.groupBy(*keys, "run_no").agg(F.min_by("role", F.struct(*order)).alias("role"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def talk_drop(df: DataFrame, keys: list[str], order: list[str], probability: str, threshold: float, middle: float = 0.5) -> DataFrame:
    """``df`` with talk: the silence probability fell by more than the threshold since the row before, or is at most ``middle``, which alone decides a key's first row."""
    before = F.lag(probability).over(_w(keys, order))
    fell = F.coalesce(before - F.col(probability) > threshold, F.lit(False))
    return df.withColumn("talk", fell | (F.col(probability) <= middle))


def start_offset(df: DataFrame, keys: list[str], start: str, end: str, lead: float = 2.0) -> DataFrame:
    """Where a video starts, ``lead`` before its first step and not below 0, and how long its steps last."""
    return df.groupBy(*keys).agg(F.greatest(F.min(start) - lead, F.lit(0.0)).alias("video_start_time"), (F.max(end) - F.min(start)).alias("duration"))


def prefixes(df: DataFrame, keys: list[str], order: list[str], is_target: Column, item: str) -> DataFrame:
    """Each target row with all items up to it, in order."""
    w = _so_far(keys, order)
    return df.withColumn("_target", is_target).withColumn("history", F.collect_list(item).over(w)).where("_target").drop("_target")
