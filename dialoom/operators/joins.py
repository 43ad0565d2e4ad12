"""Joins of event, step and frame tables.

Interval, as-of and band joins all have an equality key or a bucket, so that they are hash or
sort-merge joins with a residual condition. Nothing is broadcast by name: Spark broadcasts a side whose size
it knows to be small, and AQE splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_OPTIONS = 1000


def required(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner join in which a key without a partner is an error."""
    held = dim.withColumn("_there", F.lit(True))
    joined = df.join(held, key, "left")
    lost = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"no {key} "), F.col(key).cast("string"))))
    return joined.withColumn("_there", F.coalesce(lost.cast("boolean"), F.col("_there"))).where("_there").drop("_there")


def collected(parent: DataFrame, child: DataFrame, key: str, items: list[str], order: list[str], name: str) -> DataFrame:
    """Each parent with its children as an ordered array of structs; parents without any go."""
    nested = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in items if c not in order]))).alias(name))
    return parent.join(nested, key)


def all_of(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key all tables have."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, key)
    return out


def first_match(left: DataFrame, right: DataFrame, on: list[str], pos: str, how: str = "left") -> DataFrame:
    """Each left row with the first right row, by ``pos``, of equal key."""
    rest = [c for c in right.columns if c not in on]
    first = right.groupBy(*on).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("_first"))
    return left.join(first, on, how).select(*left.columns, *[F.col(f"_first.{c}").alias(c) for c in rest])


#: A bucket of an interval join is between an eighth and a half of the intervals that it holds; each level's buckets are so many times wider than those of the one below.
_LEVELS = 4
#: Levels above this one are one.
_STEPS = 40


def _bucket_width(inner: DataFrame, start: Column, end: Column) -> float:
    """The width of the finest buckets: half of a short interval's length (the tenth percentile of those that have one); 0 if none has."""
    length = (end - start).cast("double")
    found = inner.select(length.alias("l")).where("l > 0").agg(F.percentile_approx("l", 0.1, 1000)).first()[0]
    return (found or 0.0) / 2


def _level(length: Column, width: float) -> Column:
    """The level of an interval: 0 up to 8 widths, then one more for each factor of 4."""
    return F.when(length <= 8 * width, 0).otherwise(F.least(F.ceil(F.log(float(_LEVELS), length / F.lit(8 * width))).cast("int"), F.lit(_STEPS)))


def _holding(points: DataFrame, spans: DataFrame, key: str, at: Column, start: Column, end: Column) -> DataFrame:
    """Pairs of a point and a span of one key with start <= at <= end, as (_p, _s) structs."""
    return _bucketed(points, spans, key, at, start, end).where("_at >= _a and _at <= _b")


def _bucketed(points: DataFrame, spans: DataFrame, key: str, at: Column, start: Column, end: Column) -> DataFrame:
    """The pairs that meet in a bucket.

    A span stands in all buckets that it touches at the level of its length, nine at most; a point in one bucket of each level in use. So of the
    pairs that meet in a bucket about two thirds are kept, however many spans a key has, and a hot key is spread over its buckets.
    """
    width = _bucket_width(spans, start, end)
    p = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_p"), F.col(key).alias("_k"), at.cast("double").alias("_at"))
    s = spans.select(F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("_s"), F.col(key).alias("_k"), start.cast("double").alias("_a"), end.cast("double").alias("_b")).where("_a <= _b")
    if not width:
        return p.withColumn("_a", F.col("_at")).join(s, ["_k", "_a"])  # no span has a length
    s = s.withColumn("_level", _level(F.col("_b") - F.col("_a"), width))
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())  # at most _STEPS + 1
    size = F.lit(width) * F.pow(F.lit(float(_LEVELS)), F.col("_level"))
    s = s.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size))))
    p = p.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_bucket", F.floor(F.col("_at") / size)) if levels else p.withColumn("_level", F.lit(0)).withColumn("_bucket", F.lit(0).cast("long"))
    return p.join(s, ["_k", "_level", "_bucket"])


def interval_contains(outer: DataFrame, inner: DataFrame, key: str, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of one key where ``at`` lies in [start, end], both ends included; ``outer`` has the points or ``inner`` has, whichever owns ``at``.

    Pairs meet in buckets of a width taken from the intervals' lengths, longer ones in coarser buckets. Times are numbers.
    """
    points, spans = (outer, inner) if at in outer.columns else (inner, outer)
    met = _holding(points, spans, key, F.col(at), F.col(start), F.col(end))
    rest = [c for c in inner.columns if c != key]
    mine, other = ("_p", "_s") if points is outer else ("_s", "_p")
    return met.select(F.col(f"{mine}.`{key}`").alias(key), *[F.col(f"{mine}.`{c}`").alias(c) for c in outer.columns if c != key], *[F.col(f"{other}.`{c}`").alias(c) for c in rest])


def interval_overlap(outer: DataFrame, inner: DataFrame, key: str, outer_span: tuple[str, str], inner_span: tuple[str, str]) -> DataFrame:
    """Every outer row with each inner row that meets it; outer rows without any stay.

    An inner interval meets if it starts inside [start, end), ends inside (start, end], or spans the whole; one without length meets at either end, one that ends before it starts nowhere.
    Two intervals that meet do so in one of two ways, each a join of points and intervals in buckets: the inner one starts inside the outer one, or the outer one inside the inner one, behind its start.
    """
    (s, e), (a, b) = (tuple(F.col(c) for c in span) for span in (outer_span, inner_span))
    inside = _holding(inner, outer, key, a, s, e).select(F.col("_s").alias("_o"), F.col("_p").alias("_i"))
    behind = _holding(outer, inner, key, s, a, b).select(F.col("_p").alias("_o"), F.col("_s").alias("_i"))

    def at(side: str, name: str) -> Column:
        return F.col(f"{side}.`{name}`")

    so, eo, ai, bi = at("_o", outer_span[0]), at("_o", outer_span[1]), at("_i", inner_span[0]), at("_i", inner_span[1])
    meets = ((ai >= so) & (ai < eo)) | ((bi > so) & (bi <= eo)) | ((ai < so) & (bi > eo))
    pairs = inside.unionByName(behind.where(ai < so)).where(meets & (ai <= bi) & (so <= eo))
    row = outer.select(F.struct(*[F.col(f"`{c}`") for c in outer.columns]).alias("_o"))
    alone = row.join(pairs.select(F.col("_o").alias("_met")).distinct(), F.col("_o").eqNullSafe(F.col("_met")), "left_anti")  # equal rows have equal partners
    both = pairs.unionByName(alone.select("_o", F.lit(None).cast(pairs.schema["_i"].dataType).alias("_i")))
    return both.select("_o.*", *[F.col(f"_i.`{c}`").alias(c) for c in inner.columns if c != key])


def attach_to_last(events: DataFrame, key: str, order: list[str], is_step: Column, name: str = "step_no") -> DataFrame:
    """Events that are no steps, each with the number of the latest step before it; those before the first step go."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("_is_step", is_step).withColumn(name, F.sum(F.col("_is_step").cast("int")).over(w))
    return numbered.where(~F.col("_is_step") & (F.col(name) > 0)).drop("_is_step")


def steps_with_substeps(events: DataFrame, key: str, order: list[str], is_step: Column, start: str, end: str) -> DataFrame:
    """Each step with its number, the number of events attached to it, and its end moved to the last one's start."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("_is_step", is_step).withColumn("step_no", F.sum(F.col("_is_step").cast("int")).over(w)).where("step_no > 0")
    return numbered.groupBy(key, "step_no").agg(
        F.max(F.when(F.col("_is_step"), F.col(start))).alias("step_start"),
        F.greatest(F.max(F.when(F.col("_is_step"), F.col(end))), F.max(F.when(~F.col("_is_step"), F.col(start)))).alias("step_end"),
        F.sum((~F.col("_is_step")).cast("long")).alias("num_substeps"),
    )


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it: one sort by key, no pairs."""
    names = left.columns
    a = left.withColumn("_side", F.lit(1)).withColumn("_row", F.struct(*names))
    b = right.select(key, at, F.lit(0).alias("_side"), F.struct(*values).alias("_value"))
    both = a.select(key, at, "_side", "_row").unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{v}").alias(f"last_{v}") for v in values])


def forward_bucket(narrations: DataFrame, key: str, frame: str, step: int, text: str) -> DataFrame:
    """Narrations at the first sampled frame after them, floor(t / step) + 1, joined in order; the last one of a key is never given."""
    w = Window.partitionBy(key).orderBy(frame, text)
    kept = narrations.withColumn("_next", F.lead(frame).over(w)).where(F.col("_next").isNotNull())
    placed = kept.withColumn("sample_idx", F.floor(F.col(frame) / step) + 1)
    return placed.groupBy(key, "sample_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(frame, text))), lambda x: x[text]), " ").alias("texts"), F.count("*").alias("n"))


def split_of(ids: DataFrame, key: str, membership: DataFrame, own: DataFrame) -> DataFrame:
    """Each id with its split: train if it is among its splits, else that of ``own``; others go. ``membership`` has (key, split)."""
    train = membership.groupBy(key).agg(F.max((F.col("split") == "train").cast("int")).alias("_train"))
    joined = ids.join(train, key, "left").join(own.select(key, F.col("split").alias("_own")), key, "left")
    return joined.withColumn("split", F.when(F.col("_train") == 1, "train").otherwise(F.col("_own"))).where(F.col("split").isNotNull()).drop("_train", "_own")


def val_or_test(df: DataFrame, info: DataFrame, key: str) -> DataFrame:
    return required(df, info.select(key, F.when(F.col("split") == "val", "val").otherwise("test").alias("split")), key)


def concat_groups(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Files with their group of files to join; only groups of several are kept. ``groups`` has (file, members)."""
    held = files.join(groups, "file", "left").withColumn("members", F.coalesce("members", F.array("file")))
    return held.where(F.size("members") > 1)


def with_existing(df: DataFrame, options: DataFrame, files: DataFrame, path: Column) -> DataFrame:
    """Every row with each option for which the file exists; ``options`` is exploded as a literal list, so no side is multiplied blindly. More than MOST_OPTIONS are an error."""
    values = [r[0] for r in options.limit(MOST_OPTIONS + 1).collect()]
    if len(values) > MOST_OPTIONS:
        raise ValueError(f"more than {MOST_OPTIONS} options")
    name = options.columns[0]
    there = files.select(F.col(files.columns[0]).alias("path"))
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values]))).withColumn("path", path).join(there, "path", "left_semi")


def band(left: DataFrame, right: DataFrame, key: str, i: str, j: str, low: int, high: int) -> DataFrame:
    """Pairs of one key with i + low <= j <= i + high, met in buckets of the band's width."""
    width = max(high - low, 1)
    a = left.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(i) + low) / width), F.floor((F.col(i) + high) / width))))
    b = right.withColumn("_bucket", F.floor(F.col(j) / width))
    return a.join(b, [key, "_bucket"]).where(F.col(j).between(F.col(i) + low, F.col(i) + high)).drop("_bucket")


def zipped(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row for each place of two arrays of equal order."""
    return df.select(*[c for c in df.columns if c not in (first, second)], F.posexplode(F.arrays_zip(first, second)).alias("pos", "_z")).select("*", f"_z.{first}", f"_z.{second}").drop("_z")


def frame_slice(samples: DataFrame, frames: DataFrame, key: str = "video_uid") -> DataFrame:
    """The frames [start, end) of each sample."""
    return samples.join(frames, key).where((F.col("frame_idx") >= F.col("start_frame_idx")) & (F.col("frame_idx") < F.col("end_frame_idx")))


def missed(refs: DataFrame, matched: DataFrame, on: list[str]) -> DataFrame:
    """References that say something and have no match."""
    return refs.where(F.col("ref") != "").join(matched.select(*on), on, "left_anti")
