"""Aggregations of dialogue statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.text import word_count


def vote_mode(df: DataFrame, keys: list[str], answer: str, pos: str) -> DataFrame:
    """The most frequent answer of each key, the first seen of equals."""
    counts = df.where(F.col(answer).isNotNull()).groupBy(*keys, answer).agg(F.count("*").alias("votes"), F.min(pos).alias("_first"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct(answer, "votes"), F.struct(F.col("votes"), -F.col("_first"))).alias("_b"), F.sum("votes").alias("n"))
    return best.select(*keys, f"_b.{answer}", "_b.votes", "n")


def label_of(text: Column) -> Column:
    return F.when(text.contains("1"), 1).when(text.contains("2"), 2).otherwise(0)


def label_counter(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A map of label to number for each key."""
    counts = df.groupBy(*keys, label_of(F.col(text)).alias("label")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))


def rollup_totals(df: DataFrame, levels: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates for all levels, each prefix of them, and the whole, with the number of levels summed over."""
    return df.rollup(*levels).agg(*aggregates, F.grouping_id().alias("level"))


def exploded_counts(df: DataFrame, keys: list[str], labels: str, separator: str = ",") -> DataFrame:
    return df.withColumn("label", F.explode(F.split(labels, separator))).withColumn("label", F.trim("label")).groupBy(*keys, "label").agg(F.count("*").alias("n"))


def talk_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Turns by role, talk and not_talk: every assistant turn talks, a frames turn of n frames is silent n - 1 times; and talk's share."""
    is_frames = F.col("role") == "frames"
    out = df.groupBy(*keys).agg(
        F.count_if(F.col("role") == "user").alias("user"),
        F.count_if(F.col("role") == "assistant").alias("talk"),
        F.coalesce(F.sum(F.when(is_frames, F.col("end") - F.col("start") - 1)), F.lit(0)).alias("not_talk"),
    )
    return out.withColumn("talk_ratio", F.try_divide(F.col("talk"), F.col("talk") + F.col("not_talk")))


def words_per_turn(df: DataFrame, keys: list[str], text: str, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    said = df.where(F.col("role").isin(*roles))
    return said.groupBy(*keys).agg(F.count("*").alias("turns"), F.sum(word_count(F.col(text))).cast("long").alias("words")).withColumn("words_per_turn", F.round(F.col("words") / F.col("turns"), 6))


def histogram(df: DataFrame, keys: list[str], value: Column, low: float, width: float, bins: int | None = None) -> DataFrame:
    """Numbers of values by bin of fixed width from ``low``; with ``bins``, values outside go, but the top end belongs to the last bin."""
    out = df.withColumn("_v", value)
    place = F.floor((F.col("_v") - low) / F.lit(width))
    if bins is not None:
        top = low + bins * width
        out = out.where((F.col("_v") >= low) & (F.col("_v") <= top))
        place = F.least(place, F.lit(bins - 1))
    return out.groupBy(*keys, place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def percent_histogram(df: DataFrame, part: Column, whole: Column) -> DataFrame:
    return df.where(whole > 0).groupBy(F.floor(100 * part / whole).cast("long").alias("percent")).agg(F.count("*").alias("n"))


def mean_interval(df: DataFrame, keys: list[str], order: list[str], time: str, is_talk: Column) -> DataFrame:
    """The mean gap between talking turns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    talk = df.where(is_talk).withColumn("_gap", F.col(time) - F.lag(time).over(w))
    return talk.groupBy(*keys).agg(F.round(F.avg("_gap"), 6).alias("mean_interval"), F.count("_gap").alias("n_gaps"))


def objects_text(df: DataFrame, key: str, noun: str, area: str) -> DataFrame:
    """Objects of an image, largest first, with numbers and plural where there are several, joined by commas."""
    counts = df.groupBy(key, noun).agg(F.count("*").alias("n"), F.max(area).alias("a"))
    part = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("a")).alias("o"), F.col(noun).alias("noun"), "n"))), lambda x: F.when(x["n"] > 1, F.concat(x["n"].cast("string"), F.lit(" "), x["noun"], F.when(x["noun"].endswith("s"), "").otherwise("s"))).otherwise(x["noun"]))
    return counts.groupBy(key).agg(F.array_join(part, ", ").alias("objects"))


def judge_means(df: DataFrame, keys: list[str], scores: list[str]) -> tuple[DataFrame, DataFrame]:
    """(Per sample the mean of each score over valid repeats, over all samples the mean of these); missing ones count nowhere."""
    per = df.groupBy(*keys).agg(*[F.avg(s).alias(s) for s in scores])
    return per, per.agg(*[F.avg(s).alias(s) for s in scores])


def offline_means(df: DataFrame, fps: float) -> DataFrame:
    return df.agg(F.avg("lm_ppl").alias("lm_ppl"), (F.avg(F.abs("frame_diff")) / fps).alias("time_diff"), F.avg("fluency").alias("fluency"), F.avg("token_acc").alias("token_acc"), F.avg(F.col("overflow").cast("int")).alias("overflow_ratio"))


def token_counts(df: DataFrame, tokens: str, image: int, eos: int) -> DataFrame:
    """Numbers of image, end and text tokens of each array, and the images' share."""
    of = lambda p: F.size(F.filter(tokens, p))
    out = df.withColumn("n_image", of(lambda t: t == image)).withColumn("n_eos", of(lambda t: t == eos))
    return out.withColumn("n_text", F.size(tokens) - F.col("n_image") - F.col("n_eos")).withColumn("image_ratio", F.try_divide(F.col("n_image"), F.size(tokens)))


def stream_summary(df: DataFrame, keys: list[str], frame: str, tokens: str) -> DataFrame:
    """Frames that generate or have a reference, and the first, last and longest context."""
    return df.groupBy(*keys).agg(F.count_if(F.col("gen") != "").alias("n_gen"), F.count_if(F.col("ref") != "").alias("n_ref"), F.min_by(tokens, frame).alias("first_len"), F.max_by(tokens, frame).alias("last_len"), F.max(tokens).alias("max_len"))


def confusion_with_tolerance(df: DataFrame, keys: list[str], frame: str, tolerance: int) -> DataFrame:
    """TP, FP, FN and TN of talking per key; a talk within ``tolerance`` frames of a reference's is right."""
    w = Window.partitionBy(*keys).orderBy(frame).rangeBetween(-tolerance, tolerance)
    out = df.withColumn("_g", (F.col("gen") != "").cast("int")).withColumn("_r", (F.col("ref") != "").cast("int"))
    out = out.withColumn("_near_r", F.max("_r").over(w)).withColumn("_near_g", F.max("_g").over(w))
    return out.groupBy(*keys).agg(
        F.count_if((F.col("_g") == 1) & (F.col("_near_r") == 1)).alias("tp"),
        F.count_if((F.col("_g") == 1) & (F.col("_near_r") == 0)).alias("fp"),
        F.count_if((F.col("_r") == 1) & (F.col("_near_g") == 0)).alias("fn"),
        F.count_if((F.col("_g") == 0) & (F.col("_r") == 0)).alias("tn"),
    )
