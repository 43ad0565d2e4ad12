"""Annotated recordings as steps with substeps and clips: parsers by data set, each a set of rules over flat events.

A parser takes DataFrames of raw events and gives (video_uid, steps, description, clips, num_steps, num_substeps, annotated). All
share one plan: events in order of their start are cut into sessions, a step with what follows it; each
session's rows become one step with its substeps; and a fold over a video's steps closes a clip when its lines exceed a number. What differs is
in ``Rules``. Work is by video, its events in one sorted array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text as tx
from dialoom.operators import joins

#: Events: video_uid, seq (place of equal starts), start, end, is_step, line (a step's text without its times; a substep's whole line), key (of equal substeps of a step, only the first stays; null: all stay).
EVENT = ("video_uid", "seq", "start", "end", "is_step", "line", "key")


@dataclass(frozen=True)
class Rules:
    """How a data set's events make steps and clips.

    ``moves_end``: a step ends at the start of its last substep if that is later. ``last_keeps``: the last step keeps its substeps. ``counts_substeps``: a clip's lines
    include substeps but the first of each step. ``whole``: a clip's text lists all steps of the video, with substeps of those inside the clip. ``tail``: a text behind the steps, by video.
    """

    domain: str
    knowledge: str
    most_lines: int = 6
    moves_end: bool = False
    last_keeps: bool = True
    counts_substeps: bool = False
    whole: bool = True


def steps_of(events: DataFrame, rules: Rules) -> DataFrame:
    """(video_uid, steps) of events: an array of (start, end, step, substeps) in order; what stands before the first step goes."""
    w = Window.partitionBy("video_uid").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("_no", F.sum(F.col("is_step").cast("int")).over(w)).where("_no > 0")
    first = F.row_number().over(Window.partitionBy("video_uid", "_no", "key").orderBy("start", "seq"))
    kept = numbered.withColumn("_k", first).where(F.col("is_step") | F.col("key").isNull() | (F.col("_k") == 1))
    sub = F.when(~F.col("is_step"), F.struct("start", "seq", "line"))
    own = lambda c: F.max(F.when(F.col("is_step"), F.col(c)))
    steps = kept.groupBy("video_uid", "_no").agg(own("start").alias("start"), own("end").alias("end"), own("line").alias("line"), F.sort_array(F.collect_list(sub)).alias("subs"))
    if rules.moves_end:
        steps = steps.withColumn("end", F.greatest("end", F.array_max(F.transform("subs", lambda x: x["start"]))))
    one = F.struct(F.col("_no").alias("no"), "start", "end", tx.step_line(F.col("start"), F.col("end"), F.col("line")).alias("step"), F.transform("subs", lambda x: x["line"]).alias("substeps"))
    by_video = steps.groupBy("video_uid").agg(F.sort_array(F.collect_list(one)).alias("steps"))
    if not rules.last_keeps:
        by_video = by_video.withColumn("steps", F.transform("steps", lambda x, i: F.when(i == F.size("steps") - 1, x.withField("substeps", F.array().cast("array<string>"))).otherwise(x)))
    return by_video


def told(steps: Column, inside: Callable[[Column], Column] | None = None) -> Column:
    """Steps and substeps as lines, substeps only of the steps that ``inside`` holds for."""

    def lines(x: Column) -> Column:
        subs = x["substeps"] if inside is None else F.when(inside(x), x["substeps"]).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(x["step"]), subs)

    return F.array_join(F.transform(F.flatten(F.transform(steps, lines)), lambda x: F.concat(x, F.lit("\n"))), "")


def with_clips(videos: DataFrame, rules: Rules, tail: Column | None = None) -> DataFrame:
    """``videos`` with description, clips (start, end, description), num_steps and num_substeps.

    A clip takes steps until its lines exceed ``most_lines``, with the one that does so, or the video ends; it ends where its last step does.
    """
    end = F.lit("") if tail is None else tail
    size = lambda x: F.lit(1) + (F.greatest(F.size(x["substeps"]) - 1, F.lit(0)) if rules.counts_substeps else F.lit(0))
    zero = F.struct(F.lit(0).alias("lines"), F.lit(-1).alias("first"), F.array().cast("array<struct<a: int, b: int>>").alias("cuts"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        lines = acc["lines"] + size(x)
        first = F.when(acc["first"] < 0, acc["i"]).otherwise(acc["first"])
        closes = (lines > rules.most_lines) | (acc["i"] == F.size("steps") - 1)
        cut = F.array(F.struct(first.alias("a"), acc["i"].alias("b")))
        return F.struct(F.when(closes, 0).otherwise(lines).alias("lines"), F.when(closes, -1).otherwise(first).alias("first"), F.when(closes, F.concat(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"), (acc["i"] + 1).alias("i"))

    cuts = F.aggregate("steps", zero, step, lambda acc: acc["cuts"])

    def clip(c: Column) -> Column:
        a, b = F.get("steps", c["a"])["start"], F.get("steps", c["b"])["end"]
        text = F.concat(told(F.col("steps"), lambda x: (x["start"] >= a) & (x["end"] <= b)), end) if rules.whole else F.trim(told(F.slice("steps", c["a"] + 1, c["b"] - c["a"] + 1)), F.lit(" \n"))
        return F.struct(a.alias("start"), b.alias("end"), text.alias("description"))

    return videos.withColumn("_cuts", cuts).select(
        *videos.columns,
        F.concat(told(F.col("steps")), end).alias("description"),
        F.transform("_cuts", clip).alias("clips"),
        F.size("steps").alias("num_steps"),
        F.aggregate("steps", F.lit(0), lambda acc, x: acc + F.size(x["substeps"])).alias("num_substeps"),
        F.lit(rules.domain).alias("domain"),
        F.lit(rules.knowledge).alias("knowledge_type"),
    )


# Domains and kinds of knowledge of the data sets, and their clips' numbers of lines.
TIMED = Rules("cooking", "cooking recipe", moves_end=True)
HOLO = Rules("object manipulation", "operation manual", last_keeps=False, counts_substeps=True)
ACTIVITY = Rules("cooking", "cooking recipe", most_lines=20, whole=False)


def parse_timed(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Recordings of tick lines: (video_uid, seq, role, start, end, text) in seconds; role '' is a step, else a speaker.

    A speaker's line stands at its middle. Nothing before the end of the first line 'start' counts; an entry for the start, in the middle of that time, comes first. A text with a colon is a substep.
    """
    speaks = F.col("role") != ""
    e = lines.withColumn("start", F.when(speaks, (F.col("start") + F.col("end")) / 2).otherwise(F.col("start"))).withColumn("text", F.when(speaks, F.concat("role", F.lit(': "'), "text", F.lit('"'))).otherwise(F.col("text")))
    first = F.min_by("end", F.struct("start", "seq"))
    begun = e.where(F.lower("text") == "start").groupBy("video_uid").agg(first.alias("_begin"))
    known = e.join(begun, "video_uid", "left").withColumn("_begin", F.coalesce("_begin", F.lit(0.0))).where(F.col("start") >= F.col("_begin"))
    step = ~F.col("text").contains(":")
    sub = F.concat(F.lit("- ["), tx.one_digit(F.col("start")), F.lit("s] "), F.col("text"))
    events = known.select("video_uid", "seq", "start", "end", step.alias("is_step"), F.when(step, F.col("text")).otherwise(sub).alias("line"), F.lit(None).cast("string").alias("key"))
    lasts = known.where(step).groupBy("video_uid").agg(F.sum(F.col("end") - F.col("start")).alias("annotated"))
    videos = steps_of(events, TIMED)
    all_videos = e.select("video_uid").distinct().join(begun, "video_uid", "left").join(videos, "video_uid", "left").join(lasts, "video_uid", "left")
    begin = F.coalesce("_begin", F.lit(0.0))
    dummy = F.struct(F.lit(0).cast("long").alias("no"), (begin / 2).alias("start"), begin.alias("end"), F.concat(F.lit("- ["), tx.one_digit(begin / 2), F.lit("s] start")).alias("step"), F.array().cast("array<string>").alias("substeps"))
    joined = all_videos.withColumn("steps", F.concat(F.array(dummy), F.coalesce("steps", F.array().cast(videos.schema["steps"].dataType)))).drop("_begin")
    return with_clips(joined, TIMED).join(durations, "video_uid", "left").withColumn("ann_ratio", F.try_divide(F.coalesce("annotated", F.lit(0.0)), F.col("duration")))


def parse_attributed(events: DataFrame, durations: DataFrame) -> DataFrame:
    """Recordings of events with attributes: (video_uid, seq, start, end, attributes map).

    An action sentence is a step; a conversation stands at its middle and is a substep unless its words are none; a fine action is one unless its verb is passive or the step has it already, with the reason if it is an error.
    Substeps after the last step, and before the first, are lost. The long description is the summary behind the steps.
    """
    a = lambda name: F.try_element_at("attributes", F.lit(name))
    has = lambda name: F.map_contains_key("attributes", name)
    e = events.withColumn("start", F.when(has("Conversation Purpose"), (F.col("start") + F.col("end")) / 2).otherwise(F.col("start")))
    kind = F.when(has("Action sentence"), "step").when(has("Conversation Purpose"), "said").when(has("Action Correctness"), "action")
    role = F.when(F.split_part(a("Conversation Purpose"), F.lit("-"), F.lit(1)) == "student", "user").otherwise("assistant")
    said = F.concat(F.lit(" - ["), tx.one_digit(F.col("start")), F.lit("s] "), role, F.lit(': "'), tx.normalised(a("Transcription")), F.lit('"'))
    more = F.coalesce(a("Adjective"), F.lit(""))
    action = F.concat(tx.normalised(a("Verb")), F.lit(" "), F.when(more.isin("none", "wrong", ""), "").otherwise(F.concat(more, F.lit(" "))), tx.normalised(a("Noun")))
    error = F.when(a("Action Correctness") == "Correct Action", "").otherwise(F.concat(F.lit(" (ERROR: "), tx.normalised(F.coalesce(a("Incorrect Action Explanation"), F.lit("none"))), F.lit(")")))
    done = F.concat(F.lit(" - ["), tx.one_digit(F.col("start")), F.lit("s-"), tx.one_digit(F.col("end")), F.lit("s] "), action, error)
    e = e.withColumn("kind", kind).withColumn("line", F.when(F.col("kind") == "step", tx.normalised(a("Action sentence"))).when(F.col("kind") == "said", said).when(F.col("kind") == "action", done))
    e = e.withColumn("key", F.when(F.col("kind") == "action", action))
    kept = e.where((F.col("kind") == "step") | ((F.col("kind") == "said") & (tx.normalised(a("Transcription")) != "")) | ((F.col("kind") == "action") & ~tx.normalised(a("Verb")).isin(*tx.PASSIVE_VERBS)))
    w = F.struct("start", "seq")
    summary = e.groupBy("video_uid").agg(F.max_by(F.when(has("Long form description"), tx.normalised(a("Long form description"))), F.when(has("Long form description"), w)).alias("summary"), F.sum(F.when(F.col("kind") == "step", F.col("end") - F.col("start"))).alias("annotated"))
    videos = steps_of(kept.select(*EVENT[:4], (F.col("kind") == "step").alias("is_step"), "line", "key"), HOLO).join(summary, "video_uid")
    out = with_clips(videos, HOLO, F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit("")), F.lit("\n")))
    return out.join(durations, "video_uid", "left").withColumn("ann_ratio", F.try_divide("annotated", "duration"))


def parse_activities(activities: DataFrame, actions: DataFrame) -> DataFrame:
    """Recordings of activities (video_uid, seq, start, end, text) with the actions (video_uid, seq, start, end, verb, noun, confusion) that overlap them.

    Confused actions and those without a verb go; an action belongs to every activity that it meets. The duration is the end of the last activity listed.
    """
    named = F.trim(F.lower(F.concat_ws(" ", F.col("verb"), F.when(F.col("noun") != "", F.col("noun")))))
    fine = actions.where((F.coalesce("confusion", F.lit(0)) != 1) & (F.coalesce("verb", F.lit("")) != "")).select("video_uid", F.col("seq").alias("_seq"), F.col("start").alias("_start"), F.col("end").alias("_end"), named.alias("_what"))
    met = joins.interval_overlap(activities, fine, "video_uid", ("start", "end"), ("_start", "_end"))
    sub = F.when(F.col("_what").isNotNull(), F.struct("_seq", F.concat(F.lit(" - ["), tx.one_digit(F.col("_start")), F.lit("s] "), F.col("_what")).alias("line")))
    steps = met.groupBy("video_uid", "seq", "start", "end", "text").agg(F.sort_array(F.collect_list(sub)).alias("subs"))
    one = F.struct(F.col("seq").alias("no"), "start", "end", tx.step_line(F.col("start"), F.col("end"), F.col("text")).alias("step"), F.transform("subs", lambda x: x["line"]).alias("substeps"))
    videos = steps.groupBy("video_uid").agg(F.sort_array(F.collect_list(one)).alias("steps"), F.sum(F.col("end") - F.col("start")).alias("annotated"), F.max_by("end", "seq").alias("duration"))
    return with_clips(videos, ACTIVITY).withColumn("ann_ratio", F.when(F.col("duration") > 0, F.col("annotated") / F.col("duration")).otherwise(0.0))


#: Parsers by data set.
PARSERS: dict[str, Callable[..., DataFrame]] = {"wtag": parse_timed, "holoassist": parse_attributed, "epfl": parse_activities}
