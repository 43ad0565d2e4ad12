"""Sequential packers of conversations and captions, and the retiming of turns.

State runs along one conversation only, so each is one Arrow group or one fold over an array.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = "conv_id long, clip_idx int, first_pos int, last_pos int, seq_len long, n_turns int, start_frame long, end_frame long"


def seeded_between(low: int, high: int, key: str) -> int:
    """A stable number of [low, high] for a key."""
    return low + int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % (high - low + 1)


@dataclass
class Clip:
    """Turns [first, last] of a conversation, the frame that a cut frames turn in front now starts at, and the sum of lengths."""

    first: int
    last: int
    head: int | None
    total: int


def cut_points(group: pd.DataFrame, most: int, context: tuple[int, int] | None = None, key: object = None, per_image: int = 10, separator: bool = False) -> list[Clip]:
    """Clips of turns (role, length, start, end) in order, each of at most ``most`` in length and ending in an assistant turn.

    The assistant turn that takes the sum over ``most`` closes the clip after the last one that fitted; it is found by binary search in the prefix sums
    at assistant turns. What follows begins anew, with ``context`` frames, a seeded number of [low, high], before the end of a frames turn in front,
    also if that is more than it had. Where no assistant turn fits yet, the clip starts again from the frames turn before the first, cut in the same way; if that turn is no frames turn, the conversation ends, and
    if it was so cut already, the clip starts behind the assistant turn. Turns after the last assistant turn go.
    """
    role = group["role"].to_numpy()
    spans = group[["start", "end"]].fillna(0).to_numpy(np.int64)
    total = np.concatenate([[0], np.cumsum(group["length"].to_numpy(np.int64))])
    speaks = np.flatnonzero(role == "assistant")
    at_speaks = total[speaks + 1]
    clips: list[Clip] = []

    def headed(first: int, number: int) -> int | None:
        if context is None or first >= len(role) or role[first] != "frames":
            return None
        return max(0, int(spans[first, 1]) - seeded_between(*context, f"{key}:{number}"))

    def grown(first: int, head: int | None) -> int:
        if head is None:
            return 0
        n = int(spans[first, 1]) - head
        return n * per_image + (max(n - 1, 0) if separator else 0) - int(total[first + 1] - total[first])

    first, head = 0, None
    for number in range(1, 2 * len(role) + 2):
        low = int(np.searchsorted(speaks, first))
        before = int(total[first]) - grown(first, head)
        fit = int(np.searchsorted(at_speaks, most + before, side="right")) - 1
        over = max(fit + 1, low)
        if fit >= low:
            clips.append(Clip(first, int(speaks[fit]), head, int(at_speaks[fit]) - before))
        if over >= len(speaks):
            break
        if fit >= low:
            first = int(speaks[fit]) + 1
        else:
            frames = int(speaks[over]) - 1
            if frames < first or role[frames] != "frames":
                break
            first = frames + 2 if frames == first and head is not None else frames
        head = headed(first, number)
    return clips


def _frames_of(group: pd.DataFrame, clip: Clip) -> list[tuple[int, int]]:
    part = group.iloc[clip.first : clip.last + 1]
    spans = [(int(a), int(b)) for r, a, b in zip(part["role"], part["start"], part["end"], strict=True) if r == "frames"]
    return [(clip.head, spans[0][1]), *spans[1:]] if clip.head is not None else spans


def split_conversations(df: DataFrame, most: int, context: tuple[int, int] | None = None, per_image: int = 10, separator: bool = False) -> DataFrame:
    """Clips of each conversation of (conv_id, pos, role, length, start, end), as ``cut_points`` says; the context is in frames, the lengths of cut frames turns in tokens for each image."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos").reset_index(drop=True)
        conv, pos = int(group["conv_id"].iloc[0]), group["pos"].to_numpy()
        rows = []
        for k, clip in enumerate(cut_points(group, most, context, conv, per_image, separator)):
            spans = _frames_of(group, clip)
            rows.append((conv, k, int(pos[clip.first]), int(pos[clip.last]), clip.total, clip.last - clip.first + 1, min((a for a, _ in spans), default=0), max((b for _, b in spans), default=0)))
        return pd.DataFrame(rows, columns=["conv_id", "clip_idx", "first_pos", "last_pos", "seq_len", "n_turns", "start_frame", "end_frame"])

    return df.select("conv_id", "pos", "role", "length", "start", "end").groupBy("conv_id").applyInPandas(run, CLIP)


def greedy_samples(items: Column, length: str, most: int) -> Column:
    """Sample number of each item of an array of structs: a new sample starts where the sum would reach ``most``."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("id"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        size = x[length].cast("long")
        new = (acc["sum"] > 0) & (acc["sum"] + size >= most)
        number = F.when(new, acc["id"] + 1).otherwise(acc["id"])
        return F.struct(F.when(new, size).otherwise(acc["sum"] + size).alias("sum"), number.alias("id"), F.concat(acc["ids"], F.array(number)).alias("ids"))

    return F.aggregate(items, start, step, lambda a: a["ids"])


def adjusted_times(turns: Column, least: float = 0.5, gap: float = 1.0) -> Column:
    """Times of an array of turns (role, time, ...), moved until no turn but an answer to a user follows within ``least`` seconds.

    Such a turn goes to ``gap`` after the one before, and with it all turns next to it that are closer than ``gap`` to its old time, but for the last of
    the conversation. One fold does what repeated passes do: a move changes no turn before it, so a pair that is apart stays apart; and
    of several moves that reach a turn only the latest counts, as its old time is the new time of the one before. So a fold keeps the latest move alone.
    """
    n = F.size(turns)
    start = F.struct(
        F.lit(None).cast("double").alias("before"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("double").alias("from"), F.lit(None).cast("double").alias("to"), F.array().cast("array<double>").alias("times")
    )

    def step(acc: Column, turn: Column) -> Column:
        own = turn["time"].cast("double")
        last = F.size(acc["times"]) == n - 1
        carried = F.coalesce((own - acc["from"] < gap) & ~last, F.lit(False))
        time = F.when(carried, acc["to"]).otherwise(own)
        close = F.coalesce((time - acc["before"] < least) & ~((turn["role"] == "assistant") & (acc["role"] == "user")), F.lit(False))
        new = F.when(close, acc["before"] + gap).otherwise(time)
        return F.struct(
            new.alias("before"),
            turn["role"].alias("role"),
            F.when(close, time).when(carried, acc["from"]).alias("from"),
            F.when(close, new).when(carried, acc["to"]).alias("to"),
            F.concat(acc["times"], F.array(new)).alias("times"),
        )

    return F.aggregate(turns, start, step, lambda acc: acc["times"])


def adjust_times(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, role, time) with times moved apart; one fold in the JVM for each key."""
    turns = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "time"))).alias("_turns"))
    moved = turns.withColumn("_times", adjusted_times(F.col("_turns")))
    return moved.select(key, F.explode(F.arrays_zip("_turns", "_times")).alias("_t")).select(key, "_t._turns.pos", "_t._turns.role", F.col("_t._times").alias("time"))


def until_summary(turns: Column, end: Column) -> Column:
    """(turns, end): turns up to and with the first system turn that asks for a summary, and where the last frames before it end; without one, all turns and the end as given."""
    asks = F.transform(turns, lambda t: (t["role"] == "system") & t["content"].startswith("Please summarize"))
    place = F.array_position(asks, True).cast("int")
    kept = F.when(place > 0, F.slice(turns, F.lit(1), place)).otherwise(turns)
    last = F.try_element_at(F.filter(kept, lambda t: t["role"] == "frames"), F.lit(-1))["end"]
    return F.struct(kept.alias("turns"), F.when(place > 0, last).otherwise(end).alias("end"))


def knowledge_in_first(turns: Column, knowledge: Column) -> Column:
    """The second system turn goes if it holds task knowledge; the first one gets the sample's own knowledge unless it has some."""
    mark = "Task knowledge: "
    places = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "system", i)), lambda i: i.isNotNull())
    first, second = F.try_element_at(places, F.lit(1)), F.try_element_at(places, F.lit(2))
    held = F.filter(turns, lambda t, i: ~((i == F.coalesce(second, F.lit(-1))) & t["content"].contains(mark)))
    grown = lambda t: t.withField("content", F.concat(t["content"], F.lit(f" {mark}"), knowledge))
    return F.transform(held, lambda t, i: F.when((i == F.coalesce(first, F.lit(-1))) & ~t["content"].contains(mark), grown(t)).otherwise(t))


SAMPLE = (
    "conv_id long, clip_idx int, first_pos int, last_pos int, seq_len long, start_frame long, end_frame long, progress string, has_summary boolean, "
    "conversation array<struct<role: string, content: string, start: long, end: long>>"
)


def prepare_samples(
    df: DataFrame,
    most: int,
    system: int,
    summary: int,
    context: tuple[int, int] | None = None,
    summaries: bool = True,
    prompts: tuple[str, ...] = ("You assist.",),
    ask: str = "Please summarize the progress.",
    knowledge: str = "",
    n_frames: int | None = None,
    per_image: int = 10,
) -> DataFrame:
    """Training samples of conversations (conv_id, pos, role, length, start, end, progress, and content if there is one), with their turns.

    A sample begins with a system turn of ``system`` tokens: a prompt, and from the second sample on the progress that the sample before noted last, and the knowledge.
    With ``summaries`` it ends in the request, one more frame and the progress of its last answer, of ``summary`` tokens together, unless there is
    no further frame or no progress. Both are taken off ``most`` before the turns are split. A sample without frames, or that reaches the end of ``n_frames``, is not kept and does not count.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos").reset_index(drop=True)
        conv = int(group["conv_id"].iloc[0])
        rows: list[tuple] = []
        noted = None
        for clip in cut_points(group, most - system - (summary if summaries else 0), context, conv, per_image):
            part = group.iloc[clip.first : clip.last + 1]
            spans = _frames_of(group, clip)
            if not spans:
                continue
            start, end = spans[0][0], spans[-1][1]
            own = part["progress"].iloc[-1]
            ends = summaries and isinstance(own, str) and (n_frames is None or end + 1 < n_frames)
            if n_frames is not None and end + int(ends) >= n_frames:
                continue
            head = " ".join([prompts[seeded_between(0, len(prompts) - 1, f"{conv}:{len(rows)}")], *([noted] if noted else []), *([knowledge] if rows and knowledge else [])])
            told, left = [("system", head, None, None)], list(spans)
            for role, text in zip(part["role"], part["content"], strict=True):
                told.append((role, None, *left.pop(0)) if role == "frames" else (role, text, None, None))
            if ends:
                told += [("system", ask, None, None), ("frames", None, end, end + 1), ("assistant", own, None, None)]
            rows.append((conv, len(rows), int(part["pos"].iloc[0]), int(part["pos"].iloc[-1]), clip.total + system + (summary if ends else 0), start, end + int(ends), noted, ends, told))
            said = [x for r, x in zip(part["role"], part["progress"], strict=True) if r == "assistant" and isinstance(x, str)]
            noted = said[-1] if said else None
        return pd.DataFrame(rows, columns=["conv_id", "clip_idx", "first_pos", "last_pos", "seq_len", "start_frame", "end_frame", "progress", "has_summary", "conversation"])

    content = F.col("content") if "content" in df.columns else F.lit(None).cast("string")
    return df.select("conv_id", "pos", "role", content.alias("content"), "length", "start", "end", "progress").groupBy("conv_id").applyInPandas(run, SAMPLE)


def pack_with_restarts(turns: list[int], most: int, head: int, restart: int, summary: int) -> list[tuple[int, int, int]]:
    """(First turn, end, tokens) of samples: a turn that takes a sample over ``most`` is taken out, a summary pair is put behind what is left, and the next sample starts with instruction, summary and knowledge of ``restart`` tokens."""
    out, first, total = [], 0, head
    for i, n in enumerate(turns):
        if total + n + summary > most and i > first:
            out.append((first, i, total + summary))
            first, total = i, restart
        total += n
    if first < len(turns):
        out.append((first, len(turns), total))
    return out


def packed_with_restarts(df: DataFrame, key: str, most: int = 7500, head: int = 100, restart: int = 300, summary: int = 200) -> DataFrame:
    """Samples (key, sample_idx, first_pos, end_pos, tokens) of turns (key, pos, length)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        pos = group["pos"].tolist()
        rows = [(group[key].iloc[0], k, pos[a], pos[b - 1], t) for k, (a, b, t) in enumerate(pack_with_restarts([int(x) for x in group["length"]], most, head, restart, summary))]
        return pd.DataFrame(rows, columns=[key, "sample_idx", "first_pos", "last_pos", "tokens"])

    return df.select(key, "pos", "length").groupBy(key).applyInPandas(run, f"{key} long, sample_idx int, first_pos long, last_pos long, tokens long")
