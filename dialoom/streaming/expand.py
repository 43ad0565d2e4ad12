"""Conversations as streams of frames, and the state that runs along them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESERVE, KEEP = 128, 512


def expand(turns: DataFrame, key: str, fps: float = 2.0) -> DataFrame:
    """One row for each frame of (key, pos, role, content, start, end).

    System and user turns since the last frames turn are texts of the next frames turn's first frame; an assistant turn
    is the reference of the last frame of the frames turn before it; other frames are silent. Texts that no frame
    follows are lost. Explode and windows by conversation only.
    """
    w = Window.partitionBy(key).orderBy("pos")
    is_frames = F.col("role") == "frames"
    numbered = turns.withColumn("_island", F.sum(is_frames.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = numbered.where(F.col("role").isin("system", "user")).groupBy(key, (F.col("_island") + 1).alias("_island")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("text"))).alias("texts"))
    refs = numbered.where(F.col("role") == "assistant").groupBy(key, "_island").agg(F.max_by("content", "pos").alias("_ref"))
    islands = numbered.where(is_frames & (F.col("end") > F.col("start"))).select(key, "_island", "start", "end")
    rows = islands.join(said, [key, "_island"], "left").join(refs, [key, "_island"], "left")
    flat = rows.withColumn("frame_idx", F.explode(F.expr("sequence(cast(start as long), cast(end as long) - 1)")))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_island", "frame_idx")) - 1
    return flat.select(
        key,
        number.alias("frame_idx_in_stream"),
        F.col("frame_idx").alias("frame_idx_in_original_video"),
        ((number + 1) / F.lit(float(fps))).alias("timestamp_in_stream"),
        F.when(F.col("frame_idx") == F.col("start"), F.col("texts")).alias("text_inputs"),
        F.when(F.col("frame_idx") == F.col("end") - 1, F.coalesce("_ref", F.lit(""))).otherwise("").alias("ref"),
    )


def expand_combined(turns: DataFrame, key: str, fps: float = 2.0) -> DataFrame:
    """As ``expand``, but the texts of a frame are one system text, joined by blank lines, and one user text, joined by spaces."""
    of = lambda role, sep: F.array_join(F.transform(F.filter("text_inputs", lambda t: t["role"] == role), lambda t: t["text"]), sep)
    return expand(turns, key, fps).withColumn("system_text", of("system", "\n\n")).withColumn("user_text", of("user", " "))


def padded(outputs: DataFrame, n: int) -> DataFrame:
    """n rows for each output of n frames: silent ones and, last, the output."""
    flat = outputs.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return flat.withColumn("gen", F.when(F.col("part") == n, F.col("gen")).otherwise("")).withColumn("ref", F.when(F.col("part") == n, F.col("ref")))


@dataclass
class Context:
    """The length of a stream's context under a policy for when it is full.

    ``drop_all`` clears it; ``drop_middle`` keeps what was there through the first user's frame, and the last KEEP tokens;
    ``summarize`` replaces it by a summary of given length and the snapshot.
    """

    most: int
    policy: str = "drop_all"
    summary: int = 64
    length: int = 0
    initial: int = 0
    drops: int = 0
    log: list[int] = field(default_factory=list)

    def add(self, tokens: int, has_user: bool) -> int:
        self.length += tokens
        if has_user and not self.initial:
            self.initial = self.length
        if self.length >= self.most - RESERVE:
            before = self.length
            if self.policy == "drop_all" or (self.policy == "drop_middle" and not self.initial):
                self.length = 0
            elif self.policy == "drop_middle":
                self.length = self.length if self.length - self.initial < KEEP else self.initial + KEEP
            else:
                self.length = self.initial + self.summary
            self.drops += before != self.length
        self.log.append(self.length)
        return self.length


def context_lengths(frames: DataFrame, key: str, most: int, policy: str) -> DataFrame:
    """(key, frame_idx, context) of frames (key, frame_idx, tokens, has_user) in batch; one group for each stream."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame_idx")
        state = Context(most, policy)
        return pd.DataFrame({key: group[key], "frame_idx": group["frame_idx"], "context": [state.add(int(t), bool(u)) for t, u in zip(group["tokens"], group["has_user"], strict=True)]})

    return frames.select(key, "frame_idx", "tokens", "has_user").groupBy(key).applyInPandas(run, f"{key} long, frame_idx long, context long")


def context_stream(frames: DataFrame, key: str, most: int, policy: str) -> DataFrame:
    """The same over a stream of frames: three numbers of state for each key."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        length, initial, drops = state.get if state.exists else (0, 0, 0)
        own = Context(most, policy, length=length, initial=initial, drops=drops)
        for group in batches:
            group = group.sort_values("frame_idx")
            yield pd.DataFrame({key: keys[0], "frame_idx": group["frame_idx"], "context": [own.add(int(t), bool(u)) for t, u in zip(group["tokens"], group["has_user"], strict=True)]})
        state.update((own.length, own.initial, own.drops))

    return frames.groupBy(key).applyInPandasWithState(run, f"{key} long, frame_idx long, context long", "length long, initial long, drops long", "append", "NoTimeout")


def infer_stream(frames: DataFrame, key: str, step: Callable[[dict, dict], tuple[str, dict]]) -> DataFrame:
    """(key, frame_idx, gen) where ``step(row, state)`` gives a frame's text and the next state; the model is the caller's."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state, out = {}, []
        for row in group.sort_values("frame_idx").to_dict("records"):
            text, state = step(row, state)
            out.append((row[key], row["frame_idx"], text))
        return pd.DataFrame(out, columns=[key, "frame_idx", "gen"])

    return frames.groupBy(key).applyInPandas(run, f"{key} long, frame_idx long, gen string")


def gate(df: DataFrame, probability: str, threshold: float) -> DataFrame:
    """``df`` with talk: silence where the silence probability is over the threshold; a threshold of 0 always talks."""
    return df.withColumn("talk", F.lit(True) if threshold == 0 else F.col(probability) <= threshold)


def generate_by_clip(clips: DataFrame, key: str, model: Callable[[str, list[str]], list[str]], rolling: int = 20) -> DataFrame:
    """(key, clip_idx, turn, text): each clip's turns made from its description and the last ``rolling`` turns before it, clip after clip of one key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        history, out = [], []
        for row in group.sort_values("clip_idx").itertuples():
            made = model(row.description, history[-rolling:])
            out += [(getattr(row, key), int(row.clip_idx), len(history) + i, text) for i, text in enumerate(made)]
            history += made
        return pd.DataFrame(out, columns=[key, "clip_idx", "turn", "text"])

    return clips.select(key, "clip_idx", "description").groupBy(key).applyInPandas(run, f"{key} long, clip_idx int, turn int, text string")
