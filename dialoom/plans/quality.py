"""Plans of several operators: automatic scores of dialogues, curation, preparation of samples, judging."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.timing import least_distance
from dialoom.operators import filters, ranking, windows


def auto_eval(turns: DataFrame, key: str, time: str, role: Column, asks: Column, starts: DataFrame, within: float = 2.0) -> DataFrame:
    """Scores of each key's dialogue: 10 - (P + R + 0.1 unanswered).

    P is the mean distance of an assistant turn to the nearest step time, R the mean distance of a step start to the nearest assistant
    turn, unanswered the number of questions without an answer in time. ``starts`` has (key, start). Keys without turns or steps are dropped.
    """
    turns = turns.withColumn("_role", role)
    open_questions = windows.unanswered(turns.where(F.col("_role").isin("user", "assistant")), [key], [time], asks, F.col("_role") == "assistant", time, within)
    pending = open_questions.groupBy(key).agg(F.count_if("unanswered").alias("no_resp_user_turns"))
    talk = turns.where(F.col("_role") == "assistant").groupBy(key).agg(F.collect_list(time).alias("_talk"))
    steps = starts.groupBy(key).agg(F.collect_list("start").alias("_starts"))
    both = talk.join(steps, key).join(pending, key)
    mean = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: least_distance(x, ys)), F.lit(0.0), lambda a, d: a + d) / F.size(xs)
    out = both.select(key, mean("_talk", F.col("_starts")).alias("avg_time_diff_p"), mean("_starts", F.col("_talk")).alias("avg_time_diff_r"), "no_resp_user_turns")
    return out.withColumn("final_score", F.lit(10.0) - (F.col("avg_time_diff_p") + F.col("avg_time_diff_r") + F.col("no_resp_user_turns") * 0.1))


def curate(scored: DataFrame, key: str, kind: str, score: str, pos: str, least_train: float, least_eval: float, kinds: int, ratio: float, keep: str = "lowest") -> DataFrame:
    """Training and evaluation rows of scored dialogues, with their use.

    For training, rows of at least ``least_train``, of each kind the share ``ratio`` of lowest (or highest) score; for evaluation the best of each kind, of
    at least ``least_eval``, where all kinds are left.
    """
    order = F.col(score).asc() if keep == "lowest" else F.col(score).desc()
    train = ranking.share_of(filters.at_least(scored, score, least_train), [kind], [order, F.col(pos)], ratio).withColumn("use", F.lit("train"))
    best = ranking.top_one(filters.at_least(scored, score, least_eval), [key, kind], score, pos)
    held = filters.complete_types(best, key, kind, kinds).withColumn("copy", F.lit(1)).withColumn("use", F.lit("eval"))
    return train.unionByName(held)


def generate(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], name: str = "generated", retries: int = 3) -> DataFrame:
    """``df`` with a text model's answers, in Arrow batches; a failing batch is tried again, then is null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        for _ in range(retries):
            try:
                return pd.Series(model(list(prompts)))
            except Exception:  # noqa: BLE001 - the model is the caller's
                continue
        return pd.Series([None] * len(prompts), dtype=object)

    return df.withColumn(name, run(F.col(prompt)))


def encode(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], name: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model(list(texts)))

    return df.withColumn(name, run(F.col(text)))


class Evaluator(ABC):
    """An evaluation of predictions: what it predicts, and its metrics."""

    registry: dict[str, type[Evaluator]] = {}

    def __init_subclass__(cls, **kw: object) -> None:
        super().__init_subclass__(**kw)
        Evaluator.registry[cls.__name__] = cls

    @abstractmethod
    def predict(self, samples: DataFrame) -> DataFrame: ...

    @abstractmethod
    def metrics(self, predictions: DataFrame) -> DataFrame: ...

    def complete(self, samples: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
        """Samples without a prediction; an evaluation is complete if there is none."""
        return samples.join(predictions.select(key).distinct(), key, "left_anti")


class StreamEvaluator(Evaluator):
    """Matches generated to reference turns and computes the streaming metrics."""

    def __init__(self, left: int, right: int, fps: float = 2.0, step: Callable | None = None):
        self.left, self.right, self.fps, self.step = left, right, fps, step

    def predict(self, samples: DataFrame) -> DataFrame:
        from dialoom.streaming.expand import infer_stream

        return infer_stream(samples, "sample_idx", self.step) if self.step else samples

    def metrics(self, predictions: DataFrame) -> DataFrame:
        from dialoom.operators.matching import find_matches
        from dialoom.operators.metrics import stream_metrics

        return stream_metrics(find_matches(predictions, self.left, self.right), self.fps)
