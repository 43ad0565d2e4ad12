"""Model inference along frame streams, with state kept by Structured Streaming.

For each stream the state holds the model's memory and the last frame (a value), the messages so far (a list) and the
texts that stay for the whole stream (a map: system prompt, task knowledge, first user text). A timer closes a
stream at its greatest time and gives the history back. The model is a function of the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dialoom.sources.sinks import json_per_key

#: (frame, history, kept texts, memory) -> (text, memory): history is a list of (role, text), memory anything that JSON holds.
Step = Callable[[dict[str, Any], list[tuple[str, str]], dict[str, str], Any], tuple[str, Any]]

KNOWLEDGE = "Task knowledge:"
OUTPUT = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("gen", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("last", T.BooleanType()),
    ]
)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Inference(StatefulProcessor):
    """Frames of a stream in order of frame_idx; what was handled before, or comes after the greatest time, gives no row."""

    def __init__(self, step: Step, max_seconds: float | None, use_reference: bool):
        self.step, self.max_seconds, self.use_reference = step, max_seconds, use_reference

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last long, began_ms long, closed boolean, memory string")
        self.history = handle.getListState("history", "role string, text string")
        self.kept = handle.getMapState("kept", "name string", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True).sort_values("frame_idx", kind="stable")
        last, began, closed, memory = self.place.get() if self.place.exists() else (None, None, False, "null")
        if closed:
            return
        state = json.loads(memory)
        history = [(h[0], h[1]) for h in self.history.get()]
        old = len(history)
        kept = {k[0]: v[0] for k, v in self.kept.iterator()}
        out = []
        for frame in frames.to_dict("records"):
            idx = int(frame["frame_idx"])
            if closed or (last is not None and idx <= last):
                continue
            now_ms = int(frame["time"].timestamp() * 1000)
            if began is None:
                began = now_ms
                if self.max_seconds is not None:
                    self.handle.registerTimer(began + int(self.max_seconds * 1000))
            texts = frame["texts"]
            for role, text in [(t["role"], t["text"]) for t in texts] if texts is not None else []:
                if last is None and role == "system" and "system" not in kept:
                    kept["system"] = text
                if role == "system" and KNOWLEDGE in text:
                    kept.setdefault("knowledge", text)
                if role == "user":
                    kept.setdefault("first_user", text)
                history.append((role, text))
            said, state = self.step(frame | {"seconds": (now_ms - began) / 1000}, history, kept, state)
            spoken = frame["ref"] if self.use_reference and frame["ref"] is not None else said
            if spoken:
                history.append(("assistant", spoken))
            closed = self.max_seconds is not None and now_ms - began >= self.max_seconds * 1000
            out.append((key[0], idx, frame["time"], said, frame["ref"], closed))
            last = idx
        if closed:
            self._close(last, began)
        else:
            self.place.update((last, began, False, json.dumps(state)))
            self.history.appendList(history[old:])
            for name, text in kept.items():
                self.kept.updateValue((name,), (text,))
        if out:
            yield pd.DataFrame(out, columns=OUTPUT.names)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, began, *_ = self.place.get()
        self._close(last, began)
        yield pd.DataFrame([], columns=OUTPUT.names)

    def _close(self, last: int | None, began: int | None) -> None:
        """The stream's end: the history goes, a mark stays, so that later frames are known to be late."""
        self.place.update((last, began, True, "null"))
        self.history.clear()
        self.kept.clear()

    def close(self) -> None:
        pass


def infer(frames: DataFrame, step: Step, max_seconds: float | None = None, use_reference: bool = False, late: str = "0 seconds") -> DataFrame:
    """(stream, frame_idx, time, gen, ref, last) of frames (stream string, frame_idx long, time timestamp, texts array of (role, text), ref string).

    Works on streams and, in one go, on tables; a stream's session needs the RocksDB state store (``stateful``). Frames of a
    stream must come in order from batch to batch; frames at or before the last one handled are taken as repeats. The frame that reaches
    ``max_seconds`` after the first one is the last (``last``). With ``use_reference`` the history gets the reference's texts, not
    the model's. A stream whose rows are in one micro-batch is held by one task for that batch.
    """
    given = frames.select(F.col("stream").cast("string"), F.col("frame_idx").cast("long"), "time", "texts", F.col("ref").cast("string"))
    if given.isStreaming:
        given = given.withWatermark("time", late)
    return given.groupBy("stream").transformWithStateInPandas(Inference(step, max_seconds, use_reference), OUTPUT, "Append", "EventTime" if given.isStreaming else "ProcessingTime")


def stateful(spark: SparkSession) -> SparkSession:
    """A session whose new stateful queries keep value, list and map state; asking for its streams starts what tables need to have state too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.streams.active  # noqa: B018
    return spark


def write_predictions(predictions: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Starts a stream that writes each micro-batch's rows as JSON lines under its number; a batch that is repeated after a failure replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").json(f"{path}/batch={number}")

    return predictions.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTPUT).json(f"{path}/batch=*")


def save_by_stream(predictions: DataFrame, path: str, metadata: dict[str, Any]) -> None:
    """One JSON file for each stream: its metadata and its predictions in order."""
    shown = predictions.select("stream", F.to_json(F.struct("frame_idx", "time", "gen", "ref")).alias("prediction"), "frame_idx")
    json_per_key(shown, path, "stream", ["frame_idx"], value="prediction", head={"metadata": metadata}, under="predictions")


def silent_until_change(frame: dict[str, Any], history: list[tuple[str, str]], kept: dict[str, str], memory: Any) -> tuple[str, Any]:
    """A model for checks: it says the last text of a frame and the number of frames since it last spoke, if it has not just said that text."""
    said, silent = memory or ("", 0)
    texts = frame["texts"]
    text = texts[-1]["text"] if texts is not None and len(texts) else ""
    if text and text != said:
        return f"{text} {silent}", (text, 0)
    return "", (said, silent + 1)
