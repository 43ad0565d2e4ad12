"""Quality scores: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are one- and two-word sequences, and one- to three-word sequences of word shapes (the
kinds of characters of a word, its length's band, a last character that is no letter), hashed to 2**18
places; each order's features of a text share a mass of one. The learner is FTRL-proximal with
a rate for each place and L1 and L2 terms. A score is the sparse dot product of a text's
features and the weights, through the logistic function.

It is trained on at most ``TRAIN_ROWS`` labelled rows: those of least hash among the labelled rows
whose crc32(doc_id) mod 3 is not 1. Every text is scored, whole.

Defined results: a null or blank text scores by the bias alone; repeated rows score alike; without any
usable label every score is 0.5; a null doc_id has held_out null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm import blocks as B
from dialoom.llm.texts import score_column

BITS = 18
TRAIN_ROWS = 6144
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-3
_SEEDS = tuple(np.uint64(x) for x in (0x51, 0x52, 0x53, 0x54, 0x55))
FOLDS, HELD_OUT = 3, 1


def features(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(Hashed feature places by order, of each word; words' text numbers; first word of each text and the end)."""
    words, owner, shape = B.words_of(texts, shapes=True)
    first = B.doc_bounds(owner, len(texts))
    mask = np.uint64((1 << BITS) - 1)
    m = np.uint64(0x9E3779B97F4A7C15)

    def after(x: np.ndarray, k: int) -> np.ndarray:
        """The k-th next word's value; 0 beyond the text."""
        out = np.zeros(len(x), dtype=np.uint64)
        if k < len(x):
            out[:-k] = np.where(owner[:-k] == owner[k:], x[k:], np.uint64(0))
        return out

    two, three = after(shape, 1), after(shape, 2)
    sets = [words, words * m + after(words, 1), shape, shape * m + two, (shape * m + two) * m + three]
    return [((B.mix(x ^ seed) & mask).astype(np.int32)) for x, seed in zip(sets, _SEEDS, strict=True)], owner, first


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights, the bias last, from (places, values, label) rows by FTRL-proximal over EPOCHS passes."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for at, value, label in rows:
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA
            z[at] = za + g - sigma * w
            n[at] = na + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32)


def example(places: list[np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's sparse features: places and values, with the bias."""
    if hi == lo:
        return np.array([1 << BITS]), np.ones(1)
    at, count = np.unique(np.concatenate([p[lo:hi] for p in places]), return_counts=True)
    return np.append(at, 1 << BITS), np.append(count / (hi - lo), 1.0)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    places, _, first = features(texts)
    total = np.zeros(int(first[-1]) + 1)
    if first[-1]:
        np.cumsum(sum(weights[p] for p in places), dtype=np.float64, out=total[1:])
    n = first[1:] - first[:-1]
    dot = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-(np.clip(dot + weights[1 << BITS], -35, 35))))


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def train_sample(labels: DataFrame, docs: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(order, label, text) of at most ``rows`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    chosen = usable.select("doc_id", F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_of = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return rows_of.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select(F.xxhash64("doc_id").alias("order"), "label", "text")


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in B.blocks(batches, limit=2 << 20):
        places, _, first = features(list(frame["text"]))
        rows = []
        for i, (order, label) in enumerate(zip(frame["order"], frame["label"], strict=True)):
            at, value = example(places, int(first[i]), int(first[i + 1]))
            rows.append((int(order), int(label), at.astype("<i4").tobytes(), value.astype("<f4").tobytes()))
        yield pd.DataFrame(rows, columns=["order", "label", "places", "row"])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [x for frame in batches for x in zip(frame["order"], frame["label"], frame["places"], frame["row"], strict=True)]
    held.sort(key=lambda x: x[0])
    rows = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64), int(label)) for _, label, a, v in held]
    if rows:
        yield pd.DataFrame({"weights": [train(rows).tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned in one task from a bounded sample; 1 MB comes back to the driver."""
    sample = train_sample(labels, docs, "quality", FOLDS, HELD_OUT, rows)
    coded = sample.mapInPandas(_encode, "order long, label int, places binary, row binary")
    found = coded.repartition(1).mapInPandas(_fit, "weights binary").collect()
    return np.frombuffer(bytes(found[0][0]), dtype=np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    weights = fit(docs, labels, rows)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score_column(lambda texts: scores(texts, weights)).alias("score"))
    return given.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose predicted quality is 1, in the same columns."""
    weights = fit(docs, labels, rows)

    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").alias("_text"))
    return packed.where(score_column(lambda texts: scores(texts, weights), "_text") >= 0.5).select("_row.*")
