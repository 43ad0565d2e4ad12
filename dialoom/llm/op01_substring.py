"""Removal of passages that repeat, found through difference-cover anchors.

The cover {0, 1, 4, 14, 16} modulo 21 has, for every shift between two occurrences of a
passage, one offset below 21 at which both meet the cover. So of two equal windows of W
words both contain, at one place, a hashed anchor window of W - 20 words that starts at a
cover position of its document. Only such anchors (5 of 21) are hashed and shuffled. Around
those that repeat, the W-word windows that contain them are the extension: they are hashed
with 64 bits and compared, and a word that lies in a repeated window goes.

Defined results: a null text has no words (n_words 0, the digest of the empty string); a
text under W words loses nothing; repeated rows and rows with equal ids each get their own
result, and as copies of each other they lose all words; an empty table gives no rows.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import blocks as B
from dialoom.llm.texts import distinct_texts, text_key
from dialoom.session import input_bytes

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
_KEY = "V16"
EMPTY = hashlib.sha256(b"").hexdigest()


def _emit(hashes: np.ndarray, owner: np.ndarray, pos: np.ndarray, keys: list[bytes], n_buckets: int, wide: bool) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, kind, payload): kind 0 for one entry of each hash, 1 for entries known to repeat."""
    table = np.frombuffer(b"".join(keys), dtype=_KEY)
    one, many = B.repeated(hashes)
    buckets = B.bucket_of(hashes[one], n_buckets)
    for bucket, part in B.by_bucket(buckets):
        at = np.sort(one[part])
        docs, counts = np.unique(owner[at], return_counts=True)
        value = hashes[at] if wide else hashes[at].astype(np.uint32)
        yield bucket, 0, B.pack(table[docs], counts.astype("<u4"), value, pos[at].astype("<u4"))
    if len(many):
        many = np.sort(many)
        docs, counts = np.unique(owner[many], return_counts=True)
        yield int(hashes[many[0]] % np.uint64(n_buckets)), 1, B.pack(table[docs], counts.astype("<u4"), b"", pos[many].astype("<u4"))


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "payload"])


def _anchors(n_buckets: int, window: int):
    width = window - PERIOD + 1
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in B.blocks(batches):
            words, owner = B.words_of(list(frame["text"]))
            first = B.doc_bounds(owner, len(frame))
            pos = np.arange(len(words)) - first[owner]
            left = first[owner + 1] - first[owner] - pos if len(words) else pos
            long = (first[1:] - first[:-1] >= window)[owner] if len(words) else np.empty(0, bool)
            at = np.flatnonzero(cover[pos % PERIOD] & (left >= width) & long)
            if len(at):
                hashes = B.window_hash(words, at, width, 21)
                yield _frame(list(_emit(hashes, owner[at], pos[at], list(frame["key"]), n_buckets, False)))

    return run


def _windows(n_buckets: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in B.blocks(f[f["hits"].map(lambda h: h is not None and len(h) > 0)] for f in batches):
            words, owner = B.words_of(list(frame["text"]))
            first = B.doc_bounds(owner, len(frame))
            starts = []
            for i, hits in enumerate(frame["hits"]):
                n = int(first[i + 1] - first[i])
                place = np.concatenate([np.frombuffer(h, dtype="<u4") for h in hits]).astype(np.int64)
                edge = np.zeros(n + 2, dtype=np.int64)
                np.add.at(edge, np.maximum(place - (PERIOD - 1), 0), 1)
                np.add.at(edge, np.minimum(place, n - window) + 1, -1)
                starts.append(np.flatnonzero(np.cumsum(edge[: n - window + 1]) > 0) + first[i])
            at = np.concatenate(starts) if starts else np.empty(0, np.int64)
            if len(at):
                hashes = B.window_hash(words, at, window, 35)
                yield _frame(list(_emit(hashes, owner[at], at - first[owner[at]], list(frame["key"]), n_buckets, True)))

    return run


def _matches(wide: bool):
    kind = "<u8" if wide else "<u4"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, pos = [], []
        held = [B.unpack(p, _KEY, "<u4", kind, "<u4") for p in group.loc[group["kind"] == 0, "payload"]]
        if held:
            all_hashes = np.concatenate([h[2] for h in held])
            _, many = B.repeated(all_hashes)
            many = np.sort(many)
            all_keys = np.concatenate([h[0] for h in held])
            owner = np.repeat(np.arange(len(all_keys)), np.concatenate([h[1] for h in held]))
            keys.append((all_keys, owner[many]))
            pos.append(np.concatenate([h[3] for h in held])[many])
        for p in group.loc[group["kind"] == 1, "payload"]:
            k, counts, _, at = B.unpack(p, _KEY, "<u4", bytes, "<u4")
            keys.append((k, np.repeat(np.arange(len(k)), counts)))
            pos.append(at)
        rows = []
        for (k, owner), at in zip(keys, pos, strict=True):
            for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
                if len(part):
                    rows.append((k[owner[part[0]]].tobytes(), at[part].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["key", "hit"])

    return run


def _finish(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in B.blocks(batches, limit=2 << 20):
            rows = []
            for key, text, copies, hits in zip(frame["key"], frame["text"], frame["copies"], frame["hits"], strict=True):
                words = text.split()
                n = len(words)
                gone = np.zeros(n, dtype=bool)
                if copies > 1 and n >= window:
                    gone[:] = True
                elif hits is not None and len(hits):
                    at = np.concatenate([np.frombuffer(h, dtype="<u4") for h in hits]).astype(np.int64)
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:n]) > 0
                removed = int(gone.sum())
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if removed else b" ".join(words)
                rows.append((key, n, removed, kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["key", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_text, kept_sha256) for every distinct text of ``docs``."""
    assert window > PERIOD, "the window must be longer than the cover's period"
    buckets = B.bucket_count(input_bytes(docs))
    texts = distinct_texts(docs)
    rows, hits = "bucket int, kind int, payload binary", "key binary, hit binary"
    found = texts.mapInPandas(_anchors(buckets, window), rows).groupBy("bucket").applyInPandas(B.freed(_matches(False)), hits)
    found = found.groupBy("key").agg(F.collect_list("hit").alias("hits"))
    near = texts.join(found, "key", "left").select("key", "text", "copies", "hits")
    whole = near.mapInPandas(_windows(buckets, window), rows).groupBy("bucket").applyInPandas(B.freed(_matches(True)), hits)
    whole = whole.groupBy("key").agg(F.collect_list("hit").alias("hits"))
    out = "key binary, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return texts.join(whole, "key", "left").select("key", "text", "copies", "hits").mapInPandas(_finish(window), out)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with text replaced by its kept words, n_chars if there renewed, and n_words, n_removed, kept_sha256."""
    kept = repeated_passages(docs, window).withColumnRenamed("key", "_key")
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256", "kept_text", "_key")]
    out = docs.select(*keep).withColumn("_key", text_key(F.col("text"))).join(kept, "_key", "left")
    change = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text").cast("long")} if "n_chars" in keep else {})
    return out.select(
        *[change[c].alias(c) if c in change else F.col(c) for c in keep],
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", F.lit(EMPTY)).alias("kept_sha256"),
    )


def without_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` in its own columns: texts that lose words are their kept words, n_chars if there is renewed; other texts stay as they are."""
    kept = repeated_passages(docs, window).select(F.col("key").alias("_key"), F.when(F.col("n_removed") > 0, F.col("kept_text")).alias("_kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_key(F.col("text")).alias("_key"))
    of = lambda c: F.col("_row").getField(c)
    change = {"text": F.coalesce("_kept", of("text"))}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col("_kept").isNull(), of("n_chars")).otherwise(F.length("_kept")).cast(docs.schema["n_chars"].dataType)
    return rows.join(kept, "_key", "left").select(*[change.get(c, of(c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    kept = repeated_passages(docs, window).drop("kept_text")
    return (
        docs.select("doc_id", text_key(F.col("text")).alias("key"))
        .join(kept, "key", "left")
        .select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", F.lit(EMPTY)).alias("kept_sha256"))
    )
