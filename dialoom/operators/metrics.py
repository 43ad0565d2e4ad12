"""Corpus text metrics and streaming metrics as relational algebra."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N = 4


#: Tokens of pairs that a block of CIDEr aims at, and those whose grams one bucket counts.
BLOCK_TOKENS, BUCKET_TOKENS = 250_000, 2_000_000


@dataclass
class Texts:
    """The texts of some pairs, one after the other: of each its pair, its place (0 the hypothesis, then the references) and its length; ``words`` names all their tokens, of which ``names`` are the different ones."""

    pair: np.ndarray
    place: np.ndarray
    length: np.ndarray
    words: np.ndarray
    names: pa.Array


def texts_of(hyp: pa.ListArray, refs: pa.ListArray) -> Texts:
    """A null text has no tokens; a null token is a token of its own."""
    count = refs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = refs.flatten()
    length = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (hyp, inner)]
    words = pa.concat_arrays([hyp.flatten(), inner.flatten()]).dictionary_encode(null_encoding="encode")
    first = np.repeat(np.cumsum(count) - count, count)
    pair = np.concatenate([np.arange(len(hyp)), np.repeat(np.arange(len(hyp)), count)])
    place = np.concatenate([np.zeros(len(hyp), np.int64), np.arange(len(inner)) - first + 1])
    return Texts(pair, place, np.concatenate(length), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary)


def starts_of(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(Place of its first token, text) of every n-gram."""
    text = np.repeat(np.arange(len(t.length)), t.length)
    rest = np.repeat(np.cumsum(t.length), t.length) - np.arange(len(text))
    at = np.flatnonzero(rest >= n)
    return at, text[at]


def _clipped(hyp: pa.Array, refs: pa.Array) -> pa.Array:
    """For each pair and n, how many n-grams of the hypothesis are in a reference, each as often at most as in one of them."""
    t = texts_of(hyp, refs)
    out = np.zeros((len(hyp), N), np.int64)
    gram = t.words
    for n in range(1, N + 1):
        at, text = starts_of(t, n)
        if not len(at):
            break
        if n > 1:  # the (n - 1)-gram and the next token, numbered anew
            whole = np.zeros(len(t.words), np.int64)
            whole[at] = np.unique(gram[at] * len(t.names) + t.words[at + n - 1], return_inverse=True)[1]
            gram = whole
        wide = int(gram.max()) + 1
        of, c = np.unique(text * wide + gram[at], return_counts=True)
        text, g = of // wide, of % wide
        key, said = t.pair[text] * wide + g, t.place[text] == 0
        own, own_c = key[said], c[said]
        order = np.argsort(key[~said], kind="stable")
        ref, ref_c = key[~said][order], c[~said][order]
        head = np.flatnonzero(np.diff(ref, prepend=-1))
        if len(head):
            _, i, j = np.intersect1d(own, ref[head], assume_unique=True, return_indices=True)
            np.add.at(out[:, n - 1], own[i] // wide, np.minimum(own_c[i], np.maximum.reduceat(ref_c, head)[j]))
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), N).cast(pa.list_(pa.int64()))


def bleu(pairs: DataFrame, hyp: str = "hyp", refs: str = "refs", id_col: str = "pair_id") -> DataFrame:
    """One row with bleu_1..bleu_4 over all pairs of a token array and an array of reference token arrays.

    Counts are clipped by the largest of the references; the reference length is the closest one's, the shorter of equals. A pair's grams are
    counted where the pair is, and only sums travel.
    """
    length = F.size(hyp)
    closest = F.array_min(F.transform(refs, lambda r: F.struct(F.abs(F.size(r) - length).alias("d"), F.size(r).alias("len"))))["len"]
    hits = F.arrow_udf(_clipped, "array<bigint>")(F.col(hyp), F.col(refs))
    each = pairs.select(length.alias("_own"), closest.alias("_closest"), hits.alias("_hits"))
    sums = [F.sum(F.greatest(F.col("_own") - (n - 1), F.lit(0))).alias(f"guess_{n}") for n in range(1, N + 1)]
    row = each.agg(F.sum("_own").alias("test_len"), F.sum("_closest").alias("ref_len"), *sums, *[F.sum(F.col("_hits")[n - 1]).alias(f"{n}") for n in range(1, N + 1)])
    ratio = (F.col("test_len") + 1e-15) / (F.col("ref_len") + 1e-9)
    brevity = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    product, out = F.lit(1.0), []
    for n in range(1, N + 1):
        product = product * ((F.coalesce(F.col(f"`{n}`"), F.lit(0)) + 1e-15) / (F.col(f"guess_{n}") + 1e-9))
        out.append((F.pow(product, F.lit(1.0 / n)) * brevity).alias(f"bleu_{n}"))
    return row.select("test_len", "ref_len", *out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(Different grams' hashes, rising; of every gram its number among them; its text; where the grams of each n end)."""
    names = np.array(["" if w is None else "=" + w for w in t.names.to_pylist()], dtype=object)
    word = pd.util.hash_array(names, categorize=False)[t.words] if len(names) else np.empty(0, np.uint64)
    gram, grams, texts = _mixed(word), [], []
    for n in range(1, N + 1):
        at, text = starts_of(t, n)
        if n > 1:
            longer = np.zeros(len(word), np.uint64)
            longer[at] = _mixed(gram[at] * np.uint64(0x9E3779B97F4A7C15) + word[at + n - 1] + np.uint64(n))
            gram = longer
        grams.append(gram[at])
        texts.append(text)
    found, number = np.unique(np.concatenate(grams), return_inverse=True)
    return found, number, np.concatenate(texts), np.cumsum([len(g) for g in grams]).tolist()


def _column(table: pa.Table, name: str) -> pa.Array:
    whole = table.column(name).combine_chunks()
    return whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole


def _asked(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's grams for each bucket, and in how many of its pairs a reference has them."""
        t = texts_of(_column(table, "_hyp"), _column(table, "_refs"))
        found, number, text, _ = _hashed(t)
        of_ref = t.place[text] > 0
        both = np.unique(t.pair[text[of_ref]] * max(len(found), 1) + number[of_ref])
        pairs = np.bincount(both % max(len(found), 1), minlength=len(found)).astype("<u4")
        bucket = ((found >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)  # rises with the hash
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1)).tolist()
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
        columns = {"_bucket": [b for b, _, _ in rows], "_grams": [found[lo:hi].astype("<u8").tobytes() for _, lo, hi in rows], "_pairs": [pairs[lo:hi].tobytes() for _, lo, hi in rows]}
        block = pa.array([table.column("_block")[0].as_py()] * len(rows), pa.int32())
        return pa.table([pa.array(columns["_bucket"], pa.int32()), block, pa.array(columns["_grams"], pa.binary()), pa.array(columns["_pairs"], pa.binary())], names=["_bucket", "_block", "_grams", "_pairs"])

    return run


def _answered(table: pa.Table) -> pa.Table:
    """Of the grams that each block asked a bucket for, in how many pairs' references they are."""
    asked = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("_grams")]
    pairs = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("_pairs")])
    _, number = np.unique(np.concatenate(asked), return_inverse=True)
    df = np.bincount(number, weights=pairs).astype("<u4")[number]
    parts = np.split(df, np.cumsum([len(a) for a in asked])[:-1])
    return pa.table([_column(table, "_bucket"), _column(table, "_block"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["_bucket", "_block", "_df"])


def _scored(id_col: str, log_n: float):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        t = texts_of(_column(table, "_hyp"), _column(table, "_refs"))
        found, number, text, ends = _hashed(t)
        got = [x.as_buffer() for x in answers.sort_by("_bucket").column("_df")]
        df = np.concatenate([np.frombuffer(x, "<u4") for x in got]) if got else np.empty(0, "<u4")
        idf = log_n - np.log(np.maximum(df, 1).astype(float))
        score = np.zeros(len(t.length))
        own = t.pair  # hypotheses come first, in the order of their pairs
        wide = max(len(found), 1)
        for lo, hi in zip([0, *ends], ends, strict=False):
            of, c = np.unique(text[lo:hi] * wide + number[lo:hi], return_counts=True)
            x, g = of // wide, of % wide
            w = c * idf[g]
            norm = np.sqrt(np.bincount(x, w * w, len(t.length)))
            said = t.place[x] == 0
            key, w0 = of[said], w[said]
            ref, wr, xr = own[x[~said]] * wide + g[~said], w[~said], x[~said]
            if not len(key) or not len(ref):
                continue
            at = np.minimum(np.searchsorted(key, ref), len(key) - 1)
            same = key[at] == ref
            dot = np.bincount(xr[same], np.minimum(wr[same], w0[at[same]]) * wr[same], len(t.length))
            both = norm * norm[own]
            score += np.divide(dot, both, out=np.zeros(len(both)), where=both > 0)
        size = np.maximum(t.length - 1, 0)
        delta = (size[own] - size).astype(float)
        is_ref = t.place > 0
        sums = np.bincount(own[is_ref], (score * np.exp(-(delta * delta) / (2 * 36.0)))[is_ref], table.num_rows)
        refs = np.bincount(own[is_ref], minlength=table.num_rows)
        cider = np.divide(sums, refs, out=np.zeros(len(sums)), where=refs > 0) / N * 10
        return pa.table([_column(table, id_col), pa.array(cider)], names=[id_col, "cider"])

    return run


def cider(pairs: DataFrame, hyp: str = "hyp", refs: str = "refs", id_col: str = "pair_id", together: Column | None = None) -> DataFrame:
    """(id, cider) of pairs with several references: tf-idf cosines of n-grams with clipped counts and a length penalty, the mean over n and references times 10.

    A gram's document frequency is the number of pairs that have it in a reference. Pairs are dealt in blocks, by ``together`` if pairs of equal values share texts. A block asks
    each bucket of gram hashes (64 bits) once for its different grams, in packed arrays, and the frequencies come back to it; a gram that all pairs have costs its bucket one entry for each
    block. Blocks and buckets grow in number with the tokens, which are counted beforehand. A pair without references scores 0.
    """
    size = F.coalesce(F.size(hyp), F.lit(0)) + F.coalesce(F.aggregate(refs, F.lit(0), lambda a, r: a + F.coalesce(F.size(r), F.lit(0))), F.lit(0))
    n, tokens = pairs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n_blocks, n_buckets = (max(1, -(-tokens // most)) for most in (BLOCK_TOKENS, BUCKET_TOKENS))
    block = F.pmod(F.xxhash64(F.col(id_col) if together is None else together), F.lit(n_blocks)).cast("int")
    dealt = pairs.select(F.col(id_col), F.col(hyp).alias("_hyp"), F.col(refs).alias("_refs"), block.alias("_block"))
    asked = dealt.groupBy("_block").applyInArrow(_asked(n_buckets), "_bucket int, _block int, _grams binary, _pairs binary")
    answered = asked.groupBy("_bucket").applyInArrow(_answered, "_bucket int, _block int, _df binary")
    out = T.StructType([T.StructField(id_col, pairs.schema[id_col].dataType), T.StructField("cider", T.DoubleType())])
    return dealt.groupBy("_block").cogroup(answered.groupBy("_block")).applyInArrow(_scored(id_col, math.log(max(n, 1))), out)


def stream_metrics(matches: DataFrame, fps: float, threshold: float = 0.5) -> DataFrame:
    """One row of metrics from rows (kind, gen_idx, ref_idx, score) of kinds matched, missed and redundant."""
    kind = F.col("kind")
    good = (kind == "matched") & (F.col("score") > threshold)
    m = matches.agg(
        F.count_if(kind == "matched").alias("n_matched"),
        F.count_if(good).alias("n_good"),
        F.count_if(kind == "missed").alias("n_missed"),
        F.count_if(kind == "redundant").alias("n_redundant"),
        F.avg(F.when(good, F.abs(F.col("gen_idx") - F.col("ref_idx")))).alias("_d"),
        F.avg(F.when((kind == "matched") & (F.col("score") >= threshold), F.col("score"))).alias("semantic"),
    )
    m0, mg, x, r = (F.col(c) for c in ("n_matched", "n_good", "n_missed", "n_redundant"))
    out = m.select(
        "*",
        F.try_divide(mg, m0 + x + r).alias("jaccard"),
        F.try_divide(x, m0 + x).alias("missing"),
        F.try_divide(r, m0 + r).alias("redundant"),
        F.try_divide(mg, m0 + r).alias("precision"),
        F.try_divide(mg, m0 + x).alias("recall"),
        (F.col("_d") / fps).alias("time_diff"),
        (m0 - mg).alias("num_mismatched"),
    ).drop("_d")
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0))).withColumn("semantic_w", F.col("jaccard") * F.col("semantic"))
