"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a learned word vector (of the words whose share differs most between toxic and other
training texts; one vector for the rest) and the mean of learned vectors of its character
triples. Two gated recurrent layers read a window of WINDOW words forwards and backwards, attention
pools their states, and a logistic output scores the window. Windows start every STEP words, so
neighbours overlap, and cover the whole text; a text's score is its highest window's.

Training is multiple-instance: each pass takes a toxic text's highest window, and of another text its
highest and one more, and follows the gradient through the attention, both layers and the inputs. The sample
is at most ``TRAIN_ROWS`` labelled rows, those of least hash among the rows whose crc32(doc_id) mod 5 is not 0.

Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. Defined results: a text without words
has one window of no words, scored by the output's bias; repeated rows score alike; without usable
labels of both kinds every score is 0; a null doc_id has held_out null; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import blocks as B
from dialoom.llm.op03_quality import fold, train_sample
from dialoom.llm.texts import score_column

FOLDS, HELD_OUT = 5, 0
TRAIN_ROWS = 4096
WINDOW, STEP = 48, 36
HIDDEN, WORD_SIZE, TRIPLE_SIZE, ATTENTION = 8, 8, 6, 8
VOCABULARY, TRIPLES = 4096, 4096
#: Passes over large samples; small ones get more, up to LONGEST.
PASSES, LONGEST, BATCH, RATE = 4, 30, 64, 0.01
#: Share of other texts' windows that are trained on as their first word over and over, which texts of one word need.
MONOTONE = 0.06

_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(Place in the list of distinct words and text number of each word; distinct words' hashes, triple codes one after the other, numbers of these)."""
    places, owners, hashes, codes, sizes = [], [], [], [], []
    base = 0
    for piece in B._pieces(texts):
        buffer = np.frombuffer(b" ".join(t for _, t in piece) + b"  ", dtype=np.uint8)
        edge = np.flatnonzero(np.diff((~_OUTSIDE[buffer]).view(np.int8), prepend=0))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            continue
        folded = B._FOLD[buffer]
        up, down = B._BYTES.get(len(buffer) + 1)
        prefix = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(B._LETTER[folded] * up[: len(buffer)], out=prefix[1:])
        value = B.mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        unique, first, place = np.unique(value, return_index=True, return_inverse=True)
        length = ends[first] - starts[first]
        at = np.repeat(starts[first], length) + B.spans_of(length)
        after = np.where(_OUTSIDE[buffer[at + 1]], 0, folded[at + 1])
        third = np.where((after == 0) | _OUTSIDE[buffer[at + 2]], 0, folded[at + 2])
        places.append(place + base)
        base += len(unique)
        offsets = np.cumsum([len(t) + 1 for _, t in piece])
        owners.append(np.array([i for i, _ in piece], dtype=np.int64)[np.searchsorted(offsets, starts, side="right")])
        hashes.append(unique)
        codes.append(((folded[at] * 37 + after * 1009 + third * 30011) % TRIPLES).astype(np.int32))
        sizes.append(length)
    if not places:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), none, none
    return tuple(np.concatenate(x) for x in (places, owners, hashes, codes, sizes))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(First word, words, text) of each window; every text has at least one."""
    n = first[1:] - first[:-1]
    counts = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(len(n)), counts)
    start = B.spans_of(counts) * STEP
    return first[text] + start, np.minimum(WINDOW, n[text] - start), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _layer(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, windows, HIDDEN) of a gated recurrent layer over projected inputs (steps, windows, 3 HIDDEN)."""
    steps, n, _ = x.shape
    h = np.zeros((n, HIDDEN), x.dtype)
    out = np.empty((steps, n, HIDDEN), x.dtype)
    for t in range(steps):
        gate = x[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN]
        gate = _sigmoid(gate)
        z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
        new = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, new))
        h = h + (z * mask[t][:, None]) * (new - h)
        out[t] = h
    return out


def _layer_back(grad: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``."""
    steps, n, _ = grad.shape
    dx, du, dh = np.zeros((steps, n, 3 * HIDDEN), grad.dtype), np.zeros_like(u), np.zeros((n, HIDDEN), grad.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, new = kept[t]
        d = dh + grad[t]
        m = mask[t][:, None]
        dnew = d * z * m * (1 - new * new)
        dz = d * (new - h) * m * z * (1 - z)
        back = dnew @ u[:, 2 * HIDDEN :].T
        dr = back * h * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dnew], axis=1)
        du[:, : 2 * HIDDEN] += h.T @ dx[t, :, : 2 * HIDDEN]
        du[:, 2 * HIDDEN :] += (r * h).T @ dnew
        dh = d * (1 - z * m) + back * r + dx[t, :, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
    return dx, du


class Network:
    def __init__(self, vocabulary: np.ndarray, start: np.ndarray):
        rng = np.random.default_rng(7)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary
        size = WORD_SIZE + TRIPLE_SIZE
        self.p = {
            "words": (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_SIZE))).astype(np.float32),
            "triples": (0.1 * rng.standard_normal((TRIPLES, TRIPLE_SIZE))).astype(np.float32),
            "in": scale(size, 6 * HIDDEN),
            "bias": np.zeros(6 * HIDDEN, np.float32),
            "u0": scale(HIDDEN, 3 * HIDDEN),
            "u1": scale(HIDDEN, 3 * HIDDEN),
            "a": scale(2 * HIDDEN, ATTENTION),
            "v": scale(ATTENTION, 1)[:, 0],
            "w": scale(2 * HIDDEN, 1)[:, 0],
            "b": np.full(1, -1.0, np.float32),
        }
        self.p["words"][1:, 0] = start

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def triple_means(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.empty((0, TRIPLE_SIZE), np.float32)
        return np.add.reduceat(self.p["triples"][codes], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)

    def forward(self, x: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; x holds projected inputs (steps, windows, 6 HIDDEN)."""
        steps, n, _ = x.shape
        mask = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)
        kept: tuple = ([], []) if keep is not None else (None, None)
        ahead = _layer(x[:, :, : 3 * HIDDEN], mask, self.p["u0"], kept[0])
        behind = _layer(x[::-1, :, 3 * HIDDEN :], mask[::-1], self.p["u1"], kept[1])[::-1]
        h = np.concatenate([ahead, behind], axis=2)
        t = np.tanh(h @ self.p["a"])
        e = np.where(mask > 0, t @ self.p["v"], np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, h)
        if keep is not None:
            keep |= {"mask": mask, "kept": kept, "h": h, "t": t, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def backward(self, k: dict, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters after the inputs, and of the projected inputs, given the logits'."""
        g = {"w": k["pooled"].T @ d, "b": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["w"]
        h, alpha, t = k["h"], k["alpha"], k["t"]
        dh = alpha[:, :, None] * dp[None]
        da = np.einsum("tnh,nh->tn", h, dp)
        de = alpha * (da - (alpha * da).sum(axis=0)) * (k["mask"] > 0)
        g["v"] = np.einsum("tna,tn->a", t, de)
        dt = de[:, :, None] * self.p["v"] * (1 - t * t)
        g["a"] = np.einsum("tnh,tna->ha", h, dt)
        dh = dh + dt @ self.p["a"].T
        dx0, g["u0"] = _layer_back(np.ascontiguousarray(dh[:, :, :HIDDEN]), k["mask"], self.p["u0"], k["kept"][0])
        dx1, g["u1"] = _layer_back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), k["mask"][::-1], self.p["u1"], k["kept"][1])
        return g, np.concatenate([dx0, dx1[::-1]], axis=2)

    def projected(self, hashes: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Projected input of each distinct word, and of padding last."""
        x = np.concatenate([self.p["words"][self.word_ids(hashes)], self.triple_means(codes, sizes)], axis=1)
        return np.concatenate([x @ self.p["in"] + self.p["bias"], np.zeros((1, 6 * HIDDEN), np.float32)])

    def score_windows(self, place: np.ndarray, table: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.float32)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            steps = max(int(length[part[0]]), 1)
            index = start[part][None, :] + np.arange(steps)[:, None]
            inside = np.arange(steps)[:, None] < length[part][None, :]
            words = np.where(inside, place[np.minimum(index, max(len(place) - 1, 0))] if len(place) else 0, len(table) - 1)
            out[part] = self.forward(table[words], length[part])
        return out


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of each text's highest window."""
    place, owner, hashes, codes, sizes = words_of(texts)
    first = B.doc_bounds(owner, len(texts))
    start, length, text = windows(first)
    logits = net.score_windows(place, net.projected(hashes, codes, sizes), start, length)
    return _sigmoid(np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(texts)))).astype(np.float64))


def _vocabulary(place: np.ndarray, owner: np.ndarray, hashes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words whose document shares differ most between the labels, sorted, with their log odds."""
    pairs = np.unique(np.stack([hashes[place].view(np.int64), owner]), axis=1)
    words, of = np.unique(pairs[0].view(np.uint64), return_inverse=True)
    toxic = np.bincount(of, weights=label[pairs[1]], minlength=len(words))
    clean = np.bincount(of, minlength=len(words)) - toxic
    n1, n0 = max(label.sum(), 1), max((1 - label).sum(), 1)
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    total = toxic + clean
    gain = np.abs(toxic / n1 - clean / n0) * np.sqrt(total)
    chosen = np.sort(np.argsort(-np.where(total >= 4, gain, -1), kind="stable")[:VOCABULARY])
    chosen = chosen[total[chosen] >= 4]
    return words[chosen], np.clip(odds[chosen], -3, 3).astype(np.float32) / 2


def train(texts: list[bytes], label: np.ndarray) -> Network:
    place, owner, hashes, codes, sizes = words_of(texts)
    label = label.astype(np.float32)
    net = Network(*_vocabulary(place, owner, hashes, label))
    first = B.doc_bounds(owner, len(texts))
    start, length, text = windows(first)
    heads = np.searchsorted(text, np.arange(len(texts)))
    ids = net.word_ids(hashes)
    code_at = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(3)
    first_m = {k: np.zeros_like(v) for k, v in net.p.items()}
    second_m = {k: np.zeros_like(v) for k, v in net.p.items()}
    odds = np.concatenate([[0], net.p["words"][1:, 0]])[ids]
    total = np.concatenate([[0], np.cumsum(np.where(odds[place] > 0.5, odds[place], 0))]) if len(place) else np.zeros(1)
    logits = total[start + np.maximum(length, 0)] - total[start]
    step = 0
    balance = float(np.clip((1 - label).sum() / max(label.sum(), 1), 1, 4))
    passes = int(np.clip(-(-PASSES * TRAIN_ROWS // (2 * len(texts))), PASSES, LONGEST))
    for turn in range(passes):
        if turn:
            logits = net.score_windows(place, net.projected(hashes, codes, sizes), start, length)
        best = np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(heads, np.append(heads[1:], len(text)), strict=True)])
        other = heads + (rng.random(len(heads)) * (np.append(heads[1:], len(text)) - heads)).astype(np.int64)
        chosen = rng.permutation(np.unique(np.concatenate([best, other[label == 0]])))
        for at in range(0, len(chosen), BATCH):
            part = chosen[at : at + BATCH]
            steps = max(int(length[part].max()), 1)
            inside = np.arange(steps)[:, None] < length[part][None, :]
            index = np.minimum(start[part][None, :] + np.arange(steps)[:, None], max(len(place) - 1, 0))
            same = (label[text[part]] == 0) & (rng.random(len(part)) < MONOTONE)
            index[:, same] = index[0, same]
            used, where = np.unique(place[index[inside]], return_inverse=True)
            n_codes = sizes[used]
            at_codes = codes[np.repeat(code_at[used], n_codes) + B.spans_of(n_codes)]
            raw = np.concatenate([net.p["words"][ids[used]], net.triple_means(at_codes, n_codes)], axis=1)
            x = np.zeros((steps, len(part), 6 * HIDDEN), np.float32)
            x[inside] = (raw @ net.p["in"] + net.p["bias"])[where]
            keep: dict = {}
            y = label[text[part]]
            p = _sigmoid(net.forward(x, length[part], keep))
            g, dx = net.backward(keep, ((p - y) * np.where(y > 0, balance, 1) / len(part)).astype(np.float32))
            flat = np.zeros((len(used), 6 * HIDDEN), np.float32)
            np.add.at(flat, where, dx[inside])
            g["in"], g["bias"] = raw.T @ flat, flat.sum(axis=0)
            back = flat @ net.p["in"].T
            g["words"], g["triples"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["triples"])
            np.add.at(g["words"], ids[used], back[:, :WORD_SIZE])
            np.add.at(g["triples"], at_codes, np.repeat(back[:, WORD_SIZE:] / n_codes[:, None], n_codes, axis=0))
            step += 1
            for k, v in g.items():
                first_m[k] += 0.1 * (v - first_m[k])
                second_m[k] += 0.01 * (v * v - second_m[k])
                net.p[k] -= (RATE * (0.25 ** (turn / passes)) * (first_m[k] / (1 - 0.9**step)) / (np.sqrt(second_m[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = sorted((x for f in batches for x in zip(f["order"], f["label"], f["text"], strict=True)), key=lambda x: (x[0], x[2]))
    label = np.array([x[1] for x in held])
    if len(held) and 0 < label.sum() < len(label):
        net = train([x[2].encode("utf-8", "surrogatepass") for x in held], label)
        yield pd.DataFrame({"network": [pickle.dumps((net.vocabulary, net.p))]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | None:
    """The network learned in one task from a bounded sample; its parameters, under 1 MB, come to the driver."""
    sample = train_sample(labels, docs, "toxic", FOLDS, HELD_OUT, rows)
    found = sample.repartition(1).mapInPandas(_fit, "network binary").collect()
    if not found:
        return None
    vocabulary, p = pickle.loads(bytes(found[0][0]))
    net = Network(vocabulary, np.zeros(len(vocabulary), np.float32))
    net.p = p
    return net


def _scorer(net: Network | None):
    if net is None:
        return lambda texts: np.zeros(len(texts))
    vocabulary, p = net.vocabulary, net.p

    def score(texts: list[bytes]) -> np.ndarray:
        own = Network(vocabulary, np.zeros(len(vocabulary), np.float32))
        own.p = p
        return score_texts(own, texts)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    net = fit(docs, labels, rows)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score_column(_scorer(net)).alias("score"))
    return given.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
