"""Text scores by a probabilistic suffix tree with contexts of variable length.

Tokens are lower-cased words and one end for each text, whose start is a symbol before its first token. Contexts are
the runs of at most DEPTH symbols before a token. An entry (context, next token) is kept if it occurs LEAST
times in the training texts, however large the corpus, so the tree grows with it. A context is retained if its suffix is, and if
its next-token distribution diverges from its suffix's: the relative entropy of the two, over the kept next tokens and the rest as one,
times the context's count must reach RETAIN nats. Distributions are smoothed by an absolute discount of the kept entries, whose
mass and that of all others goes to the suffix's distribution, at the root to the smoothed word counts. A token is scored in the
longest retained suffix of what precedes it.

Texts are tokenised once, into a table of blocks with a block's distinct words and its tokens as numbers of these. Then blocks
ask and buckets of hashes answer, in rounds: first for the counts of words and pairs; round r for the contexts of r - 1
symbols, to which each block brings its share of their sums, and for the counts of runs of r + 1 symbols both of whose parts
occur LEAST times. A context of n occurrences whose suffix has m diverges by n log(m / n) nats at most; where that is
under RETAIN, or is so for a suffix, it cannot be retained, and neither it nor what only it needs is asked for. Questions and answers are packed arrays of a block's distinct runs, so a run in a third of all texts is one entry a
block. With the last answers a block scores its tokens. Nothing of the tree is gathered or broadcast. Texts of any
length are cut into blocks; a block starts with the last symbols of the one before, as context only.

Defined results: a null or empty text is one end token; rows with a null doc_id are scored, have held_out null
and are not learned from; repeated rows each give a row and count each; without training rows all counts are 0, and
score and base_score too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import blocks as B
from dialoom.llm.components import cut, cut_by, release
from dialoom.llm.op03_quality import fold
from dialoom.session import input_bytes

FOLDS, HELD_OUT = 7, 2
DEPTH, LEAST = 3, 2
DISCOUNT, RETAIN = 0.75, 6.0
END, START = np.uint64(0x0E0E0E0E0E0E0E0E), np.uint64(0x0F0F0F0F0F0F0F0F)
#: Text of a block in bytes and its tokens; its arrays are a few tens of times as large.
BLOCK_BYTES, BLOCK_TOKENS = 4 << 20, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFF)


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each symbol: start, words, end."""
    words, owner = B.words_of(texts, fold=True)
    first = B.doc_bounds(owner, len(texts))
    number = np.arange(len(texts))
    at = np.concatenate([first[:-1], first[1:]])
    order = np.argsort(2 * np.concatenate([number, number]) + np.repeat([0, 1], len(texts)), kind="stable")
    marks = np.repeat(np.array([START, END]), len(texts))[order]
    return np.insert(words, at[order], marks), np.insert(owner, at[order], np.concatenate([number, number])[order])


def squeeze(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in one byte each, and those that need more."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype("<i8")


def widen(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def pressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Place of one of each distinct code, in the codes' order; number of each code's; the distinct codes)."""
    order = np.argsort(codes)
    held = codes[order]
    head = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.empty(0, bool)
    number = np.empty(len(codes), np.int32)
    number[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    return order[head], number, held[head]


def _tokenise(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[pd.DataFrame]:
    """Rows (block, docs, vocab, tokens); docs has for each text its row, doc, void, held and its symbols here."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 33
    row = number = 0
    for frame in B.blocks(batches, limit=BLOCK_BYTES):
        hashes, owner = symbols_of(list(frame["text"]))
        doc, void, held = frame["doc"].to_numpy(np.int64), frame["void"].to_numpy(bool), frame["held"].to_numpy(bool)
        for a in range(0, len(hashes), BLOCK_TOKENS):
            b = min(a + BLOCK_TOKENS, len(hashes))
            lead = min(depth, a - int(np.searchsorted(owner, owner[a])))
            own = owner[a - lead : b]
            of, sizes = np.unique(own, return_counts=True)
            _, tokens, vocab = distinct(hashes[a - lead : b])
            common = np.argsort(-np.bincount(tokens), kind="stable")  # small numbers for frequent words: they compress
            tokens, vocab = np.argsort(common)[tokens].astype("<u4"), vocab[common]
            docs = B.pack(base + row + of, doc[of], void[of].astype(np.uint8), held[of].astype(np.uint8), sizes.astype("<i8"), np.array([lead], "<i8"))
            yield pd.DataFrame({"block": [base + number], "docs": [docs], "vocab": [vocab.tobytes()], "tokens": [pressed(tokens.view(np.uint8).reshape(-1, 4).T.tobytes())]})
            number += 1
        row += len(frame)


class Block:
    """A block's runs of each length, as answers to its questions make them known. Lists are by the number of symbols."""

    def __init__(self, row: pd.Series, depth: int, n: int = 0, v: int = 0):
        self.rows, self.docs, self.void, self.held, sizes, lead = B.unpack(row["docs"], "<i8", "<i8", np.uint8, np.uint8, "<i8", "<i8")
        words = np.frombuffer(row["vocab"], "<u8")
        token = np.ascontiguousarray(np.frombuffer(opened(row["tokens"]), np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int32)
        self.depth, self.n, self.v = depth, n, v
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.place = np.arange(len(token), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        self.own = np.ones(len(token), bool)
        self.own[: int(lead[0])] = False
        self.train = self.own & (self.held == 0)[self.owner] & (self.void == 0)[self.owner]
        #: Number of the run that ends at each place, -1 if none is known; hashes of the runs, their order, a place of each. Counts and rests end in one more, for -1.
        self.run, self.hash, self.order, self.at = [None, token], [None, words], [None, np.argsort(words)], [None, None]
        self.count, self.rest, self.asked, self._possible = [None, None], [None], [None], [None]

    def grow(self) -> None:
        """The runs one longer that are needed: both parts occur LEAST times, and what precedes the last symbol may be a retained context, or what follows the first may, as the suffix of one."""
        k = len(self.run)
        good = self.place[1:] >= k - 1
        if k > 2:
            run = self.run[k - 1]
            frequent, may = (self.count[k - 1] >= LEAST)[run], self.possible(k - 1)[run]
            good &= frequent[:-1] & frequent[1:] & (may[:-1] | may[1:] if k <= self.depth else may[:-1])
        at = np.flatnonzero(good) + 1
        width = len(self.hash[1])
        first, number, codes = distinct(self.run[k - 1][at - 1].astype(np.int64) * width + self.run[1][at])
        run = np.full(len(self.place), -1, np.int32)
        run[at] = number
        hashes = B.mix(self.hash[k - 1][codes // width] * _STEP + self.hash[1][codes % width])
        self.run.append(run)
        self.hash.append(hashes)
        self.order.append(np.argsort(hashes))
        self.at.append(at[first])

    def possible(self, k: int) -> np.ndarray:
        """Which runs of k symbols may be retained contexts, by their counts and their suffixes'; one more, for -1, may not."""
        if len(self._possible) == k:
            n = self.count[k][:-1]
            suffix = self.run[k - 1][self.at[k]] if k > 1 else None
            whole = self.n if k == 1 else self.count[k - 1][suffix]
            with np.errstate(divide="ignore", invalid="ignore"):
                may = (n >= LEAST) & (n * np.log(whole / n) >= RETAIN)
            self._possible.append(np.append(may if k == 1 else may & self._possible[k - 1][suffix], False))
        return self._possible[k]

    def learned(self, k: int) -> np.ndarray:
        """How often each run of k symbols ends at a place that is learned from."""
        run = self.run[k][self.train]
        return np.bincount(run[run >= 0], minlength=len(self.hash[k]))

    def ask(self, depth: int) -> None:
        """Settles which contexts of ``depth`` symbols matter here: those that precede a token, may be retained and have a retained suffix."""
        before = np.flatnonzero(self.own & (self.place >= depth)) - 1
        run = self.run[depth][before]
        good = run >= 0
        if depth > 1:
            good &= ~np.isnan(self.rest[depth - 1])[self.run[depth - 1][before]]
        wanted = np.zeros(len(self.hash[depth]), bool)
        wanted[run[good]] = True
        wanted &= self.possible(depth)[:-1]
        order = self.order[depth]
        self.asked.append(order[wanted[order]])

    def sums(self, depth: int) -> tuple[np.ndarray, ...]:
        """(Place among the asked contexts, count, and this block's share of: kept entries, their counts, counts times log of count over parent's share, parents' shares)."""
        k = depth + 1
        local = self.learned(k)
        e = np.flatnonzero((self.count[k][:-1] >= LEAST) & (local > 0))
        at, c = self.at[k][e], self.count[k][e].astype(np.float64)
        whole = self.n if depth == 1 else self.count[depth - 1][self.run[depth - 1][at - 1]]
        q = self.count[depth][self.run[depth][at]] / whole
        of = np.full(len(self.hash[depth]) + 1, -1)
        of[self.asked[depth]] = np.arange(len(self.asked[depth]))
        of = of[self.run[depth][at - 1]]
        good = of >= 0
        of, c, q, local = of[good], c[good], q[good], local[e][good].astype(np.float64)
        size = len(self.asked[depth])
        add = lambda x: np.bincount(of, weights=x, minlength=size)
        total = add(local)
        some = np.flatnonzero(total)
        return (some, self.count[depth][self.asked[depth][some]], *(s[some] for s in (add(local / c), total, add(local * np.log(c / q)), add(local / c * q))))

    def question(self, number: int, n_buckets: int) -> Iterator[tuple[int, bytes]]:
        """(Bucket, payload) of what round ``number`` asks: hashes to count, in round 1 of two lengths, and contexts with their sums."""
        if number > 1:
            self.ask(number - 1)
        if number <= self.depth:
            self.grow()
        counted = [1, 2] if number == 1 else [number + 1] if number <= self.depth else []
        parts = []
        for k in counted:
            hashes = self.hash[k][self.order[k]]
            parts.append((hashes, _edges(hashes, n_buckets), self.learned(k)[self.order[k]]))
        contexts, edges, some = np.empty(0, np.uint64), np.zeros(n_buckets + 1, np.int64), None
        if number > 1:
            contexts = self.hash[number - 1][self.asked[number - 1]]
            edges = _edges(contexts, n_buckets)
            some, *values = self.sums(number - 1)
            cuts = np.searchsorted(some, edges)
        none = np.empty(0, np.int64)
        for b in range(n_buckets):
            out, size = [], 0
            for hashes, of, local in parts:
                span = slice(of[b], of[b + 1])
                out += [*_short(hashes[span]), *squeeze(local[span])]
                size += of[b + 1] - of[b]
            for _ in range(2 - len(parts)):
                out += [none] * 4
            span = slice(edges[b], edges[b + 1])
            out += [*_short(contexts[span])]
            if some is not None:
                own = slice(cuts[b], cuts[b + 1])
                there = np.zeros(edges[b + 1] - edges[b], bool)
                there[some[own] - edges[b]] = True
                out += [np.packbits(there), *squeeze(values[0][own]), values[1][own].astype("<f4"), *squeeze(np.rint(values[2][own]).astype(np.int64)), *(x[own].astype("<f4") for x in values[3:])]
            else:
                out += [none] * 8
            if size + edges[b + 1] - edges[b]:
                yield b, B.pack(*out)

    def hear(self, number: int, answers: list[bytes]) -> None:
        """Takes in the answers of a round, in the order of their buckets."""
        held = [B.unpack(opened(a), np.uint8, "<i8", np.uint8, "<i8", np.uint8, "<f4", "<i8") for a in answers]
        for k, i in ((1, 0), (2, 2)) if number == 1 else ((number + 1, 0),) if number <= self.depth else ():
            told = np.concatenate([np.empty(0, np.int64), *(widen(h[i], h[i + 1]) for h in held)])
            count = np.zeros(len(self.hash[k]) + 1, np.int64)
            count[self.order[k]] = told
            self.count[k:] = [count]
        if number > 1:
            rest = np.full(len(self.hash[number - 1]) + 1, np.nan)
            told = np.concatenate([np.empty(0), *(_rests(h[4], h[5], int(h[6][0])) for h in held)])
            rest[self.asked[number - 1]] = told
            self.rest.append(rest)

    def scores(self) -> pd.DataFrame:
        """(row, doc, void, held, n_tokens, n_known, base, score) of the block's texts or parts of them."""
        at = np.flatnonzero(self.own & (self.hash[1][self.run[1]] != START))
        c = self.count[1][self.run[1][at]]
        p = (c + 1) / (self.n + self.v + 1)
        base, owner, n = np.log10(c + 1.0), self.owner[at], len(self.rows)
        alive = np.arange(len(at))
        for depth in range(1, self.depth + 1):
            alive = alive[self.place[at[alive]] >= depth]
            context = self.run[depth][at[alive] - 1]
            rest = self.rest[depth][context]
            good = ~np.isnan(rest)
            alive, context, rest = alive[good], context[good], rest[good]
            entry = self.count[depth + 1][self.run[depth + 1][at[alive]]]
            share = np.where(entry >= LEAST, (entry - DISCOUNT) / self.count[depth][context], 0.0)
            p[alive] = share + rest * p[alive]
        size = np.bincount(owner, minlength=n)
        return pd.DataFrame(
            {
                "row": self.rows,
                "doc": self.docs,
                "void": self.void.astype(bool),
                "held": self.held.astype(bool),
                "n_tokens": size,
                "n_known": np.bincount(owner, weights=c > 0, minlength=n).astype(np.int64),
                "base": np.bincount(owner, weights=base, minlength=n) - size * np.log10(self.n + self.v + 1.0),
                "score": np.bincount(owner, weights=np.log10(p), minlength=n),
            }
        )


def _edges(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket starts among sorted hashes, and the end."""
    return np.searchsorted(B.bucket_of(hashes, n_buckets), np.arange(n_buckets + 1))


def _short(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of each hash; the bucket tells the others."""
    return (hashes & _LOW).astype("<u4"), (hashes >> np.uint64(32) & _HIGH).astype("<u2")


def _rests(bits: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, np.nan)
    out[np.unpackbits(bits, count=size).astype(bool)] = values
    return out


def _play(row: pd.Series, answers: pd.DataFrame, depth: int, n: int, v: int, rounds: int) -> Block:
    """A block with the answers of the first ``rounds`` rounds."""
    block = Block(row, depth, n, v)
    answers = answers.sort_values(["round", "bucket"])
    for number in range(1, rounds + 1):
        if number > 1:
            block.ask(number - 1)
        if number <= depth:
            block.grow()
        block.hear(number, answers.loc[answers["round"] == number, "payload"].tolist())
    return block


def _asked(block: Block, key: int, number: int, n_buckets: int) -> pd.DataFrame:
    return pd.DataFrame([(b, key, payload) for b, payload in block.question(number, n_buckets)], columns=["bucket", "block", "payload"])


def _first_questions(depth: int, n_buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for _, row in frame.iterrows():
                yield _asked(Block(row, depth), row["block"], 1, n_buckets)
        B.give_back()

    return run


def _questions(depth: int, number: int, n_buckets: int, n: int, v: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _asked(_play(blocks.iloc[0], answers, depth, n, v, number - 1), int(blocks["block"].iloc[0]), number, n_buckets)

    return run


def _scores(depth: int, n: int, v: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _play(blocks.iloc[0], answers, depth, n, v, depth + 1).scores()

    return run


def _wide(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _answers(number: int):
    """Rows (block, round, bucket, n, v, payload): the answer to each block; in round 1 also, for no block, the tokens and distinct tokens of the bucket."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        bucket, blocks = int(group["bucket"].iloc[0]), group["block"].tolist()
        kinds = ("<u4", "<u2", np.uint8, "<i8") * 2 + ("<u4", "<u2", np.uint8, np.uint8, "<i8", "<f4", np.uint8, "<i8", "<f4", "<f4")
        held = [B.unpack(p, *kinds) for p in group["payload"]]
        out, total, known = [[] for _ in blocks], 0, 0
        for i in (0, 4):
            keys = np.concatenate([_wide(h[i], h[i + 1]) for h in held])
            local = np.concatenate([widen(h[i + 2], h[i + 3]) for h in held])
            _, at, names = distinct(keys)
            counts = np.bincount(at, weights=local, minlength=len(names)).astype(np.int64)
            if number == 1 and i == 0:
                real = names != _wide(*(x[0] for x in _short(np.array([START]))))
                total, known = int(counts[real].sum()), int((counts[real] > 0).sum())
            for row, told in zip(out, np.split(counts[at], np.cumsum([len(h[i]) for h in held])[:-1]), strict=True):
                row += squeeze(told)
        sizes = [len(h[8]) for h in held]
        _, at, names = distinct(np.concatenate([_wide(h[8], h[9]) for h in held]))
        begin = np.cumsum([0, *sizes])
        of = at[np.concatenate([np.flatnonzero(np.unpackbits(h[10], count=n)) + b for h, n, b in zip(held, sizes, begin, strict=False)])] if len(at) else at
        add = lambda i: np.bincount(of, weights=np.concatenate([h[i] for h in held]), minlength=len(names))
        n = np.ones(len(names))
        n[of] = np.concatenate([widen(h[11], h[12]) for h in held])
        kept, count, logs, shares = add(13), np.bincount(of, weights=np.concatenate([widen(h[14], h[15]) for h in held]), minlength=len(names)), add(16), add(17)
        left = np.maximum(n - count, 0)
        gain = logs - count * np.log(n) + left * (np.log(np.maximum(left, 1) / n) - np.log(np.maximum(1 - shares, 1e-12)))
        rest = np.where((count > 0) & (gain >= RETAIN), 1 - (count - DISCOUNT * kept) / n, np.nan)
        for row, told in zip(out, np.split(rest[at], begin[1:-1]), strict=True):
            there = ~np.isnan(told)
            row += [np.packbits(there), told[there].astype("<f4"), np.array([len(told)], "<i8")]
        rows = [(block, number, bucket, 0, 0, pressed(B.pack(*x))) for block, x in zip(blocks, out, strict=True)]
        if number == 1:
            rows.append((-1, number, bucket, total, known, None))
        return pd.DataFrame(rows, columns=["block", "round", "bucket", "n", "v", "payload"])

    return run


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    n_buckets = B.bucket_count(input_bytes(docs))
    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    given = docs.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc"), doc_id.isNull().alias("void"), held.alias("held"), "text")
    blocks = cut_by(given.mapInPandas(lambda batches: _tokenise(batches, depth), "block long, docs binary, vocab binary, tokens binary"), "block", n_buckets)
    release(docs.sparkSession)
    asked, told = "bucket int, block long, payload binary", "block long, round int, bucket int, n long, v long, payload binary"
    answers, n, v = None, 0, 0
    for number in range(1, depth + 2):
        if answers is None:
            questions = blocks.mapInPandas(_first_questions(depth, n_buckets), asked)
        else:
            questions = _met(blocks, answers).applyInPandas(B.freed(_questions(depth, number, n_buckets, n, v)), asked)
        new = cut(questions.groupBy("bucket").applyInPandas(B.freed(_answers(number)), told), merged=False)
        release(docs.sparkSession)
        if number == 1:
            total = new.where("block < 0").agg(F.sum("n"), F.sum("v")).first()
            n, v = int(total[0] or 0), int(total[1] or 0)
            answers = new.where("block >= 0")
        else:
            answers = answers.unionByName(new)
    scored = _met(blocks, answers).applyInPandas(B.freed(_scores(depth, n, v)), "row long, doc long, void boolean, held boolean, n_tokens long, n_known long, base double, score double")
    whole = scored.groupBy("row").agg(F.first("doc").alias("doc"), F.first("void").alias("void"), F.first("held").alias("held"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    of = lambda c: F.when(~F.col("void"), F.col(c))
    return whole.select(of("doc").alias("doc_id"), of("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _met(blocks: DataFrame, answers: DataFrame):
    """Each block, which stays where it is, with its answers."""
    return blocks.groupBy("block").cogroup(answers.select("block", "round", "bucket", "payload").groupBy("block"))
