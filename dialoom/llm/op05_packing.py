"""Sum-of-squares packing of tokenised documents into windows of fixed length.

Each document is cut into whole windows and a rest. The rests are placed online: a rest of r
tokens goes to the fill level h, or to a new window, for which the sum over levels of the
squared number of windows partly filled to that level grows least. The numbers of windows are
kept in a level array, so a placement is one numpy minimum over the levels. Documents are
dealt by a hash to shards that grow in number with the input, so that each shard is one bounded
online stream of lengths; token ids never leave the task that makes them.

When a shard ends, the rests in windows still partly filled are cut at powers of two, which
fit together without gaps: whole windows first, then sequences whose length is a power of two.

Defined results: a null or empty text is its end token alone; repeated rows are packed one by
one; an empty table gives no rows; extra columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import blocks as B
from dialoom.session import input_bytes

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of words whose ids a Python worker keeps; beyond it the table starts anew.
CACHED_PIECES = 400_000
SHARD_BYTES = 24 << 20
_NEVER = 1 << 40


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _classes() -> np.ndarray:
    kind = np.full(256, _SYMBOL, dtype=np.uint8)
    kind[65:91] = kind[97:123] = _LETTER
    kind[48:58] = _DIGIT
    kind[:32] = kind[127:] = kind[ord("'")] = _ODD
    kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
    return kind


_SPACE, _LETTER, _DIGIT, _SYMBOL, _ODD, _WHOLE = range(6)
_CLASS = _classes()


def _cut(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(Folded bytes, first byte, end and class of each piece) of a buffer of UTF-8 that ends in a space.

    Pieces are runs of Latin letters, single digits, runs of other ASCII characters, and whole words that hold anything else.
    """
    kind, folded = _CLASS[buffer], B._FOLD.astype(np.uint8)[buffer]
    lead = np.flatnonzero(buffer[:-1] == 0xC3)
    after = buffer[lead + 1]
    lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    capital = lead[buffer[lead + 1] <= 0x9E] + 1
    folded[capital] += 0x20
    kind[np.flatnonzero((buffer[:-1] == ord("<")) & (buffer[1:] == ord("|")))] = _ODD
    if (kind == _ODD).any():
        edge = np.flatnonzero(np.diff((kind != _SPACE).view(np.int8), prepend=0))
        starts, ends = edge[0::2], edge[1::2]
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        whole = odd[ends] > odd[starts]
        starts, sizes = starts[whole], (ends - starts)[whole]
        at = np.repeat(starts, sizes) + B.spans_of(sizes)
        kind[at], folded[at] = _WHOLE, buffer[at]
    border = np.flatnonzero((np.diff(kind, prepend=255) != 0) | (kind == _DIGIT))
    of = kind[border]
    ends = np.append(border[1:], len(buffer))
    good = of != _SPACE
    return folded, border[good], ends[good], of[good]


class WordIds:
    """Ids of texts.

    Tokens of this vocabulary cross neither white space nor the borders between letters, digits
    and other characters, and the last of each such piece is marked. So a text's ids are those of
    its pieces. A table by the pieces' hashes keeps what was encoded before; unseen pieces are
    encoded many at a time. Words with characters whose handling is not plain (outside ASCII and the
    Latin letters of ISO 8859-1, apostrophes, control characters, marks of special tokens) are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.last = np.array([t.endswith("</w>") for t, _ in names])
        self.kind = "<u2" if names[-1][1] < 1 << 16 else "<u4"
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool, self.used = np.empty(1 << 16, self.kind), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(c.ids, dtype=np.int64) for c in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_plain(self, pieces: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            out += np.split(ids, ends[:-1]) if len(ends) == len(part) and ends[-1] == len(ids) else self._encode(part)
        return out

    def _learn(self, hashes: np.ndarray, plain: list[str], odd: list[str], is_plain: np.ndarray) -> None:
        coded = np.empty(len(hashes), dtype=object)
        for flag, ids in ((True, self._encode_plain(plain)), (False, self._encode(odd))):
            for i, x in zip(np.flatnonzero(is_plain == flag).tolist(), ids, strict=True):
                coded[i] = x
        size = np.array([len(x) for x in coded], dtype=np.int32)
        flat = np.concatenate(list(coded)) if len(coded) else np.empty(0, np.int64)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = np.insert(self.hashes, where, hashes), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        parts: list[list[bytes]] = [[] for _ in texts]
        for piece in B._pieces(texts):
            raw = b" ".join(t for _, t in piece) + b" "
            folded, starts, ends, kind = _cut(np.frombuffer(raw, np.uint8))
            if not len(starts):
                continue
            if len(self.hashes) > CACHED_PIECES:
                self._clear()
            up, down = B._BYTES.get(len(folded) + 1)
            prefix = np.zeros(len(folded) + 1, dtype=np.uint64)
            np.cumsum(B._LETTER[folded] * up[: len(folded)], out=prefix[1:])
            value = B.mix((prefix[ends] - prefix[starts]) * down[starts] + (2 * (ends - starts) + (kind == _WHOLE)).astype(np.uint64))
            unique, first, place = np.unique(value, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
            new = np.flatnonzero(self.hashes[at] != unique) if len(self.hashes) else np.arange(len(unique))
            if len(new):
                is_plain = kind[first[new]] != _WHOLE
                low = folded.tobytes()
                spans = list(zip(starts[first[new]].tolist(), ends[first[new]].tolist(), is_plain.tolist(), strict=True))
                self._learn(unique[new], [low[a:b].decode() for a, b, p in spans if p], [raw[a:b].decode("utf-8", "replace") for a, b, p in spans if not p], is_plain)
                at = np.searchsorted(self.hashes, unique)
            size = self.size[at][place]
            index = np.repeat(self.at[at][place], size) + B.spans_of(size)
            ids = self.pool[index].astype("<u4")
            total = np.concatenate([[0], np.cumsum(size)])
            offsets = np.cumsum([0] + [len(t) + 1 for _, t in piece])
            cuts = total[np.searchsorted(starts, offsets)].tolist()
            for (i, _), a, b in zip(piece, cuts, cuts[1:], strict=False):
                parts[i].append(ids[a:b].tobytes())
        return [b"".join(p) if len(p) != 1 else p[0] for p in parts]


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def binary_parts(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _tokenise(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import dialoom.llm.op05_packing as own  # the worker's module, not this pickled function's copy

        encode = own.encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for frame in B.blocks(batches, limit=2 << 20):
            rows = []
            for doc, shard, ids in zip(frame["doc_id"], frame["shard"], encode(list(frame["text"])), strict=True):
                ids += end
                n = len(ids) // 4
                whole, rest = divmod(n, capacity)
                cuts = [capacity * i for i in range(whole + 1)]
                sums = [zlib.crc32(ids[4 * a : 4 * (a + capacity)]) for a in cuts[:-1]]
                last, parts = cuts[-1], []
                at = last
                for size in binary_parts(rest):
                    parts.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
                rows.append((doc, shard, n, sums, zlib.crc32(ids[4 * last :]) if rest else 0, parts))
            yield pd.DataFrame(rows, columns=["doc_id", "shard", "n", "sums", "rest_sum", "parts"])

    return run


class LevelArray:
    """Windows by fill level, and the sum-of-squares rule that chooses among them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for an item of ``size``, 0 < size < capacity; of equal growths the fullest level wins."""
        c, top = self.count, self.capacity - size
        growth = 2 * c[size:] + 1
        growth[top] -= 1
        held = c[1 : top + 1]
        growth[1:] += np.where(held > 0, 1 - 2 * held, _NEVER)
        level = top - int(np.argmin(growth[::-1]))
        if level:
            window = self.open[level].pop()
            c[level] -= 1
        else:
            window = self.made
            self.made += 1
        if level + size < self.capacity:
            self.open[level + size].append(window)
            c[level + size] += 1
        return window, level


def pack_shard(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of given lengths; start and length within the document."""
    levels = LevelArray(capacity)
    held: dict[int, list[tuple[int, int, int, int]]] = {}
    for doc, n in enumerate(lengths.tolist()):
        whole, rest = divmod(n, capacity)
        if rest:
            window, offset = levels.place(rest)
            held.setdefault(window, []).append((doc, whole * capacity, rest, offset))
    partly = {w for level in levels.open for w in level}
    out, number = [], 0
    for window, pieces in held.items():
        if window not in partly:
            out += [(doc, start, size, number, offset) for doc, start, size, offset in pieces]
            number += 1
    for doc, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):
            out.append((doc, k * capacity, capacity, number, 0))
            number += 1
    cut = []
    for window in sorted(partly):
        for doc, start, size, _ in held[window]:
            at = start
            for part in binary_parts(size):
                cut.append((part, doc, at))
                at += part
    cut.sort(key=lambda x: -x[0])
    left = sum(p for p, _, _ in cut)
    goal = [capacity] * (left // capacity) + binary_parts(left % capacity)
    place, filled = 0, 0
    for part, doc, at in cut:
        out.append((doc, at, part, number + place, filled))
        filled += part
        if filled == goal[place]:
            place, filled = place + 1, 0
    return out


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        n = group["n"].to_numpy(dtype=np.int64)
        base = int(group["shard"].iloc[0]) << 36
        rows = []
        docs, sums, rests, parts = (group[c].tolist() for c in ("doc_id", "sums", "rest_sum", "parts"))
        for doc, start, length, sequence, offset in pack_shard(n, capacity):
            whole, rest = divmod(int(n[doc]), capacity)
            if start < whole * capacity:
                crc = sums[doc][start // capacity]
            elif length == rest:
                crc = rests[doc]
            else:
                crc = parts[doc][binary_parts(rest).index(length)]
            rows.append((docs[doc], start, length, int(crc), int(n[doc]), base + sequence, offset))
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece. ``capacity`` is a power of two."""
    shards = max(8, -(-input_bytes(docs) // SHARD_BYTES))
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.expr(f"cast(pmod(xxhash64(doc_id, text), {shards}) as long)").alias("shard"), "text")
    coded = rows.mapInPandas(_tokenise(path, capacity), "doc_id string, shard long, n long, sums array<long>, rest_sum long, parts array<long>")
    out = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return coded.groupBy("shard").applyInPandas(B.freed(_pack(capacity)), out).withColumn("doc_id", F.col("doc_id").cast("long"))
