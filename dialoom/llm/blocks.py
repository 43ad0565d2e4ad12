"""Vectorised word hashing and the block shuffle that operators on word windows share.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the UTF-8 text.
A word's hash is a polynomial over its bytes modulo 2**64 and a window's hash the same over
its words, both through prefix sums, so a block of texts costs a few numpy passes.

The block shuffle sends, instead of a row for each hash, one row for each pair of task
block and bucket that holds packed arrays. Equal hashes of one block are joined before the
shuffle, so that a hash in a third of all rows costs its bucket one entry for each block.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np

PIECE_BYTES = (1 << 20) - (1 << 12)
SEGMENT_WORDS = 1 << 18
BLOCK_BYTES = 4 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd(seed: int) -> int:
    return int(mix(np.array([seed], dtype=np.uint64))[0]) | 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 12, 1 << (n - 1).bit_length())
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint64)
        done, step = 1, base
        while done < size:
            n = min(done, size - done)
            out[done : done + n] = out[:n] * np.uint64(step)
            done, step = done + n, step * step % (1 << 64)
        return out


_BYTES, _WORDS = Powers(11), {}
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Texts in lists of about PIECE_BYTES; longer ones are cut at white space."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE_BYTES:
            cut = at + PIECE_BYTES
            while cut < len(text) and not _WHITE[text[cut]]:
                cut += 1
            if held:
                yield held
            yield [(i, text[at:cut])]
            held, size, at = [], 0, cut
        held.append((i, text[at:] if at else text))
        size += len(text) - at
        if size >= PIECE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _lanes() -> np.ndarray:
    lane = np.full(256, 1 << 48, dtype=np.uint64)
    lane[97:123] = lane[128:] = 1
    lane[65:91] = 1 << 16
    lane[48:58] = 1 << 32
    return lane


_LANE = _lanes()


def _shape(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of a word's mix of lower, upper, digit and other characters, of its length's band and of a last character that is no letter."""
    prefix = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_LANE[buffer], out=prefix[1:])
    held = prefix[ends] - prefix[starts]
    lower, upper, digit, other = (((held >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4))
    last = buffer[ends - 1].astype(np.int64)
    last[(_LANE[last] & np.uint64(0x1FFFF)) != 0] = 0
    band = np.minimum(np.log2(ends - starts).astype(np.int64), 7)
    code = (lower > 0) + 2 * np.minimum(upper, 2) + 6 * (digit > 0) + 12 * np.minimum(other, 3) + 48 * band + 384 * last
    return mix(code.astype(np.uint64) + np.uint64(1))


def words_of(texts: list[bytes], fold: bool = False, shapes: bool = False) -> tuple[np.ndarray, ...]:
    """Hash and text number of every word, in order; with ``shapes`` also a hash of what kinds of characters it has."""
    letters = _LETTER[_FOLD] if fold else _LETTER
    hashes, owners, forms = [], [], []
    for piece in _pieces(texts):
        buffer = np.frombuffer(b" ".join(t for _, t in piece) + b" ", dtype=np.uint8)
        inside = ~_WHITE[buffer]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            continue
        up, down = _BYTES.get(len(buffer) + 1)
        prefix = np.empty(len(buffer) + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum(letters[buffer] * up[: len(buffer)], out=prefix[1:])
        value = (prefix[ends] - prefix[starts]) * down[starts]
        hashes.append(mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        offsets = np.cumsum([len(t) + 1 for _, t in piece])
        numbers = np.array([i for i, _ in piece], dtype=np.int64)
        owners.append(numbers[np.searchsorted(offsets, starts, side="right")])
        if shapes:
            forms.append(_shape(buffer, starts, ends))
    if not hashes:
        hashes, owners, forms = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    return (np.concatenate(hashes), np.concatenate(owners)) + ((np.concatenate(forms),) if shapes else ())


def window_hash(words: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` words from each start on, starts rising; in segments, so that the tables of powers stay small."""
    powers = _WORDS.setdefault(seed, Powers(seed))
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(words), SEGMENT_WORDS):
        lo, hi = np.searchsorted(starts, (at, at + SEGMENT_WORDS))
        if lo == hi:
            continue
        part = words[at : at + SEGMENT_WORDS + width]
        up, down = powers.get(len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=prefix[1:])
        own = starts[lo:hi] - at
        out[lo:hi] = mix((prefix[own + width] - prefix[own]) * down[own])
    return out


def doc_bounds(owners: np.ndarray, n: int) -> np.ndarray:
    """Index of the first word of each of ``n`` texts, and the end."""
    return np.searchsorted(owners, np.arange(n + 1))


def spans_of(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - first


def give_back() -> None:
    """Returns freed memory to the system: a Python worker stays for later tasks, beside the executor's own memory."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(work: Callable) -> Callable:
    """``work`` on a group, or on two, that gives back what it used."""

    def one(group):
        out = work(group)
        give_back()
        return out

    def two(left, right):
        out = work(left, right)
        give_back()
        return out

    return two if work.__code__.co_argcount == 2 else one


def blocks(batches: Iterable, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator:
    """Pandas frames of about ``limit`` bytes of text each, out of Arrow's batches; texts become bytes."""
    import pandas as pd

    held, size = [], 0
    for frame in batches:
        if not len(frame):
            continue
        frame = frame.assign(**{column: [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t) for t in frame[column]]})
        at = 0
        ends = np.cumsum([len(t) for t in frame[column]])
        while at < len(frame):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            held.append(frame.iloc[at:to])
            size += int(ends[to - 1]) - before
            at = to
            if size >= limit:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
    held.clear()
    gc.collect()
    give_back()


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one string; ``unpack`` needs the same dtypes."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], dtype="<u8").tobytes() + b"".join(parts)


def unpack(data: bytes, *dtypes: str | type) -> list:
    n = len(dtypes)
    sizes = np.frombuffer(data, dtype="<u8", count=n).astype(np.int64)
    out, at = [], 8 * n
    for kind, size in zip(dtypes, sizes, strict=True):
        part = data[at : at + size]
        out.append(part if kind is bytes else np.frombuffer(part, dtype=kind))
        at += size
    return out


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high half of a hash; its low half stays as a key inside the bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the positions of its entries, in their order."""
    order = np.argsort(buckets, kind="stable")
    held = buckets[order]
    cuts = np.flatnonzero(np.diff(held)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Positions of one entry for each value, positions of all entries of values that repeat)."""
    order = np.argsort(values, kind="stable")
    held = values[order]
    same = np.zeros(len(held), dtype=bool)
    if len(held):
        equal = held[1:] == held[:-1]
        same[1:] = equal
        head = ~same
        twice = same.copy()
        twice[:-1] |= equal
        return order[head], order[twice]
    return order, order


def bucket_count(n_bytes: int, per_bucket: int = 6 << 20, least: int = 48) -> int:
    """Buckets grow with the input so that each stays about as large."""
    return max(least, -(-n_bytes // per_bucket))
