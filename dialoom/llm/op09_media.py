"""Media columns as progressive JPEG: documents stored in coefficients, decoded to RGB tensors.

``decode`` reads progressive JPEG: it accumulates spectral-selection and successive-approximation
scans into coefficient arrays, inverse-transforms them in numpy, repeats chroma to full
resolution and returns an RGB tensor. Scans whose Huffman tables give every symbol the
same number of bits, values included, are decoded as arrays; any other scan symbol by symbol.

``encode`` stores bytes losslessly in quantised coefficients, the format's unit: with quantisers
of one, each 64 bytes are the 64 coefficients of a block in zigzag order, byte b as b + 2
below 128 and as 126 - b from there on. No coefficient is then zero after the first
approximation, so all scans have fixed-length symbols. The image has 4:2:0 chroma; each
component has a first and a refining scan of its DC, two bands of first AC scans and a refining AC scan.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal values;
repeated rows each give a row; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import blocks as B

WIDTH_MCUS, MOST_ROWS = 64, 4095
BANDS = ((1, 5), (6, 63))


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[1] if (c[0] + c[1]) % 2 == 0 else c[0]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()


def _inverse_dct() -> np.ndarray:
    """(zigzag coefficient, sample) matrix of the inverse transform of one block."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(basis, basis).T[ZIGZAG].astype(np.float32)


INVERSE = _inverse_dct()


class Huffman:
    """A table given by its code counts for lengths 1 to 16 and its symbols."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.codes: dict[tuple[int, int], int] = {}
        self.of: dict[int, tuple[int, int]] = {}
        code, at = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[length, code] = symbols[at]
                self.of[symbols[at]] = (code, length)
                code, at = code + 1, at + 1
            code <<= 1

    def fixed(self, runs: bool) -> int:
        """Bits of every symbol with its value if that is one number and, for AC tables, no symbol has a run; else 0."""
        if runs and any(s >> 4 or not s & 15 for s in self.symbols):
            return 0
        totals = {length + (s & 15) for s, (_, length) in self.of.items()}
        return totals.pop() if len(totals) == 1 else 0

    def values(self, bits: int) -> np.ndarray:
        """The value of each word of ``bits`` bits of a fixed table."""
        out = np.zeros(1 << bits, dtype=np.int32)
        for s, (code, _) in self.of.items():
            size = s & 15
            raw = np.arange(1 << size)
            out[(code << size) + raw] = _signed(raw, size)
        return out


def _signed(raw: np.ndarray, size: int) -> np.ndarray:
    return np.where(raw >> max(size - 1, 0) & 1, raw, raw - (1 << size) + 1) if size else raw * 0


def _table(length_of: dict[int, int]) -> tuple[bytes, bytes]:
    """Counts and symbols of a table with given code lengths."""
    order = sorted(length_of, key=lambda s: (length_of[s], s))
    return bytes(sum(1 for s in order if length_of[s] == n) for n in range(1, 17)), bytes(order)


DC_TABLE = _table({s: 9 - s for s in range(9)})
AC_TABLE = _table({s: 8 - s for s in range(1, 8)})
EOB_TABLE = _table({n << 4: 4 for n in range(15)})


def _words(table: Huffman, low: int, high: int) -> np.ndarray:
    """Code and value bits, as one number, of each value from low to high."""
    out = []
    for v in range(low, high + 1):
        size = abs(v).bit_length()
        code = table.of[size][0] if size in table.of else 0
        out.append((code << size) + (v if v >= 0 else v + (1 << size) - 1))
    return np.array(out)


_BYTE = np.arange(256)
_VALUE = np.where(_BYTE < 128, _BYTE + 2, 126 - _BYTE).astype(np.int16)
_DC_WORDS = _words(Huffman(*DC_TABLE), -256, 255)
_AC_BYTE = _words(Huffman(*AC_TABLE), -64, 64)[(np.sign(_VALUE) * (np.abs(_VALUE) >> 1)) + 64].astype(np.uint8)
_LOW_BIT = (np.abs(_VALUE) & 1).astype(np.uint8)
_BACK = np.zeros(512, dtype=np.uint8)
_BACK[_VALUE + 256] = _BYTE


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DQT = _segment(0xDB, b"\0" + b"\1" * 64)
_DHT = _segment(0xC4, b"\x00" + b"".join(DC_TABLE) + b"\x10" + b"".join(AC_TABLE) + b"\x11" + b"".join(EOB_TABLE))
_SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))


def _sos(component: int, start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, 1 if high else 0, start, end, high << 4 | low]))


def _stuffed(bits: np.ndarray) -> bytes:
    spare = -len(bits) % 8
    if spare:
        bits = np.concatenate([bits, np.ones(spare, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


_BITS9 = ((_DC_WORDS[:, None] >> np.arange(8, -1, -1)) & 1).astype(np.uint8)


def _correction(low: np.ndarray) -> np.ndarray:
    """Bits of a refining AC scan over blocks whose coefficients are all known not to be zero."""
    out, at = [], 0
    eob = Huffman(*EOB_TABLE).of
    while at < len(low):
        n = min((len(low) - at).bit_length() - 1, 14)
        run = min(len(low) - at, (2 << n) - 1)
        code, length = eob[n << 4]
        head = (code << n) + run - (1 << n)
        out += [np.array([head >> i & 1 for i in range(length + n - 1, -1, -1)], np.uint8), low[at : at + run].ravel()]
        at += run
    return np.concatenate(out)


def grid(mcus: int, most_rows: int = MOST_ROWS) -> tuple[int, int]:
    """(Rows, columns) of an image of so many MCUs: WIDTH_MCUS columns, more where the rows would be too many for the format's 16 bits."""
    wide = min(mcus, max(WIDTH_MCUS, -(-mcus // most_rows)))
    return -(-mcus // wide), wide


def encode(payload: bytes, most_rows: int = MOST_ROWS) -> bytes:
    """A progressive JPEG whose coefficients are ``payload``, of a positive multiple of 64 bytes."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    high, wide = grid(-(-len(data) // 6), most_rows)
    if len(data) < 6 * wide * high:
        data = np.concatenate([data, np.zeros((6 * wide * high - len(data), 64), np.uint8)])
    n = wide * high
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in _SAMPLING)
    first, last = [], []
    for (i, _, _), part in zip(_SAMPLING, (data[: 4 * n], data[4 * n : 5 * n], data[5 * n :]), strict=True):
        dc = _VALUE[part[:, 0]]
        first += [_sos(i, 0, 0, 0, 1), _stuffed(_BITS9[np.diff(dc >> 1, prepend=0) + 256].ravel())]
        coded = _AC_BYTE[part]
        for a, b in BANDS:
            last += [_sos(i, a, b, 0, 1), coded[:, a : b + 1].tobytes()]
        last += [_sos(i, 0, 0, 1, 0), _stuffed((dc & 1).astype(np.uint8)), _sos(i, 1, 63, 1, 0), _stuffed(_correction(_LOW_BIT[part[:, 1:]]))]
    return b"".join([b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _DQT, _segment(0xC2, frame), _DHT, *first, *last, b"\xff\xd9"])


class _Bits:
    """Bits of one scan, read one after the other."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        raw = self.take(size)
        return raw if not size or raw >> (size - 1) else raw - (1 << size) + 1


def _ac_first(bits: _Bits, table: Huffman, blocks: np.ndarray, start: int, end: int, low: int) -> None:
    skip = 0
    for block in blocks:
        if skip:
            skip -= 1
            continue
        k = start
        while k <= end:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                block[k] = bits.value(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.take(run) - 1
                break


def _ac_refine(bits: _Bits, table: Huffman, blocks: np.ndarray, start: int, end: int, low: int) -> None:
    step, skip = 1 << low, 0

    def correct(block: np.ndarray, k: int) -> None:
        if bits.take(1):
            block[k] += step if block[k] > 0 else -step

    for block in blocks:
        k = start
        while not skip and k <= end:
            run, size = divmod(bits.symbol(table), 16)
            new = 0
            if size:
                new = step if bits.take(1) else -step
            elif run < 15:
                skip = (1 << run) + bits.take(run)
                break
            while k <= end:
                if block[k]:
                    correct(block, k)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if k <= end:
                if new:
                    block[k] = new
                k += 1
        if skip:
            for k in range(k, end + 1):
                if block[k]:
                    correct(block, k)
            skip -= 1


_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


class Image:
    """Coefficients of the components as scans add to them: one array (rows of blocks, columns, 64) each, in zigzag order."""

    def __init__(self, frame: bytes):
        _, self.height, self.width, n = struct.unpack(">BHHB", frame[:6])
        self.ids, self.sampling, self.quantiser = [], [], []
        for i in range(n):
            c, hv, q = frame[6 + 3 * i : 9 + 3 * i]
            self.ids.append(c)
            self.sampling.append((hv >> 4, hv & 15))
            self.quantiser.append(q)
        self.h, self.v = (max(s[k] for s in self.sampling) for k in (0, 1))
        self.mcus = (-(-self.height // (8 * self.v)), -(-self.width // (8 * self.h)))
        self.coefficients = [np.zeros((self.mcus[0] * v, self.mcus[1] * h, 64), np.int16) for h, v in self.sampling]

    def order(self, parts: list[int]) -> list[tuple[int, np.ndarray]]:
        """(Component, its blocks in a scan's order); more parts than one are interleaved by MCU."""
        if len(parts) == 1:
            i = parts[0]
            h, v = self.sampling[i]
            rows, cols = -(-self.height * v // (8 * self.v)), -(-self.width * h // (8 * self.h))
            return [(i, self.coefficients[i][:rows, :cols])]
        return [(i, self.coefficients[i]) for i in parts]

    def scan(self, head: bytes, data: bytes, tables: dict[int, Huffman]) -> None:
        n = head[0]
        parts = [self.ids.index(head[1 + 2 * k]) for k in range(n)]
        chosen = [head[2 + 2 * k] for k in range(n)]
        start, end, approx = head[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        if n > 1:
            self._interleaved(parts, chosen, data, tables, high, low)
            return
        i, blocks = self.order(parts)[0]
        flat = blocks.reshape(-1, 64)
        whole = np.shares_memory(flat, blocks)
        if start == 0:
            self._dc(flat, data, tables.get(chosen[0] >> 4), high, low)
        elif high == 0:
            self._ac(flat, data, tables[16 + (chosen[0] & 15)], start, end, low)
        else:
            self._refine(flat, data, tables[16 + (chosen[0] & 15)], start, end, low)
        if not whole:
            blocks[...] = flat.reshape(blocks.shape)

    def _interleaved(self, parts: list[int], chosen: list[int], data: bytes, tables: dict[int, Huffman], high: int, low: int) -> None:
        """A DC scan of several components."""
        bits, last = _Bits(data), [0] * len(parts)
        for y in range(self.mcus[0]):
            for x in range(self.mcus[1]):
                for k, i in enumerate(parts):
                    h, v = self.sampling[i]
                    for b in range(h * v):
                        block = self.coefficients[i][y * v + b // h, x * h + b % h]
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            last[k] += bits.value(bits.symbol(tables[chosen[k] >> 4]))
                            block[0] = last[k] * (1 << low)

    @staticmethod
    def _dc(flat: np.ndarray, data: bytes, table: Huffman | None, high: int, low: int) -> None:
        n = len(flat)
        if high:
            flat[:, 0] |= np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.int16) << low
            return
        width = table.fixed(False)
        if width:
            raw = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
            diffs = table.values(width)[raw @ (1 << np.arange(width - 1, -1, -1))]
        else:
            bits = _Bits(data)
            diffs = np.array([bits.value(bits.symbol(table)) for _ in range(n)])
        flat[:, 0] = np.cumsum(diffs) * (1 << low)

    @staticmethod
    def _ac(flat: np.ndarray, data: bytes, table: Huffman, start: int, end: int, low: int) -> None:
        n, k = len(flat), end - start + 1
        if table.fixed(True) == 8 and len(data) >= n * k:
            flat[:, start : end + 1] = (table.values(8) * (1 << low)).astype(np.int16)[np.frombuffer(data, np.uint8, n * k).reshape(n, k)]
        else:
            _ac_first(_Bits(data), table, flat, start, end, low)

    @staticmethod
    def _refine(flat: np.ndarray, data: bytes, table: Huffman, start: int, end: int, low: int) -> None:
        band = flat[:, start : end + 1]
        bits = _Bits(data)
        if not band.all():
            _ac_refine(bits, table, flat, start, end, low)
            return
        at, k = 0, end - start + 1
        while at < len(flat):
            run, size = divmod(bits.symbol(table), 16)
            if size or run == 15:
                raise ValueError("a filled band has no new coefficients")
            n = min((1 << run) + bits.take(run), len(flat) - at)
            up = bits.bits[bits.at : bits.at + n * k].reshape(n, k).astype(np.int16) << low
            bits.at += n * k
            part = band[at : at + n]
            part += np.where(part > 0, up, -up)
            at += n


def read(jpeg: bytes) -> tuple[Image, dict[int, np.ndarray], bytes]:
    """(Coefficients, quantisers, the comment) of a progressive JPEG without restart intervals."""
    at, image, comment = 2, None, b""
    tables: dict[int, Huffman] = {}
    quantisers: dict[int, np.ndarray] = {}
    while at < len(jpeg):
        marker = jpeg[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            image = Image(body)
        elif marker == 0xDD and body != b"\0\0":
            raise ValueError("restart intervals are not handled")
        elif marker == 0xDA:
            end = _END.search(jpeg, at)
            stop = end.start() if end else len(jpeg)
            image.scan(body, jpeg[at:stop].replace(b"\xff\0", b"\xff"), tables)
            at = stop
    return image, quantisers, comment


_TABLES: dict[tuple[bytes, bytes], Huffman] = {}


def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    if (counts, symbols) not in _TABLES:
        _TABLES[counts, symbols] = Huffman(counts, symbols)
        table, of = _TABLES[counts, symbols], Huffman.values
        cached: dict[int, np.ndarray] = {}
        table.values = lambda bits: cached.setdefault(bits, of(table, bits)) if bits not in cached else cached[bits]
    return _TABLES[counts, symbols]


def to_rgb(image: Image, quantisers: dict[int, np.ndarray]) -> np.ndarray:
    """The (height, width, 3) tensor: inverse transform, chroma repeated to full resolution, colour conversion."""
    planes = []
    for coefficients, q, (h, v) in zip(image.coefficients, image.quantiser, image.sampling, strict=True):
        rows, cols, _ = coefficients.shape
        table = quantisers[q]
        raw = coefficients.reshape(-1, 64).astype(np.float32)
        samples = (raw if (table == 1).all() else raw * table.astype(np.float32)) @ INVERSE
        plane = samples.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * cols)
        plane = np.clip(np.rint(plane + np.float32(128)), 0, 255)
        planes.append(np.repeat(np.repeat(plane, image.v // v, axis=0), image.h // h, axis=1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    out = np.empty((image.height, image.width, 3), np.uint8)
    for k, channel in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, k] = np.clip(np.rint(channel), 0, 255)
    return out


def payload_of(image: Image, comment: bytes) -> bytes:
    """The bytes that ``encode`` stored."""
    n = struct.unpack(">Q", comment)[0]
    flat = np.concatenate([c.reshape(-1) for c in image.coefficients])[:n]
    return _BACK[flat + 256].tobytes()


def decode(jpeg: bytes) -> np.ndarray:
    """The RGB tensor of a progressive JPEG."""
    image, quantisers, _ = read(jpeg)
    return to_rgb(image, quantisers)


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or (64 if not text else 0))


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in B.blocks(batches, limit=2 << 20):
        yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": [len(t) for t in frame["text"]], "media": [encode(padded(t)) for t in frame["text"]]})


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a progressive JPEG."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(_store, "doc_id string, n_bytes long, media binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _tensors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for i in range(0, len(frame), 16):
            part = frame.iloc[i : i + 16]
            rgb = [decode(bytes(m)) for m in part["media"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "height": [t.shape[0] for t in rgb], "width": [t.shape[1] for t in rgb], "rgb": [t.tobytes() for t in rgb]})


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb): the full-resolution tensor of each stored image, row-major with channels last."""
    rows = media.where(F.col("media").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "media").mapInPandas(_tensors, "doc_id string, height int, width int, rgb binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in B.blocks(batches, column="media", limit=2 << 20):
        rows = []
        for doc, n, media in zip(frame["doc_id"], frame["n_bytes"], frame["media"], strict=True):
            image, quantisers, comment = read(media)
            payload = payload_of(image, comment)
            rgb = to_rgb(image, quantisers)
            sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
            feature = f"{image.width}x{image.height}:" + ",".join(f"{s / (image.width * image.height):.4f}" for s in sums)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, image.height, image.width, hashlib.sha256(rgb).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """Per row: what was stored, and what was read back from the stored bytes, the tensor among it."""
    out = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb_sha256 string"
    return store(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_digest, out).withColumn("doc_id", F.col("doc_id").cast("long"))
