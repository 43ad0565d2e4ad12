"""Jaccard self-join on five-word shingle sets by PartEnum signatures, and its components.

Sets of similarity 3/4 or more have sizes within a factor 4/3 and differ in at most (a + b) / 7
elements. Sizes are cut into bands of that factor; a set takes part in its own band's instance and
in the next. An instance divides the feature domain (64-bit hashes) into n1 parts of N2 cells
and, for each part, enumerates the subsets of N2 - K2 cells: the set's elements in such a subset are one
signature. Two sets that differ in at most k elements differ in at most K2 cells of some part if n1 is
at least (k + 1) / (K2 + 1), so they share a signature. Empty subsets give none: a
set whose filled cells are too few for that proof takes part again with finer cells, in
the end with one element for each, where the proof always holds.

Signatures go through the block shuffle, straight from the rows; copies are joined in a block and again in a bucket, and no text is
shuffled for them. Up to SMALL sets of one signature give all pairs; more
give a star around the least. Where that leaves a signature's sets in several components, those outside the
largest one are compared with the others, by sketch and in blocks of bounded size: small sketches tell which sets have open pairs at all; each of these yields its nearest few of
other components, which are verified, and the sets still apart yield more in the next round, until nothing is left. Every pair is verified on
whole sets; a parity sketch, whose distance cannot exceed the sets', goes first. Only texts of open pairs
travel, once for all their pairs: they meet where the least partner's do.

Defined results: exact copies are joined beforehand and linked; texts of one to four words have one
shingle, the whole sequence; null or blank texts have none and are linked with nothing;
rows with a null doc_id belong to components but never name one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm import blocks as B
from dialoom.llm.components import cut, drop, joined_components, release
from dialoom.llm.texts import text_key
from dialoom.session import input_bytes

SHINGLE = 5
N2, K2 = 2, 1
SPARE = 1.15
SMALL, LOCAL = 3, 64
CHUNK, STAR = 2048, 128
#: How many partners a set yields in the first round of what stars leave, and how many times more in each later one.
NEAREST, MORE = 4, 16
#: Keys of 16 bytes that may be broadcast to pick the texts or rows that are needed; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Rows of a written table of pairs or labels that may be broadcast to joins.
BROADCAST_PAIRS = 50_000
LEAST_BITS, BITS_EACH = 512, 4
#: Texts that are signed at a time, in bytes.
BLOCK = 3 << 20


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, owner = B.words_of(texts, fold=True)
    first = B.doc_bounds(owner, len(texts))
    n = first[1:] - first[:-1]
    counts = np.where(n >= size, n - size + 1, 0)
    starts = np.repeat(first[:-1], counts) + B.spans_of(counts)
    hashes = B.window_hash(words, starts, size, 5)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i in range(len(texts)):
        if counts[i]:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        elif n[i]:
            out.append(B.mix(B.window_hash(words, first[i : i + 1], int(n[i]), 5) + np.uint64(n[i])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bands(largest: int) -> np.ndarray:
    """Upper sizes of the bands 0, 1, ... up to one beyond ``largest``."""
    tops, low = [], 1
    while not tops or tops[-1] <= largest * 4 // 3 + 1:
        tops.append(low * 4 // 3)
        low = tops[-1] + 1
    return np.array(tops, dtype=np.int64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) for all signatures of non-empty ``sets``."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    mixed = B.mix(elements ^ np.uint64(0xA5A5A5A5))
    tops = bands(int(sizes.max()))
    home = np.searchsorted(tops, sizes)
    found, owners = [], []
    for ahead in (0, 1):
        band = home + ahead
        top = tops[band]
        partner = np.minimum(top, sizes * 4 // 3)
        take = (sizes > 0) & ((ahead == 0) | (partner > tops[home]))
        differ = (sizes + partner) // 7
        n1 = np.maximum(1, np.ceil(SPARE * (2 * top // 7 + 1) / (K2 + 1)).astype(np.int64))
        for level in range(3):
            if not take.any():
                break
            part = n1 if level == 0 else n1 * 4
            here = take[owner]
            at, o = elements[here], owner[here]
            if level == 2:
                code = B.mix(at + (band[o] * 8 + 7).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                found.append(code)
                owners.append(o)
                break
            cells = part * N2
            base = np.zeros(len(sets) + 1, dtype=np.int64)
            np.cumsum(np.where(take, cells, 0), out=base[1:])
            place = base[o] + ((at >> np.uint64(32)) * cells[o].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            total = int(base[-1])
            edge = np.flatnonzero(np.diff(place, prepend=-1))
            sums, filled = np.zeros(total, np.uint64), np.zeros(total, bool)
            sums[place[edge]] = np.add.reduceat(mixed[here], edge)
            filled[place[edge]] = True
            sums, filled = sums.reshape(-1, N2), filled.reshape(-1, N2)
            row_owner = np.repeat(np.arange(len(sets)), np.where(take, part, 0))
            row = np.arange(len(row_owner)) - (base[:-1] // N2)[row_owner]
            for number, subset in enumerate(combinations(range(N2), N2 - K2)):
                some = filled[:, subset].any(axis=1)
                label = ((band[row_owner] * 8 + level) << 34) + (row << 6) + number
                code = B.mix(sums[:, subset].sum(axis=1) + B.mix(label.astype(np.uint64)))
                found.append(code[some])
                owners.append(row_owner[some])
            proof = np.zeros(len(sets), dtype=np.int64)
            np.add.at(proof, row_owner, np.minimum(filled.sum(axis=1), K2 + 1))
            take = take & (proof <= differ)
    return np.concatenate(found), np.concatenate(owners)


def _ids(keys: list[bytes]) -> np.ndarray:
    """The first 8 bytes of each key, in the keys' order."""
    return np.frombuffer(b"".join(k[:8] for k in keys), dtype=">u8").astype(np.uint64)


def _sign(n_buckets: int):
    """Rows (bucket, kind, payload): kind 0 entries of a bucket; kind 1 a block's share of a signature that many of its sets have; kind 2 key, size and sketch of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in B.blocks(batches, limit=BLOCK):
            frame = frame.drop_duplicates("key")
            keys = list(frame["key"])
            sets = shingle_sets(list(frame["text"]))
            ids = _ids(keys)
            sketches = [parity(s).tobytes() for s in sets]
            n = np.array([len(s) for s in sets], "<u4")
            about = []
            for bucket, part in B.by_bucket(B.bucket_of(B.mix(ids), n_buckets)):
                of = part.tolist()
                about.append((bucket, 2, B.pack(b"".join(keys[i] for i in of), n[part], np.array([len(sketches[i]) for i in of], "<u4"), b"".join(sketches[i] for i in of))))
            yield pd.DataFrame(about, columns=["bucket", "kind", "payload"])
            codes, owner = signatures(sets)
            if not len(codes):
                continue
            order = np.argsort(codes, kind="stable")
            codes, owner = codes[order], owner[order]
            head = np.flatnonzero(np.diff(codes, prepend=codes[0] + np.uint64(1)))
            size = np.diff(np.append(head, len(codes)))
            rows = []
            send = np.ones(len(codes), dtype=bool)
            large = size > LOCAL
            for h, n in zip(head[large].tolist(), size[large].tolist(), strict=True):
                held = np.unique(ids[owner[h : h + n]])
                code = int(codes[h])
                send[h : h + n] = False
                send[h + int(np.flatnonzero(ids[owner[h : h + n]] == held[0])[0])] = True
                bucket = int(B.bucket_of(codes[h : h + 1], n_buckets)[0])
                rows.append((code % n_buckets, 1, B.pack(_whole_code(codes[h : h + 1] & np.uint64(0xFFFFFFFF), bucket), held.astype("<u8"))))
            flag = np.repeat(large, size)[send]
            codes, owner = codes[send], owner[send]
            for bucket, part in B.by_bucket(B.bucket_of(codes, n_buckets)):
                at = part[np.argsort(owner[part], kind="stable")]
                docs, counts = np.unique(owner[at], return_counts=True)
                rows.append((bucket, 0, B.pack(ids[docs], counts.astype("<u4"), codes[at].astype("<u4"), flag[at].astype(np.uint8))))
            yield pd.DataFrame(rows, columns=["bucket", "kind", "payload"])

    return run


def _whole_code(low: np.ndarray, bucket: int) -> np.ndarray:
    """One name for a bucket's signature; a block's share of it gets the same."""
    return B.mix(low.astype(np.uint64) + (np.uint64(bucket) << np.uint64(32)))


def _candidates(group: pd.DataFrame) -> pd.DataFrame:
    """Rows (kind, a, b, key, bits, small): kind 0 candidate pairs of ids; kind 1 a signature of many sets (a) and one of them (b); kind 2 id, size, key, sketch and small sketch of a text."""
    pairs, many = [], []
    own = [B.unpack(p, "<u8", "<u8") for p in group.loc[group["kind"] == 1, "payload"]]
    for code, held in own:
        pairs.append(np.stack([np.full(len(held) - 1, held[0]), held[1:]], axis=1))
        many.append(np.stack([np.full(len(held), code[0]), held], axis=1))
    held = [B.unpack(p, "<u8", "<u4", "<u4", np.uint8) for p in group.loc[group["kind"] == 0, "payload"]]
    if held:
        ids = np.concatenate([np.repeat(h[0], h[1]) for h in held])
        codes = np.concatenate([h[2] for h in held])
        flags = np.concatenate([h[3] for h in held])
        bucket = int(group["bucket"].iloc[0])
        order = np.lexsort((ids, codes))
        codes, ids, flags = codes[order], ids[order], flags[order]
        head = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])]))
        codes, ids, flags = codes[head], ids[head], np.maximum.reduceat(flags, head)  # copies in other blocks
        head = np.flatnonzero(np.diff(codes, prepend=codes[0] ^ np.uint32(1)))
        size = np.diff(np.append(head, len(codes)))
        for n in range(2, SMALL + 1):
            at = head[size == n]
            if len(at):
                table = ids[at[:, None] + np.arange(n)]
                for i, j in combinations(range(n), 2):
                    pairs.append(table[:, [i, j]])
        marked = np.add.reduceat(flags.astype(np.int64), head) > 0
        large = np.flatnonzero((size > SMALL) | marked)
        if len(large):
            mark = np.where(marked[large], np.arange(len(large)).astype(np.uint64), np.add.reduceat(B.mix(ids), head)[large])
            large = large[np.unique(mark, return_index=True)[1]]
            sizes = size[large]
            at = np.repeat(head[large], sizes) + B.spans_of(sizes)
            pairs.append(np.stack([np.repeat(ids[head[large]], sizes), ids[at]], axis=1))
            many.append(np.stack([np.repeat(_whole_code(codes[head[large]], bucket), sizes), ids[at]], axis=1))
    texts: dict[bytes, tuple[int, bytes]] = {}
    for payload in group.loc[group["kind"] == 2, "payload"]:
        keys, n, sizes, bits = B.unpack(payload, bytes, "<u4", "<u4", bytes)
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        for i, (size, end) in enumerate(zip(sizes.tolist(), ends, strict=True)):
            texts.setdefault(keys[16 * i : 16 * i + 16], (int(n[i]), bits[end - size : end]))
    own_keys = list(texts)
    out = [pd.DataFrame({"kind": 2, "a": _ids(own_keys).view(np.int64), "b": np.array([texts[k][0] for k in own_keys], np.int64), "key": own_keys, "bits": [texts[k][1] for k in own_keys], "small": [small_sketch(texts[k][1]) for k in own_keys]})]
    for kind, found in ((0, pairs), (1, many)):
        if found:
            p = np.concatenate(found)
            if kind == 0:
                p = np.sort(p, axis=1)
                p = p[p[:, 0] != p[:, 1]]
            p = p[np.lexsort((p[:, 1], p[:, 0]))]
            p = p[np.concatenate([[True], (p[1:] != p[:-1]).any(axis=1)])] if len(p) else p
            out.append(pd.DataFrame({"kind": kind, "a": p[:, 0].view(np.int64), "b": p[:, 1].view(np.int64), "key": None, "bits": None, "small": None}))
    return pd.concat(out, ignore_index=True)


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each residue of the hashes, set if an odd number of elements has it; a power of two of bits, BITS_EACH or more for each element."""
    n = max(LEAST_BITS, 1 << (BITS_EACH * len(s) - 1).bit_length() if len(s) else 1)
    return np.packbits((np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8))


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """The sketch of n bytes, out of one with as many or more."""
    while len(bits) > n:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def small_sketch(bits: bytes) -> bytes:
    """The sketch folded to a bit or more for each element, LEAST_BITS at least."""
    return folded(np.frombuffer(bits, np.uint8), max(len(bits) // BITS_EACH, LEAST_BITS // 8)).tobytes()


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of elements in which the two sets differ."""
    n = min(len(a), len(b))
    return int(np.bitwise_count((folded(a, n) ^ folded(b, n)).view(np.uint64)).sum(dtype=np.int64))


def _near(a: str, b: str, n: Column) -> Column:
    """Whether the sketches' distance leaves room for a difference of n / 7 elements."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([7 * distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= m for x, y, m in zip(a, b, n, strict=True)], dtype=bool)

    return near(a, b, n)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def _verify(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    sets = {}
    for at in range(0, len(texts), 128):
        part = texts.iloc[at : at + 128]
        sets.update(zip(part["key"], shingle_sets([t.encode("utf-8", "surrogatepass") for t in part["text"]]), strict=True))
    good = [linked(sets[a], sets[b]) for a, b in zip(pairs["a"], pairs["b"], strict=True)]
    return pairs.loc[good, ["a", "b"]] if len(pairs) else pd.DataFrame({"a": [], "b": []}, dtype=object)


def _few(df: DataFrame) -> bool:
    """Whether the written table has so few rows that it, or what its rows make, is broadcast rather than dealt."""
    return df.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS


def _verified(near: DataFrame, texts: DataFrame, n_buckets: int, few: bool) -> DataFrame:
    """The pairs (a, b), a < b, whose texts are linked. Each text goes to the bucket of its least partner, in shares of STAR texts."""
    small = F.broadcast if few else lambda df: df
    least = near.groupBy("b").agg(F.min("a").alias("m"))
    shares = least.groupBy("m").agg(F.expr(f"cast(ceil(count(*) / {STAR}) as int)").alias("shares"))
    placed = near.join(small(least), "b").join(small(shares), "m")
    placed = placed.select("a", "b", F.expr(f"cast(pmod(xxhash64(m, pmod(xxhash64(b), shares)), {n_buckets}) as int)").alias("bucket"))
    needed = placed.select((F.col("bucket") + 0).alias("spot"), F.explode(F.array("a", "b")).alias("key")).distinct()
    there = texts.select("key", "text").join(small(needed), "key").select("spot", "key", "text")
    return placed.groupBy("bucket").cogroup(there.groupBy("spot")).applyInPandas(B.freed(_verify), "a binary, b binary")


def _across(most: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Rows (code, x, y, more): of a signature a set and one of its ``most`` nearest that size and sketch leave open, of other components; whether it has further ones.

        If ``most`` is 0, a row (code, x) for each set that has one or is one.

        Only sets within one block of a signature, and of its two sides, are compared; of two, x is that of the component with fewer sets there.
        """
        group = group.sort_values(["code", "kind", "i", "j", "key"]).reset_index(drop=True)
        sides, size, keys = group["side"].to_numpy(), group["n"].to_numpy(), group["key"].tolist()
        parts = pd.factorize(group["label"].map(bytes))[0]
        bits = [np.frombuffer(c, dtype=np.uint8) for c in group["bits"]]
        block = group[["code", "kind", "i", "j"]].to_numpy()
        cuts = np.flatnonzero((np.diff(block, axis=0) != 0).any(axis=1)) + 1
        rows = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
            width = min(len(c) for c in bits[lo:hi])
            low = np.stack([folded(c, width) for c in bits[lo:hi]]).view(np.uint64)
            of, at, share = np.unique(parts[lo:hi], return_inverse=True, return_counts=True)
            rank = np.empty(len(of), np.int64)
            rank[np.lexsort((of, share))] = np.arange(len(of))
            rank = rank[at]
            n, s, some = size[lo:hi], sides[lo:hi], np.zeros(hi - lo, bool)
            for i in range(hi - lo):
                rest = np.flatnonzero((rank > rank[i]) & (4 * np.minimum(n, n[i]) >= 3 * np.maximum(n, n[i])) & ((s != s[i]) | (s[i] == 0)))
                if not len(rest):
                    continue
                far = np.bitwise_count(low[rest] ^ low[i]).sum(axis=1, dtype=np.int64)
                good = 7 * far <= n[rest] + n[i]
                rest, far = rest[good], far[good]
                for k, j in enumerate(rest.tolist()):
                    if not len(bits[lo + i]) == width == len(bits[lo + j]):
                        far[k] = distance(bits[lo + i], bits[lo + j])
                good = 7 * far <= n[rest] + n[i]
                rest, far = rest[good], far[good]
                some[i] |= len(rest) > 0
                some[rest] = True
                for j in rest[np.argsort(far, kind="stable")[:most]].tolist():
                    rows.append((int(block[lo, 0]), keys[lo + i], keys[lo + j], len(rest) > most))
            if not most:
                rows += [(int(block[lo, 0]), keys[lo + i], None, False) for i in np.flatnonzero(some).tolist()]
        return pd.DataFrame(rows, columns=["code", "x", "y", "more"]).astype({"more": bool})

    return run


def _residual(many: DataFrame, about: DataFrame, labels: DataFrame, n_buckets: int, most: int) -> DataFrame:
    """Rows (code, x, y, more) as of ``_across`` among the sets (code, key) of signatures that many have.

    A signature's largest component is dealt against the other sets only, so a set travels once for each CHUNK of these, with
    its whole sketch or, to find which sets have open pairs at all (``most`` 0), its small one, which leaves open all that the whole one does.
    """
    of = labels.select(F.col("id").alias("key"), "label")
    member = many.join(F.broadcast(of) if _few(labels) else of, "key", "left").select("code", "key", F.coalesce("label", "key").alias("label"))
    print_of = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(name) for k, name in ((0, "f"), (1, "g"))]
    by_part = member.groupBy("code", "label").agg(F.count("*").alias("size"), *print_of)
    spread = by_part.groupBy("code").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max("size").alias("top"), F.max_by("label", F.struct("size", "label")).alias("largest"), F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g"))
    # Signatures of the same sets are one.
    spread = spread.where("parts > 1").groupBy("size", "f", "g").agg(F.min(F.struct("code", "top", "largest")).alias("s"))
    spread = spread.select("s.code", "s.largest", F.expr(f"cast(ceil((size - s.top) / {CHUNK}) as int)").alias("few"), F.expr(f"cast(ceil(s.top / {CHUNK}) as int)").alias("large"))
    dealt = member.join(spread, "code").withColumn("main", F.col("label") == F.col("largest"))
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(key), if(main, large, few)) as int)"))
    among = "transform(sequence(0, few - 1), k -> named_struct('kind', 0, 'i', least(own, k), 'j', greatest(own, k), 'side', case when own = k then 0 when own < k then 1 else 2 end))"
    against = "transform(sequence(0, large - 1), k -> named_struct('kind', 1, 'i', own, 'j', k, 'side', 1))"
    met = "transform(sequence(0, few - 1), k -> named_struct('kind', 1, 'i', k, 'j', own, 'side', 2))"
    dealt = dealt.select("code", "key", "label", F.explode(F.expr(f"if(main, {met}, concat({among}, {against}))")).alias("b")).join(about.select("key", "n", F.col("bits" if most else "small").alias("bits")), "key")
    dealt = dealt.select("code", "key", "label", "n", "bits", "b.*").withColumn("bucket", F.expr(f"cast(pmod(xxhash64(code, kind, i, j), {4 * n_buckets}) as int)"))
    return dealt.groupBy("bucket").applyInPandas(B.freed(_across(most)), "code long, x binary, y binary, more boolean")


def _near_pairs(pairs: DataFrame, about: DataFrame, by: str) -> DataFrame:
    """(a, b), keys, a < b, of the pairs (a, b) of ids or keys whose sizes and sketches leave a link open."""
    left, right = (about.select(F.col(by).alias(c), F.col("key").alias(f"key_{c}"), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    near = pairs.join(left, "a").join(right, "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    near = near.where(_near("bits_a", "bits_b", F.col("n_a") + F.col("n_b")))
    return near.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))


def _linked_pairs(pairs: DataFrame, docs: DataFrame, n_buckets: int) -> DataFrame:
    """The pairs (a, b) of keys, a < b, that are linked; where few texts are in them, these are picked without dealing all texts."""
    few = _few(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    keys = keys if few else keys.distinct()
    own = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")
    if few or keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        own = own.join(F.broadcast(keys), "key", "left_semi")
    texts = own.groupBy("key").agg(F.first("text").alias("text"))
    found = cut(_verified(pairs, texts, n_buckets, few), merged=False)
    release(docs.sparkSession)
    return found


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n) of every distinct text, and (id, label) of those with links: the least key of the component."""
    n_buckets = B.bucket_count(input_bytes(docs), 10 << 20)
    given = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")
    kept = given.mapInPandas(_sign(n_buckets), "bucket int, kind int, payload binary").groupBy("bucket").applyInPandas(B.freed(_candidates), "kind int, a long, b long, key binary, bits binary, small binary")
    kept = cut(kept, merged=False)
    release(docs.sparkSession)
    many = kept.where("kind = 1").select(F.col("a").alias("code"), F.col("b").alias("id")).distinct()
    about = kept.where("kind = 2").select("key", F.col("a").alias("id"), F.col("b").alias("n"), "bits", "small")
    near = cut(_near_pairs(kept.where("kind = 0").select("a", "b").distinct(), about, "id"), merged=False)
    release(docs.sparkSession)
    links = _linked_pairs(near, docs, 4 * n_buckets)
    drop(near)
    labels = joined_components(links)
    many = many.join(about.select("id", "key"), "id").select("code", "key")
    many = cut(_residual(many, about, labels, n_buckets, 0).select("code", F.col("x").alias("key")).distinct(), merged=False)
    release(docs.sparkSession)
    most, tried = NEAREST, None
    while True:
        rest = cut(_residual(many, about, labels, n_buckets, most), merged=False)
        release(docs.sparkSession)
        pairs = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = cut(_near_pairs(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), about, "key"), merged=False)
        if pairs.limit(1).count():
            found = _linked_pairs(pairs, docs, 4 * n_buckets)
            if found.limit(1).count():
                links = links.unionByName(found)
                labels = joined_components(links)
        if not rest.where("more").limit(1).count():
            return about.select("key", "n"), labels
        many = cut(many.join(rest.where("more").select("code").distinct(), "code", "left_semi"))  # all others have yielded all
        tried = pairs if tried is None else tried.unionByName(pairs)
        most *= MORE


def components(docs: DataFrame) -> DataFrame:
    """``docs``' doc_id with _key, n_shingles and _label, the key of the component; _label is null for texts without words."""
    about, labels = link_classes(docs)
    known = about.join(labels.withColumnRenamed("id", "key"), "key", "left")
    known = known.select(F.col("key").alias("_key"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("_label"))
    return docs.withColumn("_key", text_key(F.col("text"))).join(known, "_key", "left").withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0)))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = components(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "_label")
    least = rows.where(F.col("_label").isNotNull()).groupBy("_label").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "_label", "left").select("doc_id", "n_shingles", F.when(F.col("_label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the least doc_id, and every row without words; columns as given. Rows equal in all columns are one."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64(*names).alias("h"))
    about, labels = link_classes(docs)
    known = about.where("n > 0").join(labels.withColumnRenamed("id", "key"), "key", "left").select(F.col("key").alias("_key"), F.coalesce("label", "key").alias("_label"))
    # What loses is found on narrow rows, one for each text; whole rows travel only if their text is in several rows, or if such texts are many.
    own = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("_key"), order.alias("_order")).groupBy("_key").agg(F.min("_order").alias("_order"), F.count("*").alias("c"))
    own = own.join(known, "_key")
    won = own.groupBy("_label").agg(F.min(F.struct("_order", "_key")).alias("w"), F.sum("c").alias("rows")).where("rows > 1").select("_label", "w")
    met = cut(own.join(won, "_label").select(F.col("_key").alias("k"), "c", F.when(F.col("_key") == F.col("w._key"), F.col("w._order.h")).alias("won"), F.lit(True).alias("met")))
    if met.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        met = F.broadcast(met)
    rows = docs.select(F.struct(*names).alias("_row"), text_key(F.col("text")).alias("k"), F.xxhash64(*names).alias("h"))
    one = rows.join(met, "k", "left").where("met is null or h = won")
    several = one.where("met and c > 1").groupBy("k").agg(F.first("_row").alias("_row")).select("_row.*")
    return one.where("met is null or c = 1").select("_row.*").unionByName(several)
