"""Vector codes: product quantisation by Lloyd's rounds with partition-local heaps.

A vector's components become integers floor(256 x); the vector is cut into 16 equal parts, and each
part position has a codebook of up to 64 entries that starts as that part of the vectors of the
least ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the
lower index) and replaces each entry by the componentwise floor of its parts' mean.

Vectors never move: a task turns its partition into blocks that hold the vectors, the assignments and, for
each part position and entry, a heap of the entry's parts keyed by lower minus upper bound (the distance to
the second-nearest entry minus that to the nearest). When entries move, an entry's parts can change only
if their key is within its cumulative drift (its own move and the largest move of another entry, summed
over the rounds), so the next pass pops just these from the heap, compares them with all entries exactly and
pushes them back. A heap is kept as a sorted run, so all violated parts are popped by one binary search.
Blocks are written to the shared checkpoint folder between passes; what leaves a block is its parts'
change of the entries' sums and counts, which Spark adds up. The codebooks, 64 vectors' worth of integers, are all that
the driver holds.

Defined results: a row whose vector is null or holds null or a non-finite component is dropped; integers
stop at 2**24 on both sides, so that all sums stay exact; a dimension that is no multiple of 16, or a shorter vector, is filled
up with zeros; repeated ids count once among the 64 (their least vector), null as the last; with fewer
ids the codebooks are smaller; a label's error beyond a long is null; repeated rows stay; an empty table gives no rows. Column
names of the input are free, as only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dialoom.llm.components import cut, drop

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integers stop here: a squared distance is then exact in 64 bits for any dimension up to 8192.
MOST = 1 << 24
#: Bytes of vectors in a block, and of distances that are computed at a time.
BLOCK_BYTES = 4 << 20
#: Added to a drift before it is compared with a key: far above what square roots below 2**32 are rounded by.
SLACK = 1e-5


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of list values, filled up with zeros to ``width``."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    whole = np.clip(np.floor(values * float(SCALE)), -MOST, MOST).astype(np.int64)
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return whole.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = whole
    return out


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (parts, entries), exact."""
    total = np.zeros((len(parts), len(book)), np.int64)
    for i in range(parts.shape[1]):
        gap = parts[:, i, None] - book[None, :, i]
        total += gap * gap
    return total


def scan(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Nearest entry, lower minus upper bound) of each part."""
    near, key = np.empty(len(parts), np.int64), np.empty(len(parts))
    step = max(1, BLOCK_BYTES // (8 * len(book)))
    for lo in range(0, len(parts), step):
        d = distances(parts[lo : lo + step], book)
        at = d.argmin(axis=1)
        upper = np.sqrt(d[np.arange(len(d)), at])
        d[np.arange(len(d)), at] = np.iinfo(np.int64).max
        lower = np.sqrt(d.min(axis=1)) if len(book) > 1 else np.inf
        near[lo : lo + step], key[lo : lo + step] = at, lower - upper
    return near, key


class Heaps:
    """The parts of one position in a block, by entry and key."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, first: np.ndarray):
        self.rows, self.keys, self.first = rows, keys, first

    @classmethod
    def built(cls, entry: np.ndarray, rows: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, entry))
        return cls(rows[order], keys[order], np.searchsorted(entry[order], np.arange(entries + 1)))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Removes and returns the rows whose key is within their entry's drift."""
        keep, out = [], []
        for e in range(len(self.first) - 1):
            lo, hi = self.first[e], self.first[e + 1]
            cut_at = lo + np.searchsorted(self.keys[lo:hi], drift[e] + SLACK, side="right")
            out.append(np.arange(lo, cut_at))
            keep.append(np.arange(cut_at, hi))
        gone, stay = np.concatenate(out), np.concatenate(keep)
        popped = self.rows[gone]
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in keep])])
        self.rows, self.keys = self.rows[stay], self.keys[stay]
        return popped

    def push(self, entry: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> Heaps:
        entries = len(self.first) - 1
        old = np.repeat(np.arange(entries), np.diff(self.first))
        return Heaps.built(np.concatenate([old, entry]), np.concatenate([self.rows, rows]), np.concatenate([self.keys, keys]), entries)


def tally(change: np.ndarray, entry: np.ndarray, parts: np.ndarray, sign: int) -> None:
    """Adds ``parts`` to their entries' sums, the count last."""
    for i in range(parts.shape[1]):
        np.add.at(change[:, i], entry, sign * parts[:, i])
    change[:, -1] += sign * np.bincount(entry, minlength=len(change))


def _first_pass(books: np.ndarray, width: int, types: tuple[pa.DataType, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n_entries, d = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * max(width, 1)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                n = batch.num_rows
                vectors = integers(batch.column(2), width).reshape(n, PARTS, d)
                codes = np.empty((PARTS, n), np.uint8)
                change = np.zeros((PARTS, n_entries, d + 1), np.int64)
                heaps = []
                for p in range(PARTS):
                    near, keys = scan(vectors[:, p], books[p])
                    codes[p] = near
                    tally(change[p], near, vectors[:, p], 1)
                    heaps.append(Heaps.built(near, np.arange(n), keys, n_entries))
                yield _block(batch.column(0), batch.column(1), vectors, codes, heaps, change, types)

    return run


def _block(ids: pa.Array, labels: pa.Array, vectors: np.ndarray, codes: np.ndarray, heaps: list[Heaps], change: np.ndarray, types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    return pa.RecordBatch.from_arrays(
        [
            one(ids, types[0]),
            one(labels, types[1]),
            pa.array([vectors.astype("<i4").tobytes()], pa.binary()),
            pa.array([codes.tobytes()], pa.binary()),
            pa.array([np.concatenate([h.rows for h in heaps]).astype("<i4").tobytes()], pa.binary()),
            pa.array([np.concatenate([h.keys for h in heaps]).astype("<f8").tobytes()], pa.binary()),
            pa.array([np.concatenate([h.first for h in heaps]).astype("<i4").tobytes()], pa.binary()),
            one(pa.array(change.ravel()), pa.int64()),
        ],
        names=["ids", "labels", "vectors", "codes", "heap_rows", "heap_keys", "heap_first", "change"],
    )


def _reassigned(row: dict, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[Heaps], np.ndarray]:
    """A block after the entries have moved: (vectors, codes, heaps, change)."""
    n_entries, d = books.shape[1:]
    codes = np.frombuffer(row["codes"], np.uint8).reshape(PARTS, -1).copy()
    n = codes.shape[1]
    vectors = np.frombuffer(row["vectors"], "<i4").astype(np.int64).reshape(n, PARTS, d)
    rows = np.frombuffer(row["heap_rows"], "<i4").reshape(PARTS, n)
    keys = np.frombuffer(row["heap_keys"], "<f8").reshape(PARTS, n)
    first = np.frombuffer(row["heap_first"], "<i4").reshape(PARTS, n_entries + 1)
    change = np.zeros((PARTS, n_entries, d + 1), np.int64)
    heaps = []
    for p in range(PARTS):
        heap = Heaps(rows[p], keys[p], first[p])
        popped = heap.pop(drift[p])
        near, slack = scan(vectors[popped, p], books[p])
        old = codes[p, popped].astype(np.int64)
        moved = near != old
        tally(change[p], old[moved], vectors[popped[moved], p], -1)
        tally(change[p], near[moved], vectors[popped[moved], p], 1)
        codes[p, popped] = near
        heaps.append(heap.push(near, popped, slack + drift[p][near]))
    return vectors, codes, heaps, change


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """One block at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield one, {name: one.column(name)[0].as_py() for name in names}


_HELD = ["vectors", "codes", "heap_rows", "heap_keys", "heap_first"]


def _next_pass(books: np.ndarray, drift: np.ndarray, types: tuple[pa.DataType, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, row in _rows(batches, _HELD):
            yield _block(one.column("ids").flatten(), one.column("labels").flatten(), *_reassigned(row, books, drift), types)

    return run


def _last_pass(books: np.ndarray, drift: np.ndarray, types: tuple[pa.DataType, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, row in _rows(batches, _HELD):
            vectors, codes, _, _ = _reassigned(row, books, drift)
            error = np.zeros(len(vectors), np.int64)
            for p in range(PARTS):
                gap = vectors[:, p] - books[p][codes[p]]
                error += (gap * gap).sum(axis=1)
            texts = np.ascontiguousarray(codes.T).tobytes().hex()
            code = pa.array([texts[i : i + 2 * PARTS] for i in range(0, len(texts), 2 * PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([one.column("ids").flatten().cast(types[0]), one.column("labels").flatten().cast(types[1]), code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _seed_books(kept: DataFrame, width: int) -> np.ndarray:
    """(Parts, entries, part width): the parts of the least ids' vectors; at most 64 vectors come to the driver."""
    by_id = F.col("id").asc_nulls_last()
    least = [r[0] for r in kept.select("id").orderBy(by_id).limit(ENTRIES).collect()]
    if len(least) == ENTRIES > len(set(least)):
        least = [r[0] for r in kept.select("id").distinct().orderBy(by_id).limit(ENTRIES).collect()]
    match = F.col("id").isin([i for i in least if i is not None])
    found = kept.where(match | F.col("id").isNull() if None in least else match).groupBy("id").agg(F.min("vector").alias("vector")).orderBy(by_id).collect()
    rows = integers(pa.array([r["vector"] for r in found], pa.list_(pa.float64())), width)
    return rows.reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2)


def _totals(blocks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of all blocks' changes."""
    out = np.zeros(int(np.prod(shape)), np.int64)
    for place, n in blocks.select(F.posexplode("change").alias("place", "n")).where("n != 0").groupBy("place").agg(F.sum("n")).collect():
        out[place] = n
    return out.reshape(shape)


def moved(books: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; unused entries stay."""
    count = totals[..., -1:]
    return np.where(count > 0, totals[..., :-1] // np.maximum(count, 1), books)


def drifted(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Cumulative drift by (part, entry): own move plus the largest other one."""
    move = np.sqrt(((new - old) ** 2).sum(axis=2))
    top = np.sort(move, axis=1)
    largest = top[:, -1:]
    other = np.where(move == largest, top[:, -2:-1], largest) if move.shape[1] > 1 else np.zeros_like(move)
    return drift + move + other


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every kept row, the codebooks by part, entry and component)."""
    values = F.col(vector).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), values.alias("vector"))
    kept = kept.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    id_type, label_type = kept.schema["id"].dataType, kept.schema["label"].dataType
    out_type = T.StructType([T.StructField("vec_id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], out_type), np.zeros((PARTS, 0, 0), np.int64)
    width = -(-longest // PARTS) * PARTS
    types = (to_arrow_type(id_type), to_arrow_type(label_type))
    block_type = T.StructType(
        [T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type))]
        + [T.StructField(name, T.BinaryType()) for name in _HELD]
        + [T.StructField("change", T.ArrayType(T.LongType()))]
    )
    books = _seed_books(kept, width)
    shape = (PARTS, books.shape[1], books.shape[2] + 1)
    blocks = cut(kept.mapInArrow(_first_pass(books, width, types), block_type), merged=False)
    totals, drift = _totals(blocks, shape), np.zeros(books.shape[:2])
    for i in range(rounds):
        new = moved(books, totals)
        drift, books = drifted(drift, books, new), new
        if i < rounds - 1:
            later = cut(blocks.mapInArrow(_next_pass(books, drift, types), block_type), merged=False)
            totals = totals + _totals(later, shape)
            drop(blocks)
            blocks = later
    found = cut(blocks.mapInArrow(_last_pass(books, drift, types), out_type), merged=False)
    drop(blocks)
    return found, books


def digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    found, books = compress(vectors)
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    out = found.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} as materialized (select rid, part, min(dist * {ENTRIES} + entry) as best from (
    select p.rid, p.part, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) as dist
    from parts p join b{r} b on p.part = b.part) group by rid, part)""")
        if r < ROUNDS:
            steps.append(f"""
b{r + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{r} b left join (
    select part, entry, list((s - ((s % n) + n) % n) // n order by i) as v from (
        select p.part, a.best % {ENTRIES} as entry, u.i, sum(p.v[u.i])::bigint as s, count(*) as n
        from parts p join a{r} a on p.rid = a.rid and p.part = a.part, lateral (select unnest(range(1, len(p.v) + 1)) as i) u
        group by all) group by part, entry) m on b.part = m.part and b.entry = m.entry)""")
    last = f"a{ROUNDS}"
    return f"""
with kept as materialized (select row_number() over () as rid, vec_id, label, embedding as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0),
dims as (select (max(len(x)) + {PARTS - 1}) // {PARTS} as d from kept),
whole as materialized (select rid, vec_id, label, list_resize(list_transform(x, lambda y: greatest(least(floor({SCALE} * y::double), {MOST}), {-MOST})::bigint), d * {PARTS}, 0) as v, d from kept, dims),
parts as materialized (select rid, t.part, v[t.part * d + 1 : (t.part + 1) * d] as v from whole, range({PARTS}) t(part)),
seeds as (select row_number() over (order by vec_id nulls last) - 1 as entry, v, d from (select vec_id, min(v) as v, any_value(d) as d from whole group by vec_id) qualify row_number() over (order by vec_id nulls last) <= {ENTRIES}),
b0 as materialized (select t.part, entry, v[t.part * d + 1 : (t.part + 1) * d] as v from seeds, range({PARTS}) t(part)),{",".join(steps)},
coded as (select rid, string_agg(printf('%02x', (best % {ENTRIES})::int), '' order by part) as code, sum(best // {ENTRIES})::bigint as error from {last} group by rid),
books as (select sha256(coalesce(string_agg(array_to_string(v, ','), ',' order by part, entry), '')) as codebooks_sha256 from b{ROUNDS})
select w.vec_id, c.code, c.error, (sum(c.error) over (partition by w.label))::bigint as label_error, codebooks_sha256
from whole w join coded c on w.rid = c.rid, books
"""


ORACLE = _oracle()
