"""Repair of conversations' structure by a time-major dynamic programme over tensors.

A repaired conversation's role initials must read ``(s?(ua)+)?``: an optional system turn, then pairs of user and assistant.
An automaton of four states (start, after system, after user, after assistant) reads them. Conversations
are bucketed by length; going back in time, the least costs of all conversations of a bucket from every
state on are updated at once for each turn, and all turns' costs are stored. The edits are then traced forward, again for all
conversations at once; of equally cheap edits the ASCII-least letter is taken (D, I, K, R), which makes the audit the ASCII-least.
Outside the start state each letter leads to one state, so an audit fixes the repaired roles.

Costs of turns compose (a stretch of turns is a matrix of least costs from state to state), so a conversation of
more than ``LONG_BYTES`` is no single task's work: its rows are cut into segments of ``SEGMENT_BYTES`` by running totals; each segment gives
its matrix, the matrices of one conversation (128 bytes for each segment) give every segment's first state and the costs beyond it, and the segments are traced on
their own. Only what the result itself has in sequence, the audit and the SHA-256 of all turns, passes through one task
for each conversation, as a stream of segments.

Defined results: damage takes a null of any column as one space in its hash and a null role or text as one space; a null turn stays null
and comes first; a null conv_id is a conversation; rows of one turn are ordered by role and text; an
empty role has an empty initial; repeated rows are turns of their own; an empty table gives no rows; other columns
are not read. Costs and counts are longs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dialoom.llm.components import cut, drop
from dialoom.operators.running import running_total

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 40
#: State after a user or assistant turn that an edit makes, by state.
MADE = np.array([USER, USER, ASSISTANT, USER])
#: State after a kept turn, by initial (system, user, assistant, other) and state; 4: not allowed.
KEPT = np.array([[SYSTEM, 4, 4, 4], [USER, USER, 4, USER], [4, 4, ASSISTANT, 4], [4, 4, 4, 4]])
#: Least costs from each state on at the end of a conversation.
END = np.array([0, 2 * INSERT, INSERT, 0])
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}

LONG_BYTES = 16 << 20
SEGMENT_BYTES = 4 << 20
#: Bytes that a row counts for besides its text.
ROW_BYTES = 1 << 10
#: Up to so many ids of long conversations are broadcast.
FEW_LONG = 10_000


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): the rows after damage; a dropped row stays with there = false, so that its conversation does."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    out = given.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), times)))
    return out.drop("col")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with blank and truncated, as far as a row alone tells."""
    tail = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    blank = tail == ""
    return rows.withColumn("blank", blank).withColumn("cut_short", ~blank & ~F.substring(tail, -1, 1).isin(".", "!", "?"))


def backward(initial: np.ndarray, bad: np.ndarray, short: np.ndarray, absent: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs (turns + 1, conversations, states) from each turn and state on; arguments are (turns, conversations), ``end`` (conversations, states)."""
    turns, n = initial.shape
    cost = np.empty((turns + 1, n, 4), np.int64)
    cost[turns] = end
    later = np.full((n, 5), INF)
    for t in range(turns - 1, -1, -1):
        later[:, :4] = cost[t + 1]
        keep, rerole = _turn_costs(later, initial[t], bad[t], short[t])
        best = np.minimum(np.minimum(later[:, :4] + DELETE, keep), rerole)
        best = np.minimum(best, INSERT + best[:, MADE])
        best = np.minimum(best, INSERT + best[:, MADE])
        cost[t] = np.where(absent[t][:, None], later[:, :4], best)
    return np.minimum(cost, INF)


def _turn_costs(later: np.ndarray, initial: np.ndarray, bad: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    extra = (TRUNCATED * short + INF * bad)[:, None]
    return extra + np.take_along_axis(later, KEPT[initial], axis=1), extra + REROLE + later[:, MADE]


def trace(cost: np.ndarray, initial: np.ndarray, bad: np.ndarray, short: np.ndarray, absent: np.ndarray, start: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Edits as letters (conversations, slots), 0 where there is none; ``final``: the conversation ends here, so missing turns are put in at the end."""
    turns, n = initial.shape
    letters = np.zeros((n, 3 * turns + 2), np.uint8)
    state, at = start.copy(), np.arange(n)
    later = np.full((n, 5), INF)
    for t in range(turns):
        later[:, :4] = cost[t + 1]
        keep, _ = _turn_costs(later, initial[t], bad[t], short[t])
        open_ = ~absent[t]
        for i in range(3):
            now = cost[t, at, state]
            delete = open_ & (later[at, state] + DELETE == now)
            insert = open_ & ~delete & (INSERT + cost[t, at, MADE[state]] == now)
            kept = open_ & ~delete & ~insert & (keep[at, state] == now)
            rerole = open_ & ~delete & ~insert & ~kept
            letters[:, 3 * t + i] = np.select([delete, insert, kept, rerole], [ord("D"), ord("I"), ord("K"), ord("R")], 0)
            state = np.select([insert | rerole, kept], [MADE[state], KEPT[initial[t], state]], state)
            open_ = insert
    for i in range(2):
        insert = final & ((state == SYSTEM) | (state == USER))
        letters[insert, 3 * turns + i] = ord("I")
        state = np.where(insert, MADE[state], state)
    return letters


class Piece:
    """One conversation, or one segment of a long one."""

    __slots__ = ("key", "turns", "roles", "texts", "blank", "short", "double", "start", "end", "final")

    def __init__(self, key: tuple, start: int = START, end: np.ndarray = END, final: bool = True):
        self.key, self.start, self.end, self.final = key, start, end, final
        self.turns, self.roles, self.texts, self.blank, self.short, self.double = [], [], [], [], [], []

    def mark_doubles(self) -> None:
        """Turns whose role and text were there before."""
        seen = set()
        for role, text in zip(self.roles, self.texts, strict=True):
            self.double.append((role, text) in seen)
            seen.add((role, text))


def _buckets(pieces: list[Piece]) -> Iterator[tuple[list[Piece], tuple[np.ndarray, ...]]]:
    """Pieces of like length, with their (initial, bad, short, absent) tensors, turns first."""
    by_length = defaultdict(list)
    for piece in pieces:
        by_length[(len(piece.roles) - 1).bit_length() if piece.roles else -1].append(piece)
    for group in by_length.values():
        longest = max(len(p.roles) for p in group)
        initial = np.full((longest, len(group)), 3)
        bad, short, absent = (np.full((longest, len(group)), x) for x in (False, False, True))
        for i, p in enumerate(group):
            n = len(p.roles)
            initial[:n, i] = [INITIALS.get(r[:1], 3) for r in p.roles]
            bad[:n, i] = np.array(p.blank, bool) | np.array(p.double, bool)
            short[:n, i] = p.short
            absent[:n, i] = False
        yield group, (initial, bad, short & ~bad, absent)


def repaired(piece: Piece, audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits."""
    state, i = piece.start, 0
    for letter in audit:
        if letter == "I":
            state = int(MADE[state])
            yield ("user" if state == USER else "assistant"), ""
            continue
        role, text = piece.roles[i], piece.texts[i]
        i += 1
        if letter == "K":
            state = int(KEPT[INITIALS[role[0]], state])
            yield role, text
        elif letter == "R":
            state = int(MADE[state])
            yield ("user" if state == USER else "assistant"), text


def solved(pieces: list[Piece]) -> Iterator[tuple[Piece, int, str]]:
    """(Piece, least cost, audit)."""
    for group, tensors in _buckets(pieces):
        cost = backward(*tensors, np.array([p.end for p in group]))
        letters = trace(cost, *tensors, np.array([p.start for p in group]), np.array([p.final for p in group]))
        for i, p in enumerate(group):
            yield p, int(cost[0, i, p.start]), letters[i].tobytes().replace(b"\0", b"").decode()


def _counts(piece: Piece) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, each turn by its first fault, and illegal neighbours."""
    double = [d and not b for b, d in zip(piece.blank, piece.double, strict=True)]
    short = [s and not d for s, d in zip(piece.short, double, strict=True)]
    return sum(piece.blank), sum(double), sum(short), sum(a[:1] + b[:1] not in LEGAL for a, b in zip(piece.roles, piece.roles[1:], strict=False))


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str], bounds: bool = False) -> Iterator[list[Piece]]:
    """Lists of whole pieces from rows sorted by ``keys``, of about SEGMENT_BYTES each."""
    held, size, piece = [], 0, None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for i, key in enumerate(zip(*[columns[k] for k in keys], strict=True)):
            if piece is None or piece.key != key:
                if piece is not None:
                    held.append(piece)
                    if size >= SEGMENT_BYTES:
                        yield held
                        held, size = [], 0
                piece = Piece(key, columns["start"][i], np.array(columns["end"][i]), columns["final"][i]) if bounds else Piece(key)
            size += ROW_BYTES // 8
            if columns["there"][i]:
                size += len(columns["text"][i])
                piece.turns.append(columns["turn"][i])
                piece.roles.append(columns["role"][i])
                piece.texts.append(columns["text"][i])
                piece.blank.append(columns["blank"][i])
                piece.short.append(columns["cut_short"][i])
                if "double" in columns:
                    piece.double.append(columns["double"][i])
    if piece is not None:
        held.append(piece)
        yield held


RESULT = [("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]


def _schema(first: T.DataType, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", first), *[T.StructField(name, kind) for name, kind in fields]])


def _whole(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Results of conversations that a task holds whole."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches, ["conv_id"]):
            rows = []
            for p in pieces:
                p.mark_doubles()
            for p, cost, audit in solved(pieces):
                turns = {t for t in p.turns if t is not None}
                gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
                text = "\n".join(f"{role}:{text}" for role, text in repaired(p, audit))
                rows.append((p.key[0], gaps, *_counts(p), cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            yield batch_of(rows, arrow)

    return run


def to_arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _matrices(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each segment's least costs from state to state."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches, ["conv_id", "segment"]):
            rows = []
            for group, tensors in _buckets(pieces):
                wide = [np.repeat(x, 4, axis=1) for x in tensors]
                end = np.tile(np.where(np.eye(4, dtype=bool), 0, INF), (len(group), 1))
                cost = backward(*wide, end)[0].reshape(len(group), 4, 4)  # (piece, end state, state)
                rows += [(*p.key, c.T.ravel().tolist()) for p, c in zip(group, cost, strict=True)]
            yield batch_of(rows, arrow)

    return run


def _bounds(frame: pd.DataFrame) -> pd.DataFrame:
    """First states and later costs of one conversation's segments, from their matrices."""
    frame = frame.sort_values("segment")
    matrices = [np.array(m).reshape(4, 4) for m in frame["matrix"]]
    after, costs = END, []
    for m in reversed(matrices):
        costs.append(after)
        after = np.minimum((m + after[None, :]).min(axis=1), INF)
    costs.reverse()
    return pd.DataFrame({"conv_id": frame["conv_id"].array, "segment": frame["segment"].array, "end": [c.tolist() for c in costs], "final": [False] * (len(costs) - 1) + [True]})


def _traced(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each segment traced from every state it may begin in: end states, audits and repaired turns."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches, ["conv_id", "segment"], bounds=True):
            found = defaultdict(dict)
            for state in range(4):
                for p in pieces:
                    p.start = state
                for p, cost, audit in solved(pieces):
                    found[id(p)][state] = (cost, audit)
            rows = []
            for p in pieces:
                audits, ends, texts = [], [], []
                for state in range(4):
                    p.start = state
                    audit = found[id(p)][state][1]
                    turns = list(repaired(p, audit))
                    audits.append(audit)
                    ends.append({"s": SYSTEM, "u": USER, "a": ASSISTANT}[turns[-1][0][0]] if turns else state)
                    texts.append("\n".join(f"{role}:{text}" for role, text in turns) if turns else None)
                turns = {t for t in p.turns if t is not None}
                edge = (min(turns), max(turns), len(turns)) if turns else (None, None, 0)
                rows.append((*p.key, [found[id(p)][s][0] for s in range(4)], ends, audits, texts, p.roles[0][:1], p.roles[-1][:1], *edge, *_counts(p)))
            yield batch_of(rows, arrow)

    return run


def _joined(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Results of long conversations from their segments in order, as a stream."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done() -> pa.RecordBatch:
            gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            return batch_of([(now["key"], gaps, *now["counts"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest())], arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if now is None or now["key"] != row["conv_id"]:
                    if now is not None:
                        yield done()
                    now = {"key": row["conv_id"], "state": START, "cost": row["costs"][START], "audit": [], "sha": hashlib.sha256(), "any": False, "low": None, "high": None, "turns": 0, "counts": [0, 0, 0, 0], "last": None}
                state = now["state"]
                if row["repaired"][state] is not None:
                    now["sha"].update((("\n" if now["any"] else "") + row["repaired"][state]).encode("utf-8", "surrogatepass"))
                    now["any"] = True
                now["audit"].append(row["audits"][state])
                now["state"] = row["ends"][state]
                now["counts"] = [a + b for a, b in zip(now["counts"], (row["blank"], row["duplicate"], row["truncated"], row["illegal"]), strict=True)]
                if now["last"] is not None and now["last"] + row["first"] not in LEGAL:
                    now["counts"][3] += 1
                now["last"] = row["last"]
                if row["turns"]:
                    now["turns"] += row["turns"] - (now["high"] == row["low"])
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = row["high"]
        if now is not None:
            yield done()

    return run


def _long(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Results of the conversations of ``rows``, in segments."""
    conv = schema["conv_id"].dataType
    placed, table = running_total(rows.where("there"), F.col("conv_id"), [F.col("turn"), F.col("role"), F.col("text")], _weight(), "so_far")
    one = placed.withColumn("segment", F.floor((F.col("so_far") - _weight()) / F.lit(SEGMENT_BYTES)).cast("long")).withColumn("key", F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256))
    first = one.groupBy(F.col("conv_id").alias("_c"), F.col("key").alias("_k")).agg(F.min("so_far").alias("_first"))
    marked = one.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k"))).withColumn("double", F.col("so_far") != F.col("_first"))
    faults = with_faults(marked.select("conv_id", "segment", "so_far", "turn", "role", "text", "there", "double"))
    kept = cut(faults)
    drop(table)

    def segments(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "so_far")

    matrix = _schema(conv, [("segment", T.LongType()), ("matrix", T.ArrayType(T.LongType()))])
    bound = _schema(conv, [("segment", T.LongType()), ("end", T.ArrayType(T.LongType())), ("final", T.BooleanType())])
    matrices = segments(kept.withColumn("text", F.lit(""))).mapInArrow(_matrices(matrix), matrix)
    bounds = matrices.groupBy("conv_id").applyInPandas(_bounds, bound).select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), "end", "final", F.lit(START).alias("start"))
    with_bounds = kept.join(bounds, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s"))).drop("_c", "_s")
    fields = [("segment", T.LongType()), ("costs", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType())), ("audits", T.ArrayType(T.StringType())), ("repaired", T.ArrayType(T.StringType())), ("first", T.StringType()), ("last", T.StringType()), ("low", T.LongType()), ("high", T.LongType())]
    traced = _schema(conv, fields + [(name, T.LongType()) for name in ("turns", "blank", "duplicate", "truncated", "illegal")])
    pieces = segments(with_bounds).mapInArrow(_traced(traced), traced)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_joined(schema), schema)


def _weight() -> Column:
    return (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long")


def repair(rows: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of (conv_id, turn, role, text, there)."""
    schema = _schema(rows.schema["conv_id"].dataType, RESULT)
    sizes = rows.where("there").groupBy("conv_id").agg(F.sum(_weight()).alias("bytes"))
    long_ids = cut(sizes.where(F.col("bytes") > long_bytes).select(F.col("conv_id").alias("_long")))
    many = long_ids.count()
    small = F.broadcast(long_ids) if many <= FEW_LONG else long_ids
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = rows.join(small, same, "left_anti") if many else rows
    out = with_faults(short).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_whole(schema), schema)
    return out.unionByName(_long(rows.join(small, same, "left_semi"), schema)) if many else out


def digest(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
