"""Vector codes, mixing and conversation repair against brute force, and their corner cases."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from dialoom.llm import op11_vector_codes, op12_mixing, op13_repair
from dialoom.session import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BIG = (1 << 53) + 1
VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, source string"
TURNS = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def sql_rows(sql, name, path):
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{path}'")
    return Counter(con.sql(sql).fetchall())


# vector codes


def plain_codes(rows):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    width = -(-max(len(v) for _, v, _ in kept) // 16) * 16
    d = width // 16
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:64]]
    books = [[v[p * d : p * d + d] for v in seeds] for p in range(16)]

    def assign():
        return [[min(range(len(seeds)), key=lambda e, p=p, v=v: (sum((a - b) ** 2 for a, b in zip(v[p * d : p * d + d], books[p][e], strict=True)), e)) for p in range(16)] for _, v, _ in kept]

    for _ in range(2):
        codes = assign()
        for p in range(16):
            for e in range(len(seeds)):
                own = [v[p * d : p * d + d] for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum((a - b) ** 2 for p in range(16) for a, b in zip(v[p * d : p * d + d], books[p][c[p]], strict=True)) for (_, v, _), c in zip(kept, codes, strict=True)]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{x:02x}" for x in c), e, by_label[label], sha) for (i, _, label), c, e in zip(kept, codes, errors, strict=True))


def vectors(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(5)]
    rows = [(i * 3, [float(x + rng.gauss(0, 0.1)) for x in rng.choice(centres)], rng.choice([None, 1, 2, 3])) for i in range(n)]
    return [(i, [round(x * 64) / 64 for x in v], label) for i, v, label in rows]  # many ties


def test_op11_sql(spark):
    assert rows_of(op11_vector_codes.digest(table(spark, SF, "embeddings"))) == sql_rows(op11_vector_codes.ORACLE, "embeddings", f"{SF}/embeddings.parquet")


def test_op11_ties_nulls_repeats_and_uneven_vectors(spark):
    rows = vectors(150, 20, 3)
    rows += [(1, None, 1), (4, [None] * 20, 1), (7, [float("nan")] + [0.0] * 19, 1), (10, [float("inf")] + [0.0] * 19, None), (BIG, [0.5] * 20, None), (None, [0.25] * 20, 9), (None, [0.125] * 20, 9)]
    rows += [rows[0]] * 70 + [(0, [0.0] * 20, 2), (13, [], 2), (16, [1.0, -1.0], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    wide = df.repartition(5).withColumns({c: F.lit("clash") for c in ("ids", "labels", "codes", "change", "error", "code", "id", "vector")})
    assert rows_of(op11_vector_codes.digest(wide)) == plain_codes(rows)


def test_op11_small_tables(spark):
    for rows in ([], [(1, None, 1)], [(5, [0.1] * 16, None)], [(5, [], 1), (6, [], 1)]):
        assert rows_of(op11_vector_codes.digest(spark.createDataFrame(rows, VECTORS))) == plain_codes(rows)


def test_op11_large_components(spark):
    rows = [(i, [(-1.0) ** i * 3e38 / (i + 1)] * 16, 1) for i in range(3)]
    got = op11_vector_codes.digest(spark.createDataFrame(rows, VECTORS)).collect()
    assert [r.error for r in got] == [0, 0, 0]


def test_op11_heaps_pop_what_drift_violates():
    """Bounds spare most parts when entries hardly move, and the result is that of a full scan."""
    import numpy as np

    rng = np.random.default_rng(4)
    parts, book = rng.integers(-300, 300, (4000, 4)), rng.integers(-300, 300, (64, 4))
    near, key = op11_vector_codes.scan(parts, book)
    heap = op11_vector_codes.Heaps.built(near, np.arange(len(parts)), key, 64)
    new = book.copy()
    new[7] += 3
    drift = op11_vector_codes.drifted(np.zeros((1, 64)), book[None], new[None])[0]
    popped = heap.pop(drift)
    again = op11_vector_codes.scan(parts, new)[0]
    assert set(np.flatnonzero(again != near)) <= set(popped.tolist())
    assert 0 < len(popped) < 800 and len(popped) + len(heap.rows) == len(parts)


# mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, among = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else weight[s] * left / among for s in names}
        above = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not above:
            return out
        capped |= above


def documents(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["a", "bb", "é", "中文"]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 60)), "hot") for i in range(300)]
    rows += [(1000 + i, say(rng.randint(1, 90)), f"s{i % 7}") for i in range(120)]
    rows += [(2000, None, "s1"), (2001, " \t\n\x0b", "s2"), (2002, say(3000), "zz"), (None, say(5), None), (2003, say(9), None), (2004, None, "none"), (BIG, "\x85 x\xa0y z", "")]
    return rows + [rows[3]] * 40


def test_op12_targets_and_copies(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS)
    got = op12_mixing.digest(df.repartition(6)).collect()
    size_of = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size_of(t)) for i, t, _ in rows)
    source = {i: s for i, _, s in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        rate = want[s] / max(sizes[s], 1)
        if r.size:
            assert math.floor(rate + 1e-9) <= r.taken // r.size <= math.ceil(rate - 1e-9)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert rows_of(op12_mixing.digest(df)) == Counter(map(tuple, got))


def test_op12_sql(spark):
    assert rows_of(op12_mixing.digest(table(spark, SF, "documents"))) == sql_rows(op12_mixing.ORACLE, "documents", f"{SF}/documents.parquet")


def test_op12_mixed_repeats_rows(spark):
    df = spark.createDataFrame(documents(2), DOCS).withColumns({c: F.lit("clash") for c in ("size", "copies", "place", "mix", "doc", "num", "den", "_row")})
    out = op12_mixing.mixed(df)
    assert out.columns == df.columns
    want = Counter()
    for r in op12_mixing.allocate(df).collect():
        want[tuple(r.doc)] += r.mix.copies
    assert rows_of(out) == +want


def test_op12_empty_and_blank(spark):
    assert op12_mixing.digest(spark.createDataFrame([], DOCS)).collect() == []
    got = op12_mixing.digest(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# repair

STEP = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def plain_repair(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        convs[c]
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(x for x in text if x not in ".!?")
        if fault == 4:
            role = "user"
        convs[c] += [(t is not None, t or 0, role.encode(), text.encode())] * (2 if fault == 3 else 1)
    out = Counter()
    for c, turns in convs.items():
        turns.sort()
        roles, texts = [r.decode() for _, _, r, _ in turns], [x.decode() for *_, x in turns]
        known = {t for there, t, *_ in turns if there}
        faults, seen = [], set()
        for r, x in zip(roles, texts, strict=True):
            words = x.encode().split()
            faults.append("b" if not words else "d" if (r, x) in seen else "t" if words[-1][-1:] not in (b".", b"!", b"?") else "")
            seen.add((r, x))
        best = {(len(turns), 0): (0, ""), (len(turns), 3): (0, ""), (len(turns), 2): (5, "I"), (len(turns), 1): (10, "II")}
        for i in range(len(turns) - 1, -1, -1):
            extra, bad = 5 * (faults[i] == "t"), faults[i] in ("b", "d")

            def options(q, i=i, extra=extra, bad=bad):
                c, a = best[i + 1, q]
                yield c + 2, "D" + a
                if not bad:
                    c, a = best[i + 1, STEP[q]]
                    yield c + 1 + extra, "R" + a
                    if (roles[i][:1], q) in KEEP:
                        c, a = best[i + 1, KEEP[roles[i][:1], q]]
                        yield c + extra, "K" + a

            direct = {q: min(options(q)) for q in range(4)}
            for q in range(4):
                found, at, pre = [direct[q]], q, ""
                for k in (1, 2, 3):
                    at, pre = STEP[at], pre + "I"
                    found.append((direct[at][0] + 5 * k, pre + direct[at][1]))
                best[i, q] = min(found)
        cost, audit = best[0, 0]
        lines, q, i = [], 0, 0
        for letter in audit:
            if letter == "I":
                q = STEP[q]
                lines.append(("user" if q == 2 else "assistant") + ":")
                continue
            if letter == "K":
                q = KEEP[roles[i][:1], q]
                lines.append(f"{roles[i]}:{texts[i]}")
            elif letter == "R":
                q = STEP[q]
                lines.append(("user" if q == 2 else "assistant") + ":" + texts[i])
            i += 1
        illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c, gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, sha] += 1
    return out


def conversations(n, seed, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"])
            text = rng.choice(["Hi.", "No", "Yes!", "Eh? \n", " ", "", None, "中文。", "a.b", f"{c}:{t}.", f"{t}"])
            rows.append((c, rng.choice([t, t, t, t + 2, None]), role, text))
    return rows


def test_op13_brute_force(spark):
    rows = conversations(400, 1) + [(None, None, None, None), (None, 3, "user", "x."), (BIG, 1, "assistant", "Yes."), (-1, 7, "user", "  ."), (-2, 0, "system", "s.")]
    rows += [(5000 + i, t, r, "Fine.") for i in range(40) for t, r in enumerate(("system", "user", "assistant"))] + [rows[0]] * 3
    df = spark.createDataFrame(rows, TURNS)
    wide = df.repartition(5).withColumns({c: F.lit("clash") for c in ("blank", "there", "fault", "cost", "audit", "col", "double", "segment")})
    got = rows_of(op13_repair.digest(wide))
    assert got == plain_repair(rows)
    assert any(r[-2] == "" for r in got)


def test_op13_long_conversations_in_segments(spark, monkeypatch):
    """The same results when conversations are cut into segments of a few turns."""
    rows = conversations(25, 2, 40) + [(None, t, "user" if t % 2 else "system", f"{t % 5}.") for t in range(60)]
    rows += [(99, 4, "assistant", "same")] * 50 + [(99, t, "user", "same.") for t in range(30)]
    monkeypatch.setattr(op13_repair, "SEGMENT_BYTES", 5 * op13_repair.ROW_BYTES)
    out = op13_repair.repair(op13_repair.damaged(spark.createDataFrame(rows, TURNS)), long_bytes=6 * op13_repair.ROW_BYTES)
    assert rows_of(out) == plain_repair(rows)
    monkeypatch.setattr(op13_repair, "FEW_LONG", 0)
    out = op13_repair.repair(op13_repair.damaged(spark.createDataFrame(rows, TURNS)), long_bytes=20 * op13_repair.ROW_BYTES)
    assert rows_of(out) == plain_repair(rows)


def test_op13_table_and_empty(spark):
    given = table(spark, SF, "conversations")
    assert rows_of(op13_repair.digest(given)) == plain_repair([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])
    assert op13_repair.digest(spark.createDataFrame([], TURNS)).collect() == []


@pytest.mark.parametrize("roles, audit, cost", [("", "", 0), ("ua", "KK", 0), ("sua", "KKK", 0), ("s", "D", 2), ("u", "D", 2), ("aua", "DKK", 2), ("uuu", "DKR", 3), ("suu", "KKR", 1), ("uaua", "KKKK", 0), ("au", "RR", 2)])
def test_op13_small_cases(roles, audit, cost):
    piece = op13_repair.Piece((1,))
    for i, r in enumerate(roles):
        piece.roles.append(r)
        piece.texts.append(f"{i}.")
        piece.blank.append(False)
        piece.short.append(False)
    piece.mark_doubles()
    (_, got, letters), = op13_repair.solved([piece])
    assert (letters, got) == (audit, cost)
