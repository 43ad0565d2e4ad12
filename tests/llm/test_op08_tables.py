"""What op8 writes between its steps, and its components against the rounds."""

import random
import struct
from pathlib import Path

import pytest

from dialoom.llm import components, op08_jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
SPLIT = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}


@pytest.fixture
def split(spark):
    """Many small partitions, as of a table that is large for its partitions' aimed size."""
    before = {k: spark.conf.get(k) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_op8_writes_few_files_and_settles_chains_at_once(split, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    chain = [" ".join(words[3 * i : 3 * i + 40]) for i in range(40)]  # each is linked with its neighbours only
    apart = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(200)) for _ in range(200)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(chain + apart)]
    files, tables = [], []

    def recorded(kind):
        real = components.cut

        def cut(df, merged=True):
            out = real(df, merged)
            files.append(len(list(Path(out.cut_path.removeprefix("file:")).glob("part-*"))))
            tables.append(kind)
            return out

        return cut

    step, rounds = recorded("step"), recorded("components")
    monkeypatch.setattr(op08_jaccard, "cut", step)
    monkeypatch.setattr(components, "cut", rounds)
    got = {r.doc_id: r.component_id for r in op08_jaccard.digest(split.createDataFrame(rows, DOCS).repartition(12)).collect()}
    assert got == {i: 0 if i < 40 else i for i in range(240)}
    assert max(files) <= 8 and files  # 8 partitions
    assert tables.count("components") <= 2


@pytest.mark.parametrize("most", [3, 1 << 18])
def test_joined_components_are_those_of_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(components, "EDGES", most)
    rng = random.Random(7)
    name = lambda i: None if i is None else struct.pack(">q", (i * 2654435761) % (1 << 40) - (1 << 39))  # noqa: E731  bytes over 127, too
    edges = [(i, i + 1) for i in range(100, 130)] + [(0, j) for j in range(1, 12)] + [(7, 7), (None, 3), (200, None), (9, 8), (9, 8)]
    edges += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(24)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary").repartition(5)
    rows = lambda out: sorted((bytes(r.id), bytes(r.label)) for r in out.collect())
    got = rows(components.joined_components(df))
    assert got == rows(components.connected_components(df))
    assert len({i for i, _ in got}) == len(got)
    assert components.joined_components(df.limit(0)).count() == 0
