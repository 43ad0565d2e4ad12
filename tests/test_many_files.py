"""Many named files: what the driver holds does not follow their number."""

import json
import os
import pickle
import tracemalloc

import pyarrow as pa
import pytest

from dialoom.sources import arrow_files, named_files


def batch(names, first=0):
    return pa.record_batch({"n": pa.array(range(first, first + len(names)), pa.int64()), named_files.NAME: pa.array(names, pa.string())})


def writer_of(path):
    return named_files.NamedFilesWriter({"path": str(path), "kind": "arrow"}, True)


def content(path):
    with pa.ipc.open_stream(str(path)) as s:
        return s.read_all()["n"].to_pylist()


def found_in(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_commit_holds_no_list_of_files(tmp_path):
    writer, messages = writer_of(tmp_path / "t"), []
    for task in range(4):
        names = sorted(f"{i % 500}/p{task}-{i:06d}.arrow" for i in range(3000))
        messages.append(writer.write(iter([batch(names[:1000]), batch(names[1000:])])))
    assert all(len(pickle.dumps(m)) < 1000 for m in messages)
    tracemalloc.start()
    writer.commit(messages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000  # 80 bytes a file
    assert len(found_in(tmp_path / "t")) == 12_001 and not [f for f in found_in(tmp_path / "t") if "_staging" in f]


def test_lists_out_of_order_are_merged_in_rounds(tmp_path, monkeypatch):
    monkeypatch.setattr(named_files, "HELD", 2)
    monkeypatch.setattr(named_files, "OPEN_LISTS", 2)
    path = tmp_path / "t"
    names = ['q"t.arrow', "a\tb.arrow", "z/a\nb.arrow", "z\\u.arrow", "ü/ä.arrow", "\U0001f600.arrow", "a.arrow", "a!.arrow", "a/b.arrow", "a/b/c.arrow", "a-/b.arrow"]
    writer = writer_of(path)
    lists = [writer.write(iter([batch(names[:6])])), None, writer.write(iter([batch(names[6:], 6)])), writer.write(iter([]))]
    assert len(lists[0].lists + lists[2].lists) > 2 and lists[3].lists == []
    writer.commit(lists)
    assert found_in(path) == sorted([*names, "_manifest.json"])
    assert [content(path / n) for n in names] == [[i] for i in range(len(names))]
    assert json.loads((path / "_manifest.json").read_text()) == dict.fromkeys(names, 1)

    again = writer_of(path)  # a name that two tasks wrote, in lists of different rounds, and one that a task wrote twice
    bad = [again.write(iter([batch(["z.arrow", "b.arrow", "a.arrow"])])), again.write(iter([batch(["d.arrow", "e.arrow", "d.arrow"])])), again.write(iter([batch(["b.arrow"])]))]
    with pytest.raises(ValueError, match="several tasks wrote the files .'b.arrow', 'd.arrow'."):
        again.commit(bad)
    assert found_in(path) == sorted([*names, "_manifest.json"])  # those of before

    last = writer_of(path)
    last.commit([last.write(iter([batch(["only/one.arrow"])]))])
    assert found_in(path) == ["_manifest.json", "only/one.arrow"]
    empty = writer_of(path)
    empty.commit([None, empty.write(iter([]))])
    assert found_in(path) == ["_manifest.json"] and json.loads((path / "_manifest.json").read_text()) == {}


def test_rows_without_a_name_are_an_error(tmp_path):
    with pytest.raises(ValueError, match="name no file"):
        writer_of(tmp_path / "t").write(iter([batch(["a.arrow", None])]))


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with pa.ipc.new_stream(str(path), pa.schema([("n", pa.int64())])) as out:
        out.write_batch(pa.record_batch({"n": pa.array(rows, pa.int64())}))


def test_folders_of_small_files_are_planned_by_name(tmp_path, monkeypatch):
    for i in range(300):
        put(tmp_path / f"{i % 40}/v{i:03d}.arrow", [i])
    reader = arrow_files.ArrowFramesReader(str(tmp_path), 0, None, arrow_files.PARTITION_ROWS)
    parts = reader.partitions()
    assert [(p.files, len(p.rest)) for p in parts] == [(300, 40)]
    assert sorted(r["n"] for p in parts for b in reader.read(p) for r in b.to_pylist()) == list(range(300))
    monkeypatch.setattr(arrow_files, "FILES", 20)
    parts = reader.partitions()
    assert sum(p.files for p in parts) == 300 and max(p.files for p in parts) <= 20 and sum(len(p.rest) for p in parts) == 40
    assert sorted(r["n"] for p in parts for b in reader.read(p) for r in b.to_pylist()) == list(range(300))
    (tmp_path / "7/v007.arrow").unlink()
    with pytest.raises(ValueError, match="changed before they were read"):
        [list(reader.read(p)) for p in parts]


def test_large_files_and_full_folders_beside_small_ones(tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_files, "FILES", 3)
    put(tmp_path / "c.arrow", [0, 1])
    put(tmp_path / "a/x.arrow", [2])
    put(tmp_path / "a/large.arrow", list(range(3, 200)))
    put(tmp_path / "a.b/deep/er/y.arrow", [200])
    for i in range(8):
        put(tmp_path / f"full/{i}.arrow", [201 + i])
    (tmp_path / "full/_manifest.json").write_text("{}")
    (tmp_path / "none").mkdir()
    (tmp_path / "link.arrow").symlink_to(tmp_path / "nowhere")
    path = f"file://{tmp_path}/"
    want = sorted(str(tmp_path / f) for f in found_in(tmp_path) if f.endswith(".arrow") and f != "link.arrow")
    assert [f for f, _ in arrow_files.arrow_files(path)] == want and arrow_files.first_arrow_file(path) == want[0]
    reader = arrow_files.ArrowFramesReader(path, 0, None, 16)  # a file of over 1,024 bytes is large
    parts = reader.partitions()
    runs = [p for p in parts if isinstance(p, arrow_files.Run)]
    assert [r.path for r in runs] == [str(tmp_path / "a/large.arrow")]
    assert all(p.files <= 3 for p in parts if p not in runs) and sum(p.files for p in parts if p not in runs) == len(want) - 1
    rows = sorted((r["n"], r["video_uid"], r["frame_idx"]) for p in parts for b in reader.read(p) for r in b.to_pylist())
    assert [r[0] for r in rows] == list(range(209)) and rows[5] == (5, "large", 2) and rows[-1] == (208, "7", 0)
