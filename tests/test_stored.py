"""State over restarts, Arrow files by ranges, and named files after failures."""

import datetime as dt
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialoom.sources import arrow_files, sinks
from dialoom.streaming import infer

FRAMES = "stream string, frame_idx long, time timestamp, texts array<struct<role: string, text: string>>, ref string"
BASE = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def frames(lo, hi):
    """Frames [lo, hi) of three streams, one a second; a change of text now and then, nothing said on every fifth."""
    out = []
    for stream in "abc":
        for i in range(lo, hi):
            texts = None if i % 5 == 4 else [("system", f"{infer.KNOWLEDGE} k")] if i == 0 else [("user", f"t{(i + ord(stream)) // 3}")]
            out.append((stream, i, BASE + dt.timedelta(seconds=i), texts, f"r{i}" if i % 4 == 0 else None))
    return out


def heard(frame, history, kept, memory):
    """A model that tells all that its state holds."""
    memory = (memory or 0) + 1
    return f"{memory} {len(history)} {history[-1][1] if history else ''} {sorted(kept.items())} {frame['seconds']}", memory


def rows(df):
    return sorted((r.stream, r.frame_idx, r.gen, r.ref, r.last) for r in df.collect())


def run_stream(spark, source, out, checkpoint, **how):
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(source)
    infer.write_predictions(infer.infer(stream, heard, **how), out, checkpoint).awaitTermination()


@pytest.mark.parametrize("how", [{}, {"max_seconds": 17.0}, {"use_reference": True}])
def test_stream_in_batches_with_restart_equals_table(spark, tmp_path, how):
    infer.stateful(spark)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    cuts = [0, 9, 14, 30]
    parts = [spark.createDataFrame(frames(lo, hi), FRAMES) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    parts[0].coalesce(1).write.parquet(source)
    run_stream(spark, source, out, checkpoint, **how)
    for part in parts[1:]:  # a new query each time, from the checkpoint
        part.coalesce(1).write.mode("append").parquet(source)
        run_stream(spark, source, out, checkpoint, **how)
    whole = infer.infer(spark.createDataFrame(frames(0, 30), FRAMES), heard, **how)
    want = rows(whole)
    assert rows(infer.read_predictions(spark, out)) == want
    assert len(want) == (3 * 18 if "max_seconds" in how else 90)
    infer.save_by_stream(whole, str(tmp_path / "json"), {"fps": 2})
    saved = json.loads((tmp_path / "json/a.json").read_text())
    assert saved["metadata"] == {"fps": 2} and [p["frame_idx"] for p in saved["predictions"]] == list(range(len(want) // 3))


def test_repeated_frames_give_no_second_row(spark, tmp_path):
    infer.stateful(spark)
    twice = spark.createDataFrame(frames(0, 6) + frames(2, 6), FRAMES)
    assert len(rows(infer.infer(twice, heard))) == 18


def arrow_file(path, sizes, kind="stream", dictionary=False):
    text = lambda lo, n: pa.array([f"x{i % 4}" for i in range(lo, lo + n)])
    schema = pa.schema([("frame", pa.dictionary(pa.int32(), pa.string()) if dictionary else pa.string()), ("n", pa.int64())])
    with (pa.ipc.new_stream if kind == "stream" else pa.ipc.new_file)(str(path), schema) as out:
        lo = 0
        for n in sizes:
            out.write_batch(pa.record_batch([text(lo, n).cast(schema[0].type) if not dictionary else text(lo, n).dictionary_encode(), pa.array(range(lo, lo + n))], schema=schema))
            lo += n


@pytest.mark.parametrize("kind", ["stream", "file"])
def test_arrow_reads_the_batches_asked_for(spark, tmp_path, kind):
    arrow_file(tmp_path / "v.arrow", [10, 0, 10, 10, 5], kind)
    path = str(tmp_path / "v.arrow")
    df = arrow_files.arrow_frames(spark, path, 12, 21)
    assert [(r.video_uid, r.frame_idx, r.n, r.frame) for r in df.orderBy("frame_idx").collect()] == [("v", i, i, f"x{i % 4}") for i in range(12, 21)]
    reader = arrow_files.ArrowFramesReader(path, 12, 21, 1)
    assert [[b.first for b in run.batches] for run in reader.partitions()] == [[10], [20]]
    assert [[b.first for b in run.batches] for run in arrow_files.ArrowFramesReader(path, 0, None, 20).partitions()] == [[0, 10], [20, 30]]
    pushed = arrow_files.arrow_frames(spark, path).where("frame_idx >= 29 and frame_idx < 31 and n > 0")
    assert sorted(r.n for r in pushed.collect()) == [29, 30]
    other = arrow_files.ArrowFramesReader(path, 0, None, 1)
    assert list(other.pushFilters([arrow_files.GreaterThan(("frame_idx",), 29), arrow_files.LessThan(("n",), 3)])) == [arrow_files.LessThan(("n",), 3)]
    assert [[b.first for b in run.batches] for run in other.partitions()] == [[30]]
    assert arrow_files.arrow_frames(spark, path).where("frame_idx = 7").count() == 1
    for start, end in ((0, 36), (-1, 3)):
        with pytest.raises(Exception, match="out of range"):
            arrow_files.arrow_frames(spark, path, start, end).collect()


@pytest.mark.parametrize("kind", ["stream", "file"])
def test_arrow_dictionaries_and_empty_files(spark, tmp_path, kind):
    arrow_file(tmp_path / "d.arrow", [6, 6], kind="stream", dictionary=True)
    found = [b.to_pylist() for run in arrow_files.ArrowFramesReader(str(tmp_path / "d.arrow"), 8, 10, 5).partitions() for b in arrow_files.ArrowFramesReader(str(tmp_path / "d.arrow"), 8, 10, 5).read(run)]
    assert [[(r["frame_idx"], r["frame"]) for r in rows] for rows in found] == [[(8, "x0"), (9, "x1")]]
    arrow_file(tmp_path / "e.arrow", [], kind)
    assert arrow_files.arrow_frames(spark, str(tmp_path / "e.arrow")).count() == 0


def files_in(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.startswith("_"))


def test_named_files_are_all_there_or_none(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(40).select((F.col("id") % 5).alias("key"), "id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    broken = df.withColumn("text", F.when(F.col("id") == 33, F.raise_error(F.lit("injected"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="injected"):
        sinks.json_per_key(broken, path, "key", ["id"])
    assert [f for _, _, names in os.walk(path) for f in names] == []
    sinks.json_per_key(df, path, "key", ["id"])
    assert files_in(path) == [f"{k}.json" for k in range(5)]
    assert [r["id"] for r in json.loads((tmp_path / "out/3.json").read_text())] == list(range(3, 40, 5))
    with pytest.raises(Exception, match="injected"):
        sinks.json_per_key(broken, path, "key", ["id"])
    assert files_in(path) == [f"{k}.json" for k in range(5)]  # those of before
    sinks.json_per_key(df.where("key < 2"), path, "key", ["id"])
    assert files_in(path) == ["0.json", "1.json"]
    assert json.loads((tmp_path / "out/_manifest.json").read_text()) == {"0.json": 8, "1.json": 8}


def test_groups_of_rows_in_files(spark, tmp_path):
    df = spark.range(25).select(F.when(F.col("id") < 20, "a").otherwise("b/c").alias("key"), "id")
    sinks.grouped_files(df, str(tmp_path / "g"), "key", ["id"], 8, prefix="p")
    assert files_in(tmp_path / "g") == ["a/p000000.arrow", "a/p000001.arrow", "a/p000002.arrow", "b/c/p000000.arrow"]
    with pa.ipc.open_stream(str(tmp_path / "g/a/p000001.arrow")) as s:
        assert s.read_all()["id"].to_pylist() == list(range(8, 16))


def test_one_file_from_two_tasks_is_an_error(spark, tmp_path):
    df = spark.range(10).repartition(3).withColumn("_file", F.lit("x.jsonl"))
    spark.dataSource.register(sinks.NamedFiles)
    with pytest.raises(Exception, match="several tasks"):
        df.write.format("named_files").mode("overwrite").option("path", str(tmp_path / "t")).option("kind", "jsonl").save()
    assert files_in(tmp_path / "t") == []


def small_files(folder, n):
    for i in range(n):
        (folder / f"{i % 7}").mkdir(parents=True, exist_ok=True)
        arrow_file(folder / f"{i % 7}/v{i:03d}.arrow", [2, 0, i % 4], "file" if i % 2 else "stream", dictionary=False)


def test_small_files_share_partitions(spark, tmp_path):
    small_files(tmp_path, 60)
    path = str(tmp_path)
    assert len(arrow_files.ArrowFramesReader(path, 0, None, arrow_files.PARTITION_ROWS).partitions()) == 1
    assert arrow_files.first_arrow_file(path) == arrow_files.arrow_files(path)[0][0]
    whole = arrow_files.arrow_frames(spark, path)
    assert whole.rdd.getNumPartitions() == 1
    want = [(f"v{i:03d}", k, k) for i in range(60) for k in range(2 + i % 4)]
    assert sorted((r.video_uid, r.frame_idx, r.n) for r in whole.collect()) == want
    pushed = whole.where("frame_idx >= 1 and frame_idx < 4")
    assert sorted((r.video_uid, r.frame_idx, r.n) for r in pushed.collect()) == [w for w in want if 1 <= w[1] < 4]
    assert arrow_files.arrow_frames(spark, path, 0, 2).count() == 120
    with pytest.raises(Exception, match="out of range"):
        arrow_files.arrow_frames(spark, path, 0, 3).collect()
