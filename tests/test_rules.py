"""Worked cases of the rules, with expected values computed by hand or by brute force."""

import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import text as tx
from dialoom.functions import timing as tm
from dialoom.operators import filters, joins, matching, metrics, packing, ranking, sets, windows
from dialoom.plans import quality
from dialoom.sources import readers, sinks
from dialoom.streaming import events, expand


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = int(rng.integers(1, 5)), int(rng.integers(5, 7))
        cost = np.where(rng.random((n, m)) < 0.2, np.inf, rng.random((n, m)))
        best = min((sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n)), default=np.inf)
        got = matching.assign(cost)
        if np.isfinite(best):
            assert sum(cost[i, c] for i, c in enumerate(got)) == pytest.approx(best)


def test_matching_case():
    gen, ref = [""] * 19, [""] * 19
    for i in (6, 8, 15, 16, 18):
        gen[i] = "g"
    for j in (0, 7, 8, 14, 17):
        ref[j] = "r"
    rows = matching.match_sample(gen, ref, -4, 2)
    kinds = [r[0] for r in rows]
    assert (kinds.count("matched"), kinds.count("missed"), kinds.count("redundant")) == (4, 1, 1)
    assert sum(r[3] for r in rows if r[3] is not None) == pytest.approx(1.1125)


def test_auto_eval_case(spark):
    turns = [(1, "user", 0.0, "How do I start?"), (1, "assistant", 0.0, "Get the mug."), (1, "user", 9.0, "What next?"), (1, "assistant", 12.0, "Pour water."), (1, "user", 21.0, "Ok."), (1, "assistant", 24.0, "Stir."), (1, "user", 26.0, "Done?")]
    t = spark.createDataFrame([(k, r, x + i / 1e6, c) for i, (k, r, x, c) in enumerate(turns)], "k int, role string, time double, content string")
    starts = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 25.0)], "k int, start double")
    row = quality.auto_eval(t, "k", "time", F.col("role"), F.col("content").endswith("?"), starts, 2.0).first()
    assert row.avg_time_diff_r == pytest.approx(2 / 3 + 1 / 3, abs=0.4)
    assert row.no_resp_user_turns == 1


def test_frame_positions_cases(spark):
    for times, length, t0, expected in [
        ([0, 0, 3.2, 3.3, 7.9], 14, 0.0, [(0, 1), (1, 2), (2, 6), (6, 7), (7, 13)]),
        ([1, 0.2, 4, 30, 31], 12, 0.0, [(0, 2), (2, 3), (3, 8), (8, 11)]),
        ([2, 5], 20, 1.5, [(3, 4), (4, 10)]),
    ]:
        df = spark.createDataFrame([(1, i, float(t), length, t0) for i, t in enumerate(times)], "k int, pos int, t double, n int, t0 double")
        rows = windows.frame_positions(df, ["k"], ["pos"], "t", 2.0, "n", "t0").orderBy("pos").collect()
        assert [(r.frame_start, r.frame_end) for r in rows] == expected


def test_overlap_case(spark):
    outer = spark.createDataFrame([("c1", 1, 0, 10), ("c2", 1, 10, 20), ("c3", 1, 30, 40)], "o string, k int, s int, e int")
    inner = spark.createDataFrame([("a1", 1, 2, 4), ("a2", 1, 8, 12), ("a3", 1, 10, 10), ("a4", 1, 20, 20), ("a5", 1, -1, 50), ("a6", 1, 20, 30)], "i string, k int, a int, b int")
    rows = joins.interval_overlap(outer, inner, "k", ("s", "e"), ("a", "b")).collect()
    got = {o: {r.i for r in rows if r.o == o} for o in ("c1", "c2", "c3")}
    assert got == {"c1": {"a1", "a2", "a3", "a5"}, "c2": {"a2", "a3", "a4", "a5"}, "c3": {"a5"}}


def test_overlap_against_all_pairs(spark):
    """Lengths from nothing to the whole range, reversed and null spans, equal rows, rows without a partner."""
    rng = random.Random(9)
    span = lambda i: (i % 3, float(a := rng.randint(0, 400)), float(a + rng.choice([0, 0, 1, 2, 3, 9, 40, 300, -2])))
    outer, inner = [(f"o{i}", *span(i)) for i in range(120)], [(f"i{i}", *span(i)) for i in range(150)]
    outer += [outer[0], ("none", 7, 1.0, 2.0), ("null", None, 1.0, 2.0), ("open", 1, None, 2.0)]
    left = spark.createDataFrame(outer, "o string, k int, s double, e double")
    right = spark.createDataFrame(inner, "i string, k int, a double, b double")
    meets = lambda s, e, a, b: s is not None and ((s <= a < e) or (s < b <= e) or (a < s and b > e))
    want = []
    for o, k, s, e in outer:
        found = [i for i, k2, a, b in inner if k == k2 and meets(s, e, a, b) and a <= b and s <= e]
        want += [(o, i) for i in found or [None]]
    got = [(r.o, r.i) for r in joins.interval_overlap(left, right, "k", ("s", "e"), ("a", "b")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    held = [(r.o, r.i) for r in joins.interval_contains(left, right.drop("b"), "k", "a", "s", "e").collect()]
    assert sorted(held) == sorted((o, i) for o, k, s, e in outer for i, k2, a, _ in inner if k == k2 and s is not None and s <= a <= e)


def test_hot_key_meets_few_pairs(spark):
    """100,000 intervals of one key, some a thousand times as long as others: pairs that meet are at most four times those kept."""
    spans = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 1_000_000).cast("double").alias("start")).withColumn("end", F.col("start") + F.when(F.col("start") % 1000 == 0, 4000.0).otherwise(4.0 + F.col("start") % 17))
    points = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 104_729 % 1_000_000).cast("double").alias("at"))
    met = joins._bucketed(points, spans, "k", F.col("at"), F.col("start"), F.col("end")).count()
    kept = joins.interval_contains(spans, points, "k", "at").count()
    assert kept > 20_000
    assert met <= 4 * kept


def test_one_key_is_spread_over_tasks(spark):
    """Shares of a key with all rows: equal to a window's, and no task has twice the mean."""
    from dialoom.operators import running

    df = spark.range(40_000).select(F.lit("k").alias("key"), (F.col("id") * 7919 % 40_000).alias("v"))
    placed, kept = running.running_total(df, F.col("key"), [F.col("v").desc()], F.lit(1), "at")
    assert placed.where(F.col("at") != 40_000 - F.col("v")).count() == 0
    sizes = [r["count"] for r in kept.groupBy(running._PART).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * 40_000 / len(sizes)
    assert ranking.share_of(df, ["key"], [F.col("v")], 0.25).agg(F.count("*"), F.max("v")).first()[:] == (10_000, 9_999)


def test_parse_dialog_case(spark):
    text = "[1.0s] User: Hi\n[1.0s] User: Hi\n[2.5s] Assistant: Do it [initiative|instruction, info]\n[x s] User: bad\n[3.0s] Narrator: no\n[4.0s] User: (nods)"
    got = one(spark, tx.parse_dialog(F.lit(text)))
    assert [tuple(t) for t in got] == [("user", 1.0, "Hi", ""), ("assistant", 2.5, "Do it", "initiative|instruction,info_sharing")]


def test_greedy_groups_case(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([1, 3, 3, 1, 7, 2, 2, 2, 1])], "k int, pos int, c int")
    assert [r.clip_id for r in windows.greedy_groups(df, ["k"], ["pos"], "c", 6).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 2]
    ones = spark.createDataFrame([(1, i, 1) for i in range(16)], "k int, pos int, c int")
    counts = windows.greedy_groups(ones, ["k"], ["pos"], "c", 6).groupBy("clip_id").count().orderBy("clip_id").collect()
    assert [r["count"] for r in counts] == [7, 7, 2]


def test_bleu_and_cider_case(spark):
    pairs = [("pour the water into the mug", "pour water into the mug"), ("stir the coffee slowly", "stir the coffee slowly"), ("place it on the plate", "invert the mug onto a plate")]
    df = spark.createDataFrame([(i, h.split(), r.split()) for i, (h, r) in enumerate(pairs)], "pair_id int, hyp array<string>, ref array<string>")
    row = metrics.bleu(df.select("pair_id", "hyp", F.array("ref").alias("refs"))).first()
    assert [row[f"bleu_{n}"] for n in range(1, 5)] == pytest.approx([0.733333, 0.605530, 0.546214, 0.482772], abs=1e-6)
    got = [r.cider for r in metrics.cider(df.select("pair_id", "hyp", F.array("ref").alias("refs"))).orderBy("pair_id").collect()]
    assert got == pytest.approx([6.357869, 10.0, 0.606145], abs=1e-5)
    several = df.select("pair_id", "hyp", F.when(F.col("pair_id") == 1, F.array().cast("array<array<string>>")).otherwise(F.array("ref", "ref")).alias("refs"))
    scored = metrics.cider(several)
    assert len(scored.collect()) == 3 and scored.where("pair_id = 1").first().cider == 0
    assert metrics.cider(several)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") <= 5  # texts by pair (shown twice, run once), grams and frequencies by gram, products by pair


def test_stream_expand_case(spark):
    rows = [(0, "system", "S", None, None), (1, "frames", None, 10, 12), (2, "user", "U1", None, None), (3, "frames", None, 12, 15), (4, "assistant", "A1", None, None), (5, "frames", None, 15, 16), (6, "user", "U2", None, None), (7, "user", "U3", None, None), (8, "frames", None, 16, 18), (9, "assistant", "A2", None, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, pos int, role string, content string, start int, end int")
    out = expand.expand(df, "k").orderBy("frame_idx_in_stream").collect()
    assert len(out) == 8
    assert {r.frame_idx_in_stream: [t.text for t in r.text_inputs] for r in out if r.text_inputs} == {0: ["S"], 2: ["U1"], 6: ["U2", "U3"]}
    assert {r.frame_idx_in_stream: (r.ref, r.timestamp_in_stream) for r in out if r.ref} == {4: ("A1", 2.5), 7: ("A2", 4.0)}


def test_stream_metrics_case(spark):
    rows = [("matched", 0, 0, 0.9)] * 4 + [("matched", 0, 0, 0.2)] + [("missed", None, 1, None)] * 2 + [("redundant", 1, None, None)] * 3
    m = metrics.stream_metrics(spark.createDataFrame(rows, "kind string, gen_idx int, ref_idx int, score double"), 2.0).first()
    assert [m.jaccard, m.missing, m.redundant, m.precision, m.recall, m.f1] == pytest.approx([0.4, 0.285714, 0.375, 0.5, 0.571429, 0.533333], abs=1e-6)


def plain_times(turns):
    """Passes until nothing moves."""
    times = [t for _, t in turns]
    while True:
        moved = False
        for i in range(1, len(times)):
            if times[i] - times[i - 1] < 0.5 and (turns[i][0], turns[i - 1][0]) != ("assistant", "user"):
                group, k = [i], i + 1
                while k < len(times) - 1 and times[k] - times[i] < 1.0:
                    group.append(k)
                    k += 1
                for g in group:
                    times[g] = times[i - 1] + 1.0
                moved = True
        if not moved:
            return times


def test_adjust_times_cases(spark):
    rng = random.Random(2)
    cases = [[("user", 1.0), ("assistant", 1.0), ("assistant", 1.2), ("user", 1.5), ("assistant", 4.0)], [("assistant", 1.0), ("assistant", 1.1)]]
    for _ in range(400):
        at = sorted(rng.choice([0.25, 0.5, 1.0, 0.1]) * rng.randint(0, 20) for _ in range(rng.randint(1, 12)))
        if rng.random() < 0.3:
            rng.shuffle(at)
        cases.append([(rng.choice(["user", "assistant", "user", "system"]), t) for t in at])
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, turns array<struct<role: string, time: double>>")
    got = {r.i: r.times for r in df.select("i", packing.adjusted_times(F.col("turns")).alias("times")).collect()}
    assert got[0] == [1.0, 1.0, 2.0, 3.0, 4.0]
    assert got[1] == [1.0, 2.0]
    for i, case in enumerate(cases):
        assert got[i] == plain_times(case), case


def test_split_turns_invariants():
    rng = np.random.default_rng(1)
    for _ in range(200):
        turns, frame = [], 0
        for pos in range(rng.integers(1, 15)):
            role = str(rng.choice(["frames", "user", "assistant"]))
            n = int(rng.integers(1, 4)) if role == "frames" else 0
            turns.append({"pos": pos, "role": role, "length": n * 10 if role == "frames" else int(rng.integers(1, 30)), "start": frame, "end": frame + n})
            frame += n
        clips = packing.cut_points(pd.DataFrame(turns), 60, (1, 4), 0)
        last = -1
        for clip in clips:
            part = [dict(t) for t in turns[clip.first : clip.last + 1]]
            if clip.head is not None:
                part[0] |= {"start": clip.head, "length": 10 * (part[0]["end"] - clip.head)}
            assert part[-1]["role"] == "assistant"
            assert sum(t["length"] for t in part) == clip.total <= 60
            assert clip.first > last
            last = clip.last


def test_text_functions(spark):
    assert one(spark, tx.step_times(F.lit("[1.0s-2.5s] a [3.0s] b [junk]"))) == [1.0, 2.5, 3.0]
    assert one(spark, tx.answer_int(F.lit("Answer: it is 12 or 3"))) == 12
    assert one(spark, tx.summary_line(F.lit("a\nSUMMARY: done well: more"))) == "done well"
    assert one(spark, tx.judge_scores(F.lit('x --- {"a": 2, "b": 3.5} tail'), ("a", "b"))).b == 3.5
    assert one(spark, tx.judge_scores(F.lit("nothing"), ("a",))) is None
    assert one(spark, tx.goal_line(F.lit("** Make tea **\nmore"))) == "Make tea"
    assert one(spark, tx.caption(F.lit("a Dog RUNS"))) == "A dog runs."
    assert one(spark, tx.user_types(F.lit("no_talk@2,talk_some"))) == ["no_talk", "no_talk", "talk_some"]
    setup = one(spark, tx.eval_setups(F.lit("ego4d|stream|4k|0.3|drop_middle")))[0]
    assert (setup.dataset, setup.max_len, setup.threshold) == ("ego4d", 4096, 0.3)
    assert one(spark, tx.dataset_path(F.lit("ego4d/val"), "/r")) == "/r/ego4d/prepared/val.jsonl"
    assert one(spark, tx.narration(F.array(F.lit("#C C picks a cup"), F.lit("#unsure")))) == "C picks a cup."
    assert one(spark, tx.by_keyword(F.lit("Hot Coffee"), (("coffee", "c"), ("tortilla", "t")), "d")) == "c"
    assert one(spark, tx.ptb_tokens(F.lit("Don't stop, now!"))) == ["do", "n't", "stop", "now"]
    assert one(spark, tx.cleaned(F.lit("assistant<|end_header_id|>\n\n.<|eot_id|>junk"))) == "."
    assert one(spark, tx.turn_label(F.lit("???"))) == "initiative|other"
    done, swapped = tx.mistake_text(F.lit("attach"), F.lit("wheel"), F.lit("body"))
    assert one(spark, done) == "attach wheel to body"
    assert one(spark, swapped) == "detach wheel from body"


def test_chat_template_lengths(spark):
    turns = [("frames", None, 0, 3), ("frames", None, 3, 4), ("frames", None, 4, 9)]
    df = spark.createDataFrame([(turns,)], "t array<struct<role:string,content:string,start:int,end:int>>")
    text = df.select(tx.chat_text(F.col("t"), "i", 10, ";")).first()[0]
    assert [len(x) for x in (text[:32], text[32:42], text[42:])] == [32, 10, 54]
    assert one(spark, tm.frames_tokens(F.lit(3), 10, True)) == 32


def test_time_functions(spark):
    assert one(spark, tm.clock_seconds(F.lit("01:02:03.5"))) == 3723.5
    assert one(spark, tm.clock_frame_index(F.lit("00:00:12.34"), 100.0)) == 1203
    assert one(spark, tm.frame_clock(F.lit(7), 2.0)) == "00:00:04"
    assert one(spark, tm.frame_file(F.lit(12))) == "0000000012.jpg"
    assert one(spark, tm.overlap_ratio(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0))) == pytest.approx(1 / 3)
    assert tm.match_window((-2.5, 2.5), 2) == (-5, 5)


def test_context_policies():
    drop = expand.Context(300, "drop_all")
    assert [drop.add(100, False) for _ in range(3)] == [100, 0, 100]
    middle = expand.Context(1300, "drop_middle")
    lengths = [middle.add(100, i == 0) for i in range(30)]
    assert max(lengths) < 1300 - expand.RESERVE and middle.drops > 0


def test_band_equals_pairs(spark):
    a = spark.createDataFrame([(k, i) for k in range(2) for i in range(0, 40, 3)], "k int, i int")
    b = a.withColumnRenamed("i", "j")
    got = {(r.k, r.i, r.j) for r in joins.band(a, b, "k", "i", "j", -4, 2).collect()}
    assert got == {(k, i, j) for k in range(2) for i in range(0, 40, 3) for j in range(0, 40, 3) if i - 4 <= j <= i + 2}


def test_required_join_fails_on_a_miss(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no k 2"):
        joins.required(left, right, "k").collect()


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.row_no == r.v + 1 for r in ranking.global_row_number(df, ["v"]).collect())


def test_filters_and_sets(spark):
    df = spark.createDataFrame([("grp-a", "essential"), ("b", None), ("c", "essential")], "id string, is_relevant string")
    assert {r.id for r in filters.essential(df).collect()} == {"grp-a", "c"}
    assert {r.id for r in filters.drop_listed(df, "id", spark.createDataFrame([("a",)], "x string"), "grp-").collect()} == {"b", "c"}
    assert one(spark, sets.without_train(F.array(F.lit("train"), F.lit("val")))) == ["val"]


def test_sources_and_sinks(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("s", T.StringType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1, "s": "p"}\nbroken\n')
    rows = readers.jsonl(spark, str(tmp_path / "x.jsonl"), schema).collect()
    assert [r.a for r in rows] == [1, None]
    assert rows[1]._corrupt_record == "broken"
    (tmp_path / "x.json").write_text(json.dumps({"root": [{"a": 1, "s": "q"}, {"a": 2, "s": "r"}]}))
    assert readers.json_array(spark, str(tmp_path / "x.json"), schema, "root").count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d/12.json").write_text('{"a": 5, "s": "z"}')
    assert readers.json_directory(spark, str(tmp_path / "d"), schema).first().file_id == 12
    (tmp_path / "t.txt").write_text("10000000\t30000000\thello\n")
    tick = readers.tick_lines(spark, str(tmp_path / "t.txt")).first()
    assert (tick.start, tick.end, tick.text) == (1.0, 3.0, "hello")
    (tmp_path / "p.txt").write_text("10000000\n35000000\n")
    assert readers.timing_pair(spark, str(tmp_path / "p.txt")).first().duration == 2.5
    df = spark.createDataFrame([(i, "train" if i % 2 else "val") for i in range(10)], "i int, split string")
    sinks.json_by_split(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("split = 'val'").count() == 5
    sinks.grouped_files(df, str(tmp_path / "grouped"), df.columns[0], [df.columns[0]], 4)
    assert len(list((tmp_path / "grouped").rglob("*.arrow"))) == 10
    done, todo = readers.resume(df, df.where("i < 3").select("i"), "i")
    assert (done.count(), todo.count()) == (3, 7)
    frames = spark.createDataFrame([("v", i) for i in range(6)], "video_uid string, frame_idx int")
    good = spark.createDataFrame([("v", 1, 4)], "video_uid string, start_frame_idx int, end_frame_idx int")
    assert readers.checked_frames(frames, good).count() == 3
    with pytest.raises(Exception, match="out of range"):
        readers.checked_frames(frames, spark.createDataFrame([("v", 1, 9)], good.schema)).collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(u, i, 100 + 10 * (i % 3), i % 4 == 0) for u in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, "user_id long, frame_idx long, tokens long, has_user boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.user_id, r.frame_idx, r.context) for r in expand.context_lengths(df, "user_id", 700, "drop_all").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = expand.context_stream(stream, "user_id", 700, "drop_all").writeStream.format("memory").queryName("ctx").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.frame_idx, r.context) for r in spark.table("ctx").collect()} == batch


def test_windowed_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=17 * i), "a" if i % 3 else "b", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    batch = {(r.window_start, r.event_type, r.n) for r in events.windowed(df, "ts", ["event_type"], "6 hours").collect()}
    stream = events.event_stream(spark, str(tmp_path / "ev"), df.schema)
    q = events.windowed(stream, "ts", ["event_type"], "6 hours", late="1 hour").writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window_start, r.event_type, r.n) for r in spark.table("win").collect()}
    closed = max(r[0] for r in rows) - dt.timedelta(hours=1)
    assert got <= batch
    assert {r for r in batch if r[0] + dt.timedelta(hours=6) <= closed} <= got


def test_model_hooks(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    assert {r.generated for r in quality.generate(df, "p", lambda xs: [x.upper() for x in xs]).collect()} == {"A", "B"}
    assert {tuple(r.embedding) for r in quality.encode(df, "p", lambda xs: [[float(len(x))] for x in xs]).collect()} == {(1.0,)}
    assert "StreamEvaluator" in quality.Evaluator.registry


def test_prepared_samples(spark):
    rows = []
    for conv in range(4):
        frame = 0
        for pos in range(30):
            role = ("frames", "user", "assistant")[pos % 3]
            n = 3 if role == "frames" else 0
            rows.append((conv, pos, role, 10 * n or 15, frame if n else None, frame + n if n else None, f"p{pos}" if role == "assistant" else None))
            frame += n
    df = spark.createDataFrame(rows, "conv_id long, pos int, role string, length long, start int, end int, progress string")
    got = packing.prepare_samples(df, 200, 20, 30, (1, 2)).collect()
    assert got
    assert all(r.seq_len <= 200 for r in got)
    for conv in range(4):
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.clip_idx)
        assert [r.clip_idx for r in mine] == list(range(len(mine)))
        assert mine[0].progress is None
        assert all(r.progress == f"p{before.last_pos}" for before, r in zip(mine, mine[1:], strict=False))
        assert all(r.conversation[0].role == "system" and r.conversation[-1].content == f"p{r.last_pos}" for r in mine)


def test_restarting_pack():
    out = packing.pack_with_restarts([40] * 10, 200, 20, 50, 30)
    assert [a for a, _, _ in out][1:] == [b for _, b, _ in out][:-1]
    assert out[0] == (0, 3, 170)
    assert out[-1][1] == 10
    assert all(t <= 200 for _, _, t in out)


def test_learn_ranges_and_labels(spark):
    assert one(spark, tm.learn_ranges(F.lit(3), 3, 3, 5)) == [[9, 14], [23, 28]]
    assert one(spark, tm.learn_ranges(F.lit(1), 3, 3, 5)) == []
    assert one(spark, tm.shifted_labels(F.array(*map(F.lit, (5, 6, 7, 8, 9))), F.lit(2), F.lit(4))) == [-100, 7, 8, -100, -100]
    assert [one(spark, c) for c in tm.cover_size(F.lit(640), F.lit(480), 384)] == [512, 384]
    assert [one(spark, c) for c in tm.pad_size(F.lit(640), F.lit(480), 384)] == [384, 288, 0, 48]


def test_clip_history(spark):
    clips = spark.createDataFrame([(1, i, f"d{i}") for i in range(5)], "v long, clip_idx int, description string")
    got = expand.generate_by_clip(clips, "v", lambda d, h: [f"{d}|{len(h)}", "x"], 3).orderBy("turn").collect()
    assert [r.text for r in got if r.text != "x"] == ["d0|0", "d1|2", "d2|3", "d3|3", "d4|3"]


def plain_counts(words):
    return [Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) for n in range(1, 5)]


def many_pairs():
    """Pairs of common and rare words with up to three references; no words, no references and nulls among them."""
    words = lambda i, n: [f"w{(i * 7 + k * k) % (5 + i % 11)}" for k in range(n)]
    out = [(i, words(i, i % 9), [words(i + j, (i + 3 * j) % 8) for j in range(i % 4)]) for i in range(90)]
    return out + [(90, None, [["w1", "w2"]]), (91, ["w1"], None), (92, ["w1", "w1"], [None, ["w1"]])]


def plain_cider(pairs):
    counts = {i: (plain_counts(h or []), [plain_counts(r or []) for r in refs or []]) for i, h, refs in pairs}
    df = [Counter(g for _, refs in counts.values() for g in {g for r in refs for g in r[n]}) for n in range(4)]
    out = {}
    for i, h, refs in pairs:
        own, total = counts[i][0], 0.0
        for words, ref in zip(refs or [], counts[i][1], strict=True):
            delta = max(len(h or []) - 1, 0) - max(len(words or []) - 1, 0)
            for n in range(4):
                idf = lambda g: math.log(len(pairs)) - math.log(max(df[n][g], 1))  # noqa: E731, B023
                a, b = ({g: c * idf(g) for g, c in x[n].items()} for x in (own, ref))
                norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
                total += sum(min(a.get(g, 0), v) * v for g, v in b.items()) / norm * math.exp(-(delta**2) / 72) if norm else 0
        out[i] = total / len(refs) / 4 * 10 if refs else 0.0
    return out


PAIRS_SCHEMA = "pair_id int, hyp array<string>, refs array<array<string>>"


def test_cider_in_blocks_and_buckets_equals_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(metrics, "BUCKET_TOKENS", 150)
    got = metrics.cider(spark.createDataFrame(many_pairs(), PAIRS_SCHEMA), together=F.floor(F.col("pair_id") / 8))
    assert {r.pair_id: r.cider for r in got.collect()} == pytest.approx(plain_cider(many_pairs()), abs=1e-9)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()  # no rows of single grams
    assert metrics.cider(spark.createDataFrame([], PAIRS_SCHEMA)).collect() == []


def test_bleu_counts_where_the_pair_is(spark):
    df = spark.createDataFrame(many_pairs(), PAIRS_SCHEMA)
    got = metrics.bleu(df)
    hits, guess = [0] * 4, [0] * 4
    for _, h, refs in many_pairs():
        for n, said in enumerate(plain_counts(h or [])):
            guess[n] += sum(said.values())
            hits[n] += sum(min(c, max((plain_counts(r or [])[n][g] for r in refs or []), default=0)) for g, c in said.items())
    row = got.first()
    ratio = row.test_len / row.ref_len
    brevity = math.exp(1 - 1 / ratio) if ratio < 1 else 1.0
    want = [math.prod(hits[k] / guess[k] for k in range(n)) ** (1 / n) * brevity for n in range(1, 5)]
    assert [row[f"bleu_{n}"] for n in range(1, 5)] == pytest.approx(want, abs=1e-9)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()  # only sums travel
    assert metrics.bleu(df.where("pair_id < 0")).first().test_len is None
