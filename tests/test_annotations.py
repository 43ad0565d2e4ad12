"""The parsers of annotated recordings on planted files, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.plans import annotations
from dialoom.sources import readers

TICK = 10_000_000


def clips_of(steps, most, counts, whole, tail):
    out, lines, start = [], 0, None
    for i, (a, b, _, subs) in enumerate(steps):
        lines += 1 + (max(len(subs) - 1, 0) if counts else 0)
        start = a if start is None else start
        if lines > most or i == len(steps) - 1:
            text = "".join(s + "\n" + ("".join(x + "\n" for x in ss) if c >= start and d <= b else "") for c, d, s, ss in steps) + tail if whole else None
            out.append((start, b, text))
            lines, start = 0, None
    return out


def description(steps, tail=""):
    return "".join(s + "\n" + "".join(x + "\n" for x in subs) for _, _, s, subs in steps) + tail


def plain_timed(rows):
    """rows: (role, start, end, text) of one recording."""
    events = sorted(((a if not role else (a + b) / 2, k, b, text if not role else f'{role}: "{text}"') for k, (role, a, b, text) in enumerate(rows)), key=lambda e: e[:2])
    begin = next((b for _, _, b, t in events if t.lower() == "start"), 0.0)
    steps, annotated = [], 0.0
    for a, _, b, text in events:
        if a < begin:
            continue
        if ":" not in text:
            steps.append([a, b, text, []])
            annotated += b - a
        elif steps:
            steps[-1][3].append(f"- [{a:.1f}s] {text}")
            steps[-1][1] = max(steps[-1][1], a)
    steps = [(a, b, f"[{a:.1f}s-{b:.1f}s] {t}", s) for a, b, t, s in steps]
    return [(begin / 2, begin, f"- [{begin / 2:.1f}s] start", []), *steps], annotated


def test_timed_lines_from_files(spark, tmp_path):
    rng, planted = random.Random(4), {}
    for v in range(6):
        rows = []
        for role in ("", "assistant", "user"):
            at = 0.0
            for k in range(rng.randint(0 if v else 1, 14)):
                at += rng.randint(0, 60) / 8
                text = "Start" if not role and k == 1 and v % 2 else rng.choice(["cut: it", "boil", "stir well"]) if not role else f"say {k}"
                rows.append((role, at, at + rng.randint(0, 40) / 8, text))
        if not rows:
            continue
        planted[f"T{v}"] = rows
        for role in ("", "assistant", "user"):
            folder = tmp_path / (role or "steps") / f"T{v}"
            folder.mkdir(parents=True)
            (folder / "lines.txt").write_text("".join(f"{int(a * TICK)}\t{int(b * TICK)}\t{t}\n" for r, a, b, t in rows if r == role))
    lines = None
    for role in ("", "assistant", "user"):
        path = str(tmp_path / (role or "steps"))
        video = F.regexp_extract(F.input_file_name(), r"([^/]+)/lines\.txt$", 1)
        one = readers.tick_lines(spark, f"{path}/*/lines.txt").select(video.alias("video_uid"), "start", "end", "text").withColumn("role", F.lit(role)).withColumn("seq", F.monotonically_increasing_id() + {"": 0, "assistant": 1 << 50, "user": 1 << 51}[role])
        lines = one if lines is None else lines.unionByName(one)
    durations = spark.createDataFrame([(v, 100.0) for v in planted], "video_uid string, duration double")
    got = {r.video_uid: r for r in annotations.PARSERS["wtag"](lines, durations).collect()}
    assert set(got) == set(planted)
    for v, rows in planted.items():
        steps, annotated = plain_timed(rows)
        r = got[v]
        assert [(s.start, s.end, s.step, s.substeps) for s in r.steps] == [tuple(s) for s in steps]
        assert r.description == description(steps)
        assert [(c.start, c.end, c.description) for c in r.clips] == clips_of(steps, 6, False, True, "")
        assert r.ann_ratio == pytest.approx(annotated / 100)
        assert (r.domain, r.num_steps) == ("cooking", len(steps))


def clean(text):
    return text.strip().replace("_", " ").replace("student", "user").replace("*unintelligible*", "")


def plain_attributed(events):
    events = sorted(((a if "Conversation Purpose" not in at else (a + b) / 2, k, b, at) for k, (a, b, at) in enumerate(events)), key=lambda e: e[:2])
    steps, subs, seen, summary, annotated = [], [], set(), "", 0.0
    for a, _, b, at in events:
        if "Long form description" in at:
            summary = clean(at["Long form description"])
        if "Action sentence" in at:
            if steps:
                steps[-1][3].extend(subs)
            steps.append((a, b, f"[{a:.1f}s-{b:.1f}s] {clean(at['Action sentence'])}", []))
            annotated += b - a
            subs, seen = [], set()
        elif "Conversation Purpose" in at:
            words = clean(at["Transcription"])
            if words:
                subs.append(f' - [{a:.1f}s] {"user" if at["Conversation Purpose"].split("-")[0] == "student" else "assistant"}: "{words}"')
        elif "Action Correctness" in at:
            more = at.get("Adjective", "")
            action = f"{clean(at['Verb'])} {'' if more in ('none', 'wrong', '') else more + ' '}{clean(at['Noun'])}"
            error = "" if at["Action Correctness"] == "Correct Action" else f" (ERROR: {clean(at.get('Incorrect Action Explanation', 'none'))})"
            if clean(at["Verb"]) not in ("hold", "touch", "rotate", "inspect") and action not in seen:
                subs.append(f" - [{a:.1f}s-{b:.1f}s] {action}{error}")
                seen.add(action)
    return steps, f"Summary: {summary}\n", annotated


def test_attributed_events(spark):
    rng, planted = random.Random(6), {}
    for v in range(8):
        events = []
        for k in range(rng.randint(1, 60)):
            a = rng.randint(0, 900) / 8
            kind = rng.choice(["step", "said", "action", "action", "other"])
            at = {
                "step": {"Action sentence": f" the_student does {k}"},
                "said": {"Conversation Purpose": rng.choice(["student-ask", "instructor-start"]), "Transcription": rng.choice(["hello student", "*unintelligible*", f"say_{k} "])},
                "action": {"Action Correctness": rng.choice(["Correct Action", "Wrong Action"]), "Verb": rng.choice(["grab", "hold", "turn"]), "Noun": rng.choice(["knob", "lid"]), **({"Adjective": rng.choice(["red", "none", "wrong"])} if k % 2 else {}), **({"Incorrect Action Explanation": "too_fast"} if k % 3 else {})},
                "other": {"Long form description": f"about {k} "} if k % 2 else {"x": "y"},
            }[kind]
            events.append((a, a + rng.randint(0, 30) / 8, at))
        if any("Action sentence" in at for *_, at in events):
            planted[f"v{v}"] = events
    rows = [(v, k, *e) for v, events in planted.items() for k, e in enumerate(events)]
    df = spark.createDataFrame(rows, "video_uid string, seq long, start double, end double, attributes map<string, string>")
    durations = spark.createDataFrame([(v, 50.0) for v in planted], "video_uid string, duration double")
    got = {r.video_uid: r for r in annotations.PARSERS["holoassist"](df.repartition(3), durations).collect()}
    assert set(got) == set(planted)
    for v, events in planted.items():
        steps, tail, annotated = plain_attributed(events)
        r = got[v]
        assert [(s.start, s.end, s.step, s.substeps) for s in r.steps] == steps
        assert r.description == description(steps, tail)
        assert [(c.start, c.end, c.description) for c in r.clips] == clips_of(steps, 6, True, True, tail)
        assert r.ann_ratio == pytest.approx(annotated / 50)
        assert r.num_substeps == sum(len(s) for *_, s in steps)


def test_activities(spark):
    coarse = spark.createDataFrame([("v", 0, 0.0, 10.0, "Cook"), ("v", 1, 10.0, 20.0, "Eat"), ("w", 0, 5.0, 5.0, "Wait")], "video_uid string, seq long, start double, end double, text string")
    fine = spark.createDataFrame(
        [("v", 0, 2.0, 4.0, "Cut", "Onion", None), ("v", 1, 8.0, 12.0, "Stir", None, 0), ("v", 2, 1.0, 2.0, "Drop", "Pan", 1), ("v", 3, 1.0, 2.0, None, "Pan", None)],
        "video_uid string, seq long, start double, end double, verb string, noun string, confusion int",
    )
    got = {r.video_uid: r for r in annotations.PARSERS["epfl"](coarse, fine).collect()}
    assert got["v"].description == "[0.0s-10.0s] Cook\n - [2.0s] cut onion\n - [8.0s] stir\n[10.0s-20.0s] Eat\n - [8.0s] stir\n"
    assert [(c.start, c.end, c.description) for c in got["v"].clips] == [(0.0, 20.0, got["v"].description.strip())]
    assert (got["v"].ann_ratio, got["w"].ann_ratio, got["w"].num_substeps) == (1.0, 0.0, 0)
