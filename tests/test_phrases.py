"""Text rules case by case."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dialoom.functions import text as tx
from dialoom.operators import packing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_one_digit_is_rounded_as_the_exact_value(spark):
    rng = random.Random(1)
    values = [0.0, -0.04, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 1.25, 2.5, 0.95, 9.95, 9.96, 1e9 + 0.25, 1e9 + 0.35, -0.25, -0.35, 123456.05, 99.99, 0.1 + 0.2]
    values += [rng.randrange(100000) / 20 for _ in range(1500)] + [rng.uniform(-1e5, 1e5) for _ in range(1500)] + [math.ldexp(rng.randrange(1 << 20), -rng.randrange(1, 12)) for _ in range(1500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", tx.one_digit(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [f"{r.v:.1f}" for r in got]


@pytest.mark.parametrize(
    "passes, want",
    [
        ([], ""),
        (None, ""),
        (["#C C opens it."], "C opens it."),
        (["#C C opens it.", "#C C closes it"], "C opens it. and closes it."),
        (["#C C opens it", "#C C closes it."], "C opens it and closes it."),
        (["#unsure", "#C C sits"], "and sits."),
        (["#C C sits #Unsure", "#O X"], ""),
        (["#C C a #C C b", "#C C c #C C d #C C e"], "C a and c."),
        (["#C C one", "#O two", "#C C three"], "C one."),
    ],
)
def test_narration(spark, passes, want):
    column = F.lit(None).cast("array<string>") if passes is None else F.array(*[F.lit(p) for p in passes]).cast("array<string>")
    assert one(spark, tx.narration(column)) == want


@pytest.mark.parametrize(
    "first, second, want",
    [("Take it.", "then go", "Take it. Then go"), ("First,", "Take", "First, take"), ("Do:", "It", "Do: it"), ("", "go", "Go"), ("Stop", "", "Stop"), ("", "", ""), ("a ", "b", "a  B"), ("x", "ALL", "x ALL")],
)
def test_connected(spark, first, second, want):
    assert one(spark, tx.connected(F.lit(first), F.lit(second))) == want


@pytest.mark.parametrize(
    "verb, this, that, done, undone",
    [
        ("attach", "top", "motor", "attach top to motor", "detach fromp from mofromr"),
        ("detach", "top", "motor", "detach top from motor", "attach top to motor"),
        ("screw", "a", "b", "screw a from b", "screw a to b"),
        ("detach", "form", "fromage", "detach form from fromage", "attach form to toage"),
    ],
)
def test_mistakes(spark, verb, this, that, done, undone):
    a, b = tx.mistake_text(F.lit(verb), F.lit(this), F.lit(that))
    assert (one(spark, a), one(spark, b)) == (done, undone)


@pytest.mark.parametrize(
    "text, want",
    [(" the_students wait\n", "the users wait"), ("unintelligible", "unintelligible"), ("a *unintelligible* b", "a  b"), ("instudented", "inusered")],
)
def test_normalised(spark, text, want):
    assert one(spark, tx.normalised(F.lit(text))) == want


@pytest.mark.parametrize("n, want", [(0, "0"), (999, "999"), (-999, "-999"), (1000, "1.0K"), (-1500, "-1.5K"), (999_999, "1000.0K"), (1_000_000, "1.0M"), (3_210_000_000, "3.2G"), (2_500_000_000_000, "2.5T"), (7 * 10**15, "7.0P"), (9 * 10**18, "9000.0P")])
def test_sizes(spark, n, want):
    assert one(spark, tx.size_text(F.lit(n).cast("long"))) == want


@pytest.mark.parametrize("name, want", [("ego-val-L1", "ego-val"), ("x_test_val", "x_test_val"), ("val_test", "val"), ("a_test.b", "a_test"), ("plain", "plain")])
def test_short_names(spark, name, want):
    assert one(spark, tx.short_name(F.lit(name))) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ('a --- {"x": 1}', 1.0),
        ('{"x": 2} no mark', 2.0),
        ('{"x": 2} --- {"x": 3} --- {"x": 4}', 3.0),
        ('--- {\n"x": 1}', None),
        ("--- {x}", None),
        ("nothing", None),
    ],
)
def test_judge_scores(spark, text, want):
    scores = one(spark, tx.judge_scores(F.lit(text), ("x",)))
    assert (scores.x if scores else None) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("<|begin_of_text|><|start_header_id|>assistant<|end_header_id|>\n\nsaid<|eot_id|>more", ("said", "assistant")),
        (" . <|eot_id|>", ("", None)),
        ("<image><image>.", ("", None)),
        ("assistant<|end_header_id|>\n\n.", (".", "assistant")),
        ("a;b", ("ab", None)),
        ("", ("", None)),
    ],
)
def test_cleaned(spark, text, want):
    assert tuple(one(spark, tx.cleaned_turn(F.lit(text), separator=";"))) == want


def test_progress_note(spark):
    assert one(spark, tx.progress_note(F.lit(12.25), F.lit("SUMMARY: a\nSUMMARY: b : c"))) == "The time elapsed since the start of the task is 12.2 seconds. b"
    with pytest.raises(Exception, match="no summary"):
        one(spark, tx.progress_note(F.lit(1.0), F.lit("none")))


def turns(*rows):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"), F.lit(e).cast("long").alias("end")) for r, c, e in rows])


def test_until_summary(spark):
    asked = turns(("system", "s", None), ("frames", "", 7), ("user", "u", None), ("system", "Please summarize now", None), ("frames", "", 9))
    got = one(spark, packing.until_summary(asked, F.lit(20).cast("long")))
    assert ([t.content for t in got.turns], got.end) == (["s", "", "u", "Please summarize now"], 7)
    plain = one(spark, packing.until_summary(turns(("frames", "", 7)), F.lit(20).cast("long")))
    assert (len(plain.turns), plain.end) == (1, 20)


@pytest.mark.parametrize(
    "contents, want",
    [
        (["s", "u", "Task knowledge: x"], ["s Task knowledge: k", "u"]),
        (["Task knowledge: a", "u", "Task knowledge: x"], ["Task knowledge: a", "u"]),
        (["s", "u", "plain"], ["s Task knowledge: k", "u", "plain"]),
        (["s", "u"], ["s Task knowledge: k", "u"]),
    ],
)
def test_knowledge_in_first(spark, contents, want):
    rows = [("user" if c == "u" else "system", c, None) for c in contents]
    got = one(spark, packing.knowledge_in_first(turns(*rows), F.lit("k")))
    assert [t.content for t in got] == want
