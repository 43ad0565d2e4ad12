"""Queries that apply the operators to the driver's tables, each with the SQL that must give the same rows.

Roles of the tables: ``events`` is the event and frame stream (a user is a video or conversation, view a step or frames turn, click an
assistant turn, error a user turn), ``conversations`` the turns, ``orders`` and ``lineitem`` steps and substeps, ``embeddings`` sentence vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions import text as tx
from dialoom.functions import timing as tm
from dialoom.operators import aggregates as ag
from dialoom.operators import filters as fl
from dialoom.operators import joins as jn
from dialoom.operators import matching, metrics, packing
from dialoom.operators import ranking as rk
from dialoom.operators import sets as st
from dialoom.operators import windows as wn
from dialoom.plans import quality
from dialoom.session import table
from dialoom.streaming import events as se
from dialoom.streaming import expand as sx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _events(s: SparkSession, d: str) -> DataFrame:
    """Events with t in seconds."""
    return table(s, d, "events").withColumn("t", F.expr("unix_micros(cast(ts as timestamp)) / 1000000.0D"))


E = "e AS (SELECT *, epoch_us(ts) / 1000000.0 AS t FROM events)"


# --- quality and windows over events


@query(f"""
WITH {E}, q AS (
  SELECT user_id, event_type = 'error' AND lead(t) OVER w IS NOT NULL AND (lead(event_type) OVER w <> 'click' OR (lead(t) OVER w - t) / 3600 > 2) AS u
  FROM e WHERE event_type IN ('error', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY t)
), k AS (SELECT user_id, t / 3600 AS h FROM e WHERE event_type = 'click'), s AS (SELECT user_id, t / 3600 AS h FROM e WHERE event_type IN ('view', 'purchase', 'signup')
), p AS (SELECT user_id, avg(d) AS p FROM (SELECT k.user_id, k.h, min(abs(k.h - s.h)) AS d FROM k JOIN s USING (user_id) GROUP BY k.user_id, k.h) GROUP BY user_id
), r AS (SELECT user_id, avg(d) AS r FROM (SELECT s.user_id, s.h, min(abs(k.h - s.h)) AS d FROM k JOIN s USING (user_id) GROUP BY s.user_id, s.h) GROUP BY user_id
), n AS (SELECT user_id, count(*) FILTER (WHERE u) AS n FROM q GROUP BY user_id)
SELECT user_id, round(p, 4) AS avg_time_diff_p, round(r, 4) AS avg_time_diff_r, n AS no_resp_user_turns, round(10 - (p + r + n * 0.1), 4) AS final_score
FROM p JOIN r USING (user_id) JOIN n USING (user_id)""")
def event_auto_eval(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).withColumn("h", F.col("t") / 3600)
    role = F.when(F.col("event_type") == "error", "user").when(F.col("event_type") == "click", "assistant")
    starts = e.where(F.col("event_type").isin("view", "purchase", "signup")).select("user_id", F.col("h").alias("start"))
    out = quality.auto_eval(e, "user_id", "h", role, F.col("event_type") == "error", starts, 2.0)
    return out.select("user_id", *[F.round(c, 4).alias(c) for c in ("avg_time_diff_p", "avg_time_diff_r")], "no_resp_user_turns", F.round("final_score", 4).alias("final_score"))


@query(f"""
WITH {E} SELECT event_id, event_type = 'error' AND lead(t) OVER w IS NOT NULL AND (lead(event_type) OVER w <> 'click' OR lead(t) OVER w - t > 7200) AS unanswered
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)""")
def event_no_response(s: SparkSession, d: str) -> DataFrame:
    return wn.unanswered(_events(s, d), ["user_id"], ["t"], F.col("event_type") == "error", F.col("event_type") == "click", "t", 7200).select("event_id", "unanswered")


@query(f"WITH {E} SELECT event_id, round(t - lag(t) OVER (PARTITION BY user_id ORDER BY t), 3) AS gap FROM e")
def event_gap(s: SparkSession, d: str) -> DataFrame:
    return wn.gaps(_events(s, d), ["user_id"], ["t"], "t").select("event_id", F.round("gap", 3).alias("gap"))


@query(f"WITH {E}, x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e) SELECT event_id, user_id, event_type FROM x WHERE p IS DISTINCT FROM event_type")
def event_drop_repeats(s: SparkSession, d: str) -> DataFrame:
    return wn.drop_repeats(_events(s, d), ["user_id"], ["t"], "event_type").select("event_id", "user_id", "event_type")


@query(f"""
WITH {E}, x AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)
), y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t) AS run_no FROM x)
SELECT user_id, run_no::BIGINT AS run_no, event_type, string_agg(event_id::VARCHAR, '-' ORDER BY t) AS items, count(*) AS n FROM y GROUP BY user_id, run_no, event_type""")
def event_merge_adjacent_types(s: SparkSession, d: str) -> DataFrame:
    return wn.merge_runs(_events(s, d), ["user_id"], ["t"], ["event_type"], "event_id", "-").select("user_id", F.col("run_no").cast("long").alias("run_no"), "event_type", "items", "n")


@query(f"WITH {E} SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS rn FROM e) WHERE rn = 1")
def event_first_of_type(s: SparkSession, d: str) -> DataFrame:
    return wn.first_in_group(_events(s, d), ["user_id"], "event_type", ["t"]).select("user_id", "event_type", "event_id")


@query(f"""
WITH {E}, a AS (SELECT user_id, event_id, t - min(t) OVER (PARTITION BY user_id) AS s FROM e
), b AS (SELECT *, row_number() OVER w AS k, least(floor(s / 3600 * 2), 399) AS raw FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s)
), c AS (SELECT *, greatest(k, k + max(raw - k) OVER (PARTITION BY user_id ORDER BY s)) AS f FROM b
), g AS (SELECT * FROM c WHERE f < 400)
SELECT event_id, coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY s), 0)::BIGINT AS frame_start, f::BIGINT AS frame_end FROM g""")
def event_frame_index(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).withColumn("h", (F.col("t") - F.min("t").over(Window.partitionBy("user_id"))) / 3600).withColumn("n", F.lit(400))
    return wn.frame_positions(e, ["user_id"], ["h"], "h", 2.0, "n").select("event_id", F.col("frame_start").cast("long").alias("frame_start"), F.col("frame_end").cast("long").alias("frame_end"))


@query(f"""
WITH {E}, x AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 7200 THEN 0 ELSE 1 END AS c FROM e
), y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t) AS g FROM x)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 7200000000 AS session_end, count(*) AS n FROM y GROUP BY user_id, g""")
def event_gap_session(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return se.sessions(e, "ts", "user_id", "2 hours").select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query("""SELECT epoch_us(date_trunc('day', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def event_daily_windows(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return se.windowed(e, "ts", ["event_type"], "1 day").select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(f"""
WITH {E} SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t) AS last_view FROM e""")
def event_last_nonnull(s: SparkSession, d: str) -> DataFrame:
    return wn.last_value(_events(s, d), ["user_id"], ["t"], F.when(F.col("event_type") == "view", F.col("event_id")), "last_view").select("event_id", "user_id", "last_view")


@query(f"""
WITH {E}, c AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'), v AS (SELECT user_id, t, event_id AS view_id, value FROM e WHERE event_type = 'view')
SELECT c.event_id, v.view_id AS last_view_id, v.value AS last_value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.t""")
def event_asof_attach(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    left = e.where("event_type = 'click'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("view_id"), "value")
    return jn.asof_backward(left, right, "user_id", "t", ["view_id", "value"]).select("event_id", "last_view_id", "last_value")


@query(f"""
WITH {E}, x AS (SELECT *, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY t) AS step_no FROM e)
SELECT user_id, step_no::BIGINT AS step_no, max(CASE WHEN event_type = 'view' THEN t END) AS step_start, greatest(max(CASE WHEN event_type = 'view' THEN t + 600 END), coalesce(max(CASE WHEN event_type <> 'view' THEN t END), 0)) AS step_end,
  count(*) FILTER (WHERE event_type <> 'view') AS num_substeps
FROM x WHERE step_no > 0 GROUP BY user_id, step_no""")
def event_steps_substeps(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).withColumn("u", F.col("t") + 600)
    return jn.steps_with_substeps(e, "user_id", ["t"], F.col("event_type") == "view", "t", "u").withColumn("step_no", F.col("step_no").cast("long"))


@query(f"""
WITH {E}, x AS (SELECT *, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY t) AS step_no FROM e)
SELECT event_id, step_no::BIGINT AS step_no FROM x WHERE event_type <> 'view' AND step_no > 0""")
def event_attach_to_step(s: SparkSession, d: str) -> DataFrame:
    return jn.attach_to_last(_events(s, d), "user_id", ["t"], F.col("event_type") == "view").select("event_id", F.col("step_no").cast("long").alias("step_no"))


@query(f"""
WITH {E}, o AS (SELECT event_id AS oid, user_id, t AS a, t + 86400 AS b FROM e WHERE event_type = 'purchase'), i AS (SELECT user_id, t AS c, t + value * 100 AS f FROM e WHERE event_type = 'view')
SELECT oid, count(c) AS n FROM o LEFT JOIN i ON o.user_id = i.user_id AND ((c >= a AND c < b) OR (f > a AND f <= b) OR (c < a AND f > b)) GROUP BY oid""")
def event_interval_overlap(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    outer = e.where("event_type = 'purchase'").select(F.col("event_id").alias("oid"), "user_id", F.col("t").alias("a"), (F.col("t") + 86400).alias("b"))
    inner = e.where("event_type = 'view'").select("user_id", F.col("t").alias("c"), (F.col("t") + F.col("value") * 100).alias("f"))
    return jn.interval_overlap(outer, inner, "user_id", ("a", "b"), ("c", "f")).groupBy("oid").agg(F.count("c").alias("n"))


@query("""
SELECT o_orderkey, l_linenumber::BIGINT AS l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE epoch(l_shipdate) BETWEEN epoch(o_orderdate) AND epoch(o_orderdate) + 30 * 86400""")
def order_interval_contains(s: SparkSession, d: str) -> DataFrame:
    sec = lambda c: F.expr(f"unix_seconds(cast({c} as timestamp))")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), sec("o_orderdate").alias("start"), (sec("o_orderdate") + 30 * 86400).alias("end"))
    i = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("l_linenumber"), sec("l_shipdate").alias("at"))
    return jn.interval_contains(o, i, "k", "at").select(F.col("k").alias("o_orderkey"), "l_linenumber")


@query(f"""
WITH {E}, n AS (SELECT user_id, floor(t / 60)::BIGINT AS f, event_type, event_id FROM e), m AS (SELECT *, lead(f) OVER (PARTITION BY user_id ORDER BY f, event_type) AS nx FROM n)
SELECT user_id, floor(f / 1440)::BIGINT + 1 AS sample_idx, string_agg(event_type, ' ' ORDER BY f, event_type) AS texts, count(*) AS n FROM m WHERE nx IS NOT NULL GROUP BY ALL""")
def event_forward_bucket(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select("user_id", F.floor(F.col("t") / 60).alias("f"), "event_type")
    return jn.forward_bucket(e, "user_id", "f", 1440, "event_type").withColumn("sample_idx", F.col("sample_idx").cast("long"))


@query(f"""
WITH {E}, x AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e) SELECT event_id, coalesce(p - value > 10, false) OR value <= 0.5 AS talk FROM x""")
def event_talk_drop(s: SparkSession, d: str) -> DataFrame:
    return wn.talk_drop(_events(s, d), ["user_id"], ["t"], "value", 10.0).select("event_id", "talk")


@query(f"WITH {E} SELECT user_id, greatest(min(t) - 2, 0) AS video_start_time, max(t) - min(t) AS duration FROM e GROUP BY user_id")
def event_start_offset(s: SparkSession, d: str) -> DataFrame:
    return wn.start_offset(_events(s, d), ["user_id"], "t", "t")


@query(f"""
WITH {E}, x AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e WHERE event_type = 'click') SELECT user_id, round(avg(g), 3) AS mean_interval, count(g) AS n_gaps FROM x GROUP BY user_id""")
def event_mean_interval(s: SparkSession, d: str) -> DataFrame:
    return ag.mean_interval(_events(s, d), ["user_id"], ["t"], "t", F.col("event_type") == "click").withColumn("mean_interval", F.round("mean_interval", 3))


@query(f"""
WITH {E}, x AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) AS f FROM e
), y AS (SELECT *, max((event_type = 'view')::INT) OVER w AS nr, max((event_type = 'click')::INT) OVER w AS ng FROM x WINDOW w AS (PARTITION BY user_id ORDER BY f RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT user_id, count(*) FILTER (WHERE event_type = 'click' AND nr = 1) AS tp, count(*) FILTER (WHERE event_type = 'click' AND nr = 0) AS fp,
  count(*) FILTER (WHERE event_type = 'view' AND ng = 0) AS fn, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS tn FROM y GROUP BY user_id""")
def event_confusion_tolerance(s: SparkSession, d: str) -> DataFrame:
    e = wn.row_index(_events(s, d), ["user_id"], ["t"])
    e = e.withColumn("gen", F.when(F.col("event_type") == "click", "x").otherwise("")).withColumn("ref", F.when(F.col("event_type") == "view", "x").otherwise(""))
    return ag.confusion_with_tolerance(e, ["user_id"], "frame_no", 1)


@query(f"""
WITH {E}, x AS (SELECT user_id, event_type, count(*) AS votes, min(t) AS f FROM e GROUP BY ALL
), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS rn, sum(votes) OVER (PARTITION BY user_id) AS n FROM x)
SELECT user_id, event_type, votes, n::BIGINT AS n FROM y WHERE rn = 1""")
def event_vote_mode(s: SparkSession, d: str) -> DataFrame:
    return ag.vote_mode(_events(s, d), ["user_id"], "event_type", "t")


@query(f"""
WITH {E}, x AS (SELECT user_id, (event_type IN ('click', 'view', 'purchase'))::INT AS l, count(*) AS c, min(t) AS f FROM e GROUP BY ALL
), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) AS rn, sum(c) OVER (PARTITION BY user_id) AS n FROM x)
SELECT user_id, c AS votes, n::BIGINT AS n FROM y WHERE rn = 1 AND l = 1 AND c >= floor(n / 2)""")
def event_label_votes(s: SparkSession, d: str) -> DataFrame:
    return fl.by_votes(_events(s, d).withColumn("l", F.col("event_type").isin("click", "view", "purchase").cast("int")), "user_id", "l", "t")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def event_parse_props(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT floor(100.0 * c / n)::BIGINT AS percent, count(*) AS n FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) AS n FROM events GROUP BY user_id) GROUP BY 1")
def event_percent_histogram(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count("*").alias("all"))
    return ag.percent_histogram(u, F.col("c"), F.col("all"))


@query(f"WITH {E}, c AS (SELECT user_id, min(t) FILTER (WHERE t >= 1705276800) AS cut FROM e GROUP BY user_id) SELECT event_id FROM e JOIN c USING (user_id) WHERE cut IS NULL OR t <= cut")
def event_up_to_time(s: SparkSession, d: str) -> DataFrame:
    return rk.up_to_time(_events(s, d), ["user_id"], "t", 1705276800.0).select("event_id")


# --- streams of frames

TURNS = f"""{E}, u AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS pos, CASE event_type WHEN 'view' THEN 'frames' WHEN 'purchase' THEN 'frames' WHEN 'click' THEN 'assistant' WHEN 'error' THEN 'user' ELSE 'system' END AS role,
    event_type || event_id AS content, 1 + event_id % 4 AS len FROM e
), turns AS (SELECT *, sum(CASE WHEN role = 'frames' THEN len ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS "end" FROM u)"""


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Events as turns with frame numbers: views and purchases are 1 to 4 frames."""
    w = Window.partitionBy("user_id").orderBy("t")
    role = F.when(F.col("event_type").isin("view", "purchase"), "frames").when(F.col("event_type") == "click", "assistant").when(F.col("event_type") == "error", "user").otherwise("system")
    e = _events(s, d).withColumn("pos", F.row_number().over(w)).withColumn("role", role).withColumn("content", F.concat("event_type", "event_id")).withColumn("len", 1 + F.col("event_id") % 4)
    e = e.withColumn("end", F.sum(F.when(F.col("role") == "frames", F.col("len")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.withColumn("start", F.when(F.col("role") == "frames", F.col("end") - F.col("len"))).withColumn("end", F.when(F.col("role") == "frames", F.col("end"))).select("user_id", "pos", "role", "content", "start", "end")


@query(f"""
WITH {TURNS}, n AS (SELECT *, sum((role = 'frames')::INT) OVER (PARTITION BY user_id ORDER BY pos) AS isl FROM turns
), s AS (SELECT user_id, isl + 1 AS isl, string_agg(role || ':' || content, ' ' ORDER BY pos) AS texts FROM n WHERE role IN ('system', 'user') GROUP BY ALL
), r AS (SELECT user_id, isl, arg_max(content, pos) AS ref FROM n WHERE role = 'assistant' GROUP BY ALL
), f AS (SELECT n.user_id, n.isl, n."end" - n.len AS a, n."end" AS b, texts, ref FROM n LEFT JOIN s ON n.user_id = s.user_id AND n.isl = s.isl LEFT JOIN r ON n.user_id = r.user_id AND n.isl = r.isl WHERE role = 'frames'
), x AS (SELECT *, unnest(range(a::BIGINT, b::BIGINT)) AS fr FROM f)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY fr) - 1 AS frame_idx_in_stream, fr AS frame_idx_in_original_video, (row_number() OVER (PARTITION BY user_id ORDER BY fr)) / 2.0 AS timestamp_in_stream,
  CASE WHEN fr = a THEN texts END AS texts, CASE WHEN fr = b - 1 THEN coalesce(ref, '') ELSE '' END AS ref FROM x""")
def stream_expand_frames(s: SparkSession, d: str) -> DataFrame:
    x = sx.expand(_turns(s, d), "user_id")
    shown = F.array_join(F.transform("text_inputs", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), " ")
    return x.select("user_id", F.col("frame_idx_in_stream").cast("long").alias("frame_idx_in_stream"), "frame_idx_in_original_video", "timestamp_in_stream", shown.alias("texts"), "ref")


@query(f"""
WITH {TURNS} SELECT user_id, count(*) FILTER (WHERE role = 'user') AS "user", count(*) FILTER (WHERE role = 'assistant') AS talk, coalesce(sum(len - 1) FILTER (WHERE role = 'frames'), 0)::BIGINT AS not_talk,
  round(count(*) FILTER (WHERE role = 'assistant') / nullif(count(*) FILTER (WHERE role = 'assistant') + coalesce(sum(len - 1) FILTER (WHERE role = 'frames'), 0), 0), 6) AS talk_ratio FROM turns GROUP BY user_id""")
def stream_talk_counts(s: SparkSession, d: str) -> DataFrame:
    return ag.talk_counts(_turns(s, d), ["user_id"]).select("user_id", "user", "talk", F.col("not_talk").cast("long").alias("not_talk"), F.round("talk_ratio", 6).alias("talk_ratio"))


@query(f"""
WITH {TURNS}, k AS (SELECT *, CASE WHEN role = 'frames' AND lag(role) OVER (PARTITION BY user_id ORDER BY pos) = 'frames' THEN 0 ELSE 1 END AS c FROM turns WHERE role <> 'assistant'
), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY pos) AS run_no FROM k)
SELECT user_id, run_no::BIGINT AS run_no, arg_min(role, pos) AS role, min(CASE WHEN role = 'frames' THEN "end" - len END)::BIGINT AS start, max(CASE WHEN role = 'frames' THEN "end" END)::BIGINT AS "end", count(*) AS n FROM g GROUP BY user_id, run_no""")
def stream_merge_frames(s: SparkSession, d: str) -> DataFrame:
    return wn.merge_frame_runs(_turns(s, d), ["user_id"], ["pos"]).withColumn("run_no", F.col("run_no").cast("long"))


@query(f"""
WITH {TURNS}, a AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY user_id ORDER BY pos) AS k FROM turns
), b AS (SELECT user_id, pos, 0 AS part, role FROM a UNION ALL SELECT user_id, pos, 1, 'system' FROM a WHERE role = 'user' AND k = 1)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos, part) AS pos, role FROM b""")
def stream_insert_after_first_user(s: SparkSession, d: str) -> DataFrame:
    out = wn.insert_after_first(_turns(s, d), ["user_id"], ["pos"], "role", "user", "system")
    return out.select("user_id", F.col("pos").cast("long").alias("pos"), "role")


@query()
def stream_context_lengths(s: SparkSession, d: str) -> DataFrame:
    f = sx.expand(_turns(s, d), "user_id").select("user_id", F.col("frame_idx_in_stream").cast("long").alias("frame_idx"), (F.lit(10) + 20 * F.coalesce(F.size("text_inputs"), F.lit(0))).alias("tokens"), F.col("text_inputs").isNotNull().alias("has_user"))
    return sx.context_lengths(f, "user_id", 700, "drop_middle")


@query(f"""WITH RECURSIVE {E}, f AS (SELECT user_id AS sample_idx, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, event_type = 'click' AS gen, event_type = 'view' AS ref, count(*) OVER (PARTITION BY user_id) AS n FROM e
), costs AS (SELECT a.sample_idx, a.i, k, CASE WHEN b.ref THEN 0.0 ELSE 1.0 END + abs(k - 4) ** 1.5 * 0.3 / 4 ** 1.5 AS c FROM f a, range(7) r(k), f b WHERE a.gen AND b.sample_idx = a.sample_idx AND b.i = a.i + k - 4
), best AS (
  SELECT sample_idx, 0::BIGINT AS i, 0::BIGINT AS mask, 0.0::DOUBLE AS cost FROM f WHERE i = 0
  UNION ALL
  SELECT b.sample_idx, b.i + 1, (CASE WHEN c.k IS NULL THEN b.mask ELSE b.mask | (1::BIGINT << c.k) END) >> 1 AS mask, min(b.cost + coalesce(c.c, 0))
  FROM best b JOIN f ON f.sample_idx = b.sample_idx AND f.i = b.i LEFT JOIN costs c ON f.gen AND c.sample_idx = b.sample_idx AND c.i = b.i WHERE NOT f.gen OR (b.mask & (1::BIGINT << c.k)) = 0 GROUP BY ALL
) SELECT b.sample_idx, n_gen, round(min(cost), 6) AS total, true AS optimal FROM best b JOIN (SELECT sample_idx, max(n) AS n, count(*) FILTER (WHERE gen) AS n_gen FROM f GROUP BY ALL) g ON g.sample_idx = b.sample_idx AND g.n = b.i WHERE n_gen > 0 GROUP BY ALL""")
def stream_matches(s: SparkSession, d: str) -> DataFrame:
    """Least totals of the matching, proven by prices; the SQL goes over all sets of taken columns of the window."""
    return matching.proven(_match_frames(s, d), -4, 2)


def _match_frames(s: SparkSession, d: str) -> DataFrame:
    e = wn.row_index(_events(s, d), ["user_id"], ["t"])
    return e.select(F.col("user_id").alias("sample_idx"), F.col("frame_no").cast("long").alias("frame_idx"), F.when(F.col("event_type") == "click", "x").otherwise("").alias("gen"), F.when(F.col("event_type") == "view", "y").otherwise("").alias("ref"))


@query("""SELECT user_id AS sample_idx, count(*) FILTER (WHERE event_type = 'click') AS n_gen, count(*) FILTER (WHERE event_type = 'view') AS n_ref FROM events GROUP BY user_id HAVING n_gen + n_ref > 0""")
def stream_match_kinds(s: SparkSession, d: str) -> DataFrame:
    """Every generated turn is matched or redundant, every reference matched or missed, none twice."""
    m = matching.find_matches(_match_frames(s, d), -4, 2)
    return m.groupBy("sample_idx").agg(F.count_distinct(F.when(F.col("kind") != "missed", F.col("gen_idx"))).alias("n_gen"), F.count_distinct(F.when(F.col("kind") != "redundant", F.col("ref_idx"))).alias("n_ref"))


@query("""
WITH m AS (SELECT CASE event_type WHEN 'click' THEN 'matched' WHEN 'view' THEN 'missed' WHEN 'error' THEN 'redundant' END AS kind, event_id % 7 AS g, event_id % 5 AS r, (event_id % 10) / 10.0 AS s FROM events WHERE event_type IN ('click', 'view', 'error')
), c AS (SELECT count(*) FILTER (WHERE kind = 'matched') AS m0, count(*) FILTER (WHERE kind = 'matched' AND s > 0.5) AS m, count(*) FILTER (WHERE kind = 'missed') AS x, count(*) FILTER (WHERE kind = 'redundant') AS r,
  avg(abs(g - r)) FILTER (WHERE kind = 'matched' AND s > 0.5) / 2 AS td FROM m)
SELECT m0 AS n_matched, m AS n_good, round(m / (m0 + x + r), 6) AS jaccard, round(x / (m0 + x), 6) AS missing, round(r / (m0 + r), 6) AS redundant, round(m / (m0 + r), 6) AS "precision", round(m / (m0 + x), 6) AS recall, round(td, 6) AS time_diff,
  round(2 * (m / (m0 + r)) * (m / (m0 + x)) / (m / (m0 + r) + m / (m0 + x)), 6) AS f1 FROM c""")
def stream_metric_row(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "matched").when(F.col("event_type") == "view", "missed").otherwise("redundant")
    m = table(s, d, "events").where(F.col("event_type").isin("click", "view", "error")).select(kind.alias("kind"), (F.col("event_id") % 7).alias("gen_idx"), (F.col("event_id") % 5).alias("ref_idx"), ((F.col("event_id") % 10) / 10).alias("score"))
    out = metrics.stream_metrics(m, 2.0)
    return out.select("n_matched", "n_good", *[F.round(c, 6).alias(c) for c in ("jaccard", "missing", "redundant", "precision", "recall", "time_diff", "f1")])


CLIPS = """, t AS (SELECT user_id, pos - 1 AS i, role, content, CASE WHEN role = 'frames' THEN "end" - len END AS s, CASE WHEN role = 'frames' THEN "end" END AS e, CASE WHEN role = 'frames' THEN len * 10 ELSE length(content) END AS n, max(pos) OVER (PARTITION BY user_id) AS m FROM turns
), l AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS c1 FROM t
), walk AS (
  SELECT user_id, 0 AS k, 0::BIGINT AS i, NULL::BIGINT AS head, false AS stop FROM l WHERE i = 0
  UNION ALL
  SELECT w.user_id, w.k + 1, q.nxt, CASE WHEN h.role = 'frames' THEN greatest(0, h.e - {low} - ('0x' || substr(md5(w.user_id || ':' || (w.k + 1)), 1, 8))::BIGINT % {span}) END, q.nxt IS NULL OR h.i IS NULL
  FROM walk w JOIN LATERAL (
    SELECT max(a.i) FILTER (WHERE a.c1 - f.c0 + coalesce((f.e - w.head) * 10 - f.n, 0) <= {most}) AS fit, min(a.i) FILTER (WHERE a.c1 - f.c0 + coalesce((f.e - w.head) * 10 - f.n, 0) > {most}) AS over
    FROM l a, l f WHERE a.user_id = w.user_id AND a.role = 'assistant' AND a.i >= w.i AND f.user_id = w.user_id AND f.i = w.i
  ) x ON true JOIN LATERAL (
    SELECT CASE WHEN x.over IS NULL THEN NULL WHEN x.fit IS NOT NULL THEN x.fit + 1 WHEN x.over - 1 < w.i OR (SELECT p.role FROM l p WHERE p.user_id = w.user_id AND p.i = x.over - 1) <> 'frames' THEN NULL WHEN x.over - 1 = w.i AND w.head IS NOT NULL THEN x.over + 1 ELSE x.over - 1 END AS nxt
  ) q ON true LEFT JOIN l h ON h.user_id = w.user_id AND h.i = q.nxt WHERE NOT w.stop
), found AS (SELECT w.user_id, w.k, w.i AS a, w.head, max(l.i) AS b FROM walk w JOIN l f ON f.user_id = w.user_id AND f.i = w.i JOIN l ON l.user_id = w.user_id AND l.role = 'assistant' AND l.i >= w.i AND l.c1 - f.c0 + coalesce((f.e - w.head) * 10 - f.n, 0) <= {most} WHERE NOT w.stop GROUP BY ALL
), clips AS (SELECT f.user_id, f.k, f.a, f.b, f.head, count(*) AS n_turns, sum(l.n + CASE WHEN l.i = f.a AND f.head IS NOT NULL THEN (l.e - f.head) * 10 - l.n ELSE 0 END) AS size, min(CASE WHEN l.i = f.a AND f.head IS NOT NULL THEN f.head ELSE l.s END) AS lo, max(l.e) AS hi
  FROM found f JOIN l ON l.user_id = f.user_id AND l.i BETWEEN f.a AND f.b GROUP BY ALL)"""


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d).withColumn("length", F.when(F.col("role") == "frames", (F.col("end") - F.col("start")) * 10).otherwise(F.length("content"))).withColumnRenamed("user_id", "conv_id")


@query(f"""WITH RECURSIVE {TURNS}{CLIPS.format(low=1, span=12, most=120)}
SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS clip_idx, a + 1 AS first_pos, b + 1 AS last_pos, size::BIGINT AS seq_len, n_turns, coalesce(lo, 0)::BIGINT AS start_frame, coalesce(hi, 0)::BIGINT AS end_frame FROM clips""")
def conv_split_clips(s: SparkSession, d: str) -> DataFrame:
    return packing.split_conversations(_lengths(s, d), 120, (1, 12))


@query(f"""WITH RECURSIVE {TURNS}{CLIPS.format(low=1, span=12, most=120)}, kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS clip_idx FROM clips WHERE hi IS NOT NULL AND hi + 1 < 150
), noted AS (SELECT *, lag('p' || (b + 1)) OVER (PARTITION BY user_id ORDER BY clip_idx) AS progress FROM kept)
SELECT n.user_id AS conv_id, n.clip_idx, n.a + 1 AS first_pos, n.b + 1 AS last_pos, (n.size + 20 + 30)::BIGINT AS seq_len, (arg_min(CASE WHEN l.i = n.a AND n.head IS NOT NULL THEN n.head ELSE l.s END, l.i) FILTER (WHERE l.role = 'frames'))::BIGINT AS start_frame, (n.hi + 1)::BIGINT AS end_frame, progress,
  'system:You assist.' || coalesce(' ' || progress, '') || CASE WHEN n.clip_idx > 0 THEN ' know' ELSE '' END || ' | ' || string_agg(CASE WHEN l.role = 'frames' THEN 'frames:' || CASE WHEN l.i = n.a AND n.head IS NOT NULL THEN n.head ELSE l.s END::BIGINT || '-' || l.e::BIGINT ELSE l.role || ':' || l.content END, ' | ' ORDER BY l.i)
    || ' | system:Please summarize the progress. | frames:' || n.hi::BIGINT || '-' || (n.hi + 1)::BIGINT || ' | assistant:p' || (n.b + 1) AS told
FROM noted n JOIN l ON l.user_id = n.user_id AND l.i BETWEEN n.a AND n.b GROUP BY n.user_id, n.clip_idx, n.a, n.b, n.size, n.hi, progress, n.head""")
def conv_prepared_samples(s: SparkSession, d: str) -> DataFrame:
    """Samples with their conversations, written out."""
    t = _lengths(s, d).withColumn("progress", F.when(F.col("role") == "assistant", F.concat(F.lit("p"), F.col("pos").cast("string"))))
    out = packing.prepare_samples(t, 170, 20, 30, (1, 12), knowledge="know", n_frames=150)
    shown = F.transform("conversation", lambda x: F.when(x["role"] == "frames", F.concat(F.lit("frames:"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))).otherwise(F.concat(x["role"], F.lit(":"), x["content"])))
    return out.select("conv_id", "clip_idx", "first_pos", "last_pos", "seq_len", "start_frame", "end_frame", "progress", F.array_join(shown, " | ").alias("told"))


@query(f"""WITH RECURSIVE {E}, t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS pos, count(*) OVER (PARTITION BY user_id) AS m, CASE WHEN event_type = 'click' THEN 'assistant' ELSE 'user' END AS role, t / 86400 AS time FROM e
), w AS (
  SELECT user_id, pos, role, time AS before, NULL::DOUBLE AS fr, NULL::DOUBLE AS tt FROM t WHERE pos = 1
  UNION ALL
  SELECT t.user_id, t.pos, t.role, z.new, CASE WHEN z.near THEN z.now WHEN z.carried THEN z.fr END, CASE WHEN z.near THEN z.new WHEN z.carried THEN z.tt END FROM (
    SELECT y.*, CASE WHEN near THEN before + 1.0 ELSE now END AS new FROM (
      SELECT x.*, coalesce(now - before < 0.5, false) AND NOT (role = 'assistant' AND prole = 'user') AS near FROM (
        SELECT t.user_id, t.pos, t.role, w.role AS prole, w.before, w.fr, w.tt, coalesce(t.time - w.fr < 1.0, false) AND t.pos < t.m AS carried, CASE WHEN coalesce(t.time - w.fr < 1.0, false) AND t.pos < t.m THEN w.tt ELSE t.time END AS now FROM w JOIN t ON t.user_id = w.user_id AND t.pos = w.pos + 1) x) y) z JOIN t ON t.user_id = z.user_id AND t.pos = z.pos
) SELECT user_id, pos::INTEGER AS pos, role, before AS time FROM w""")
def event_adjust_times(s: SparkSession, d: str) -> DataFrame:
    t = _events(s, d).select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("t")).cast("int").alias("pos"), F.when(F.col("event_type") == "click", "assistant").otherwise("user").alias("role"), (F.col("t") / 86400).alias("time"))
    return packing.adjust_times(t, "user_id")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, role, left(text, 8) AS content, floor(turn * (conv_id % 7) * 0.9 * 2)::BIGINT AS raw, 9 + conv_id % 6 AS n, floor((conv_id % 3) * 0.8 * 2)::BIGINT AS s0 FROM conversations
), w AS (
  SELECT conv_id, turn, s0 AS a, CASE WHEN least(raw, n - 1) > s0 THEN least(raw, n - 1) ELSE s0 + 1 END AS b FROM c WHERE turn = 0 AND CASE WHEN least(raw, n - 1) > s0 THEN least(raw, n - 1) ELSE s0 + 1 END < n
  UNION ALL
  SELECT c.conv_id, c.turn, w.b, CASE WHEN least(raw, n - 1) > w.b THEN least(raw, n - 1) ELSE w.b + 1 END FROM w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1 WHERE CASE WHEN least(raw, n - 1) > w.b THEN least(raw, n - 1) ELSE w.b + 1 END < n
), x AS (SELECT w.conv_id, w.turn, 0 AS part, 'frames' AS role, NULL AS content, a AS start, b AS "end" FROM w UNION ALL SELECT w.conv_id, w.turn, 1, role, content, NULL, NULL FROM w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn
  UNION ALL SELECT conv_id, turn, 2, 'system', 'know ' || conv_id, NULL, NULL FROM (SELECT w.conv_id, min(w.turn) AS turn FROM w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn WHERE role = 'user' GROUP BY ALL))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS pos, role, content, start, "end" FROM x""")
def conv_framed(s: SparkSession, d: str) -> DataFrame:
    """Timed turns as conversations of frames, with knowledge behind the first user turn."""
    c = table(s, d, "conversations").withColumn("content", F.left("text", F.lit(8))).withColumn("time", F.col("turn") * (F.col("conv_id") % 7) * 0.9).withColumn("n", 9 + F.col("conv_id") % 6).withColumn("at", (F.col("conv_id") % 3) * 0.8)
    out = wn.framed(c, ["conv_id"], ["turn"], "time", 2.0, "n", "at", F.concat(F.lit("know "), F.col("conv_id").cast("string")))
    return out.select("conv_id", F.col("pos").cast("long").alias("pos"), "role", "content", "start", "end")


# --- conversations and text


@query("SELECT role, count(*) AS turns, sum(len(string_split_regex(trim(text), '\\s+')))::BIGINT AS words, round(sum(len(string_split_regex(trim(text), '\\s+'))) / count(*), 6) AS words_per_turn FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role")
def conv_turn_stats(s: SparkSession, d: str) -> DataFrame:
    return ag.words_per_turn(table(s, d, "conversations"), ["role"], "text")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_assistant FROM conversations")
def conv_last_nonnull(s: SparkSession, d: str) -> DataFrame:
    return wn.last_value(table(s, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "assistant", F.col("turn")), "last_assistant").select("conv_id", "turn", "last_assistant")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE rn <= 1 OR rn > n - 1")
def conv_head_tail(s: SparkSession, d: str) -> DataFrame:
    return wn.head_and_tail(table(s, d, "conversations"), ["conv_id"], ["turn"], 2).select("conv_id", "turn")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, len(string_split_regex(trim(text), '\\s+')) AS w FROM conversations
), g AS (SELECT conv_id, turn, rn, 0 AS clip_id, w AS s FROM c WHERE rn = 1
  UNION ALL SELECT c.conv_id, c.turn, c.rn, CASE WHEN g.s > 30 THEN g.clip_id + 1 ELSE g.clip_id END, CASE WHEN g.s > 30 THEN c.w ELSE g.s + c.w END FROM g JOIN c ON c.conv_id = g.conv_id AND c.rn = g.rn + 1)
SELECT conv_id, turn, clip_id::BIGINT AS clip_id FROM g""")
def conv_greedy_pack(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select("conv_id", "turn", tx.word_count(F.col("text")).alias("w"))
    return wn.greedy_groups(c, ["conv_id"], ["turn"], "w", 30).select("conv_id", "turn", F.col("clip_id").cast("long").alias("clip_id"))


@query("""SELECT c.conv_id, c.turn, string_agg(p.role, ',' ORDER BY p.turn) AS history FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn <= c.turn WHERE c.role = 'assistant' GROUP BY c.conv_id, c.turn""")
def conv_progress_prefix(s: SparkSession, d: str) -> DataFrame:
    out = wn.prefixes(table(s, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "assistant", "role")
    return out.select("conv_id", "turn", F.array_join("history", ",").alias("history"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, turn::DOUBLE AS time, trim(replace(text, chr(10), ' ')) AS content FROM conversations WHERE role <> 'system'")
def conv_parse_dialog(s: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(".0s] "), F.initcap("role"), F.lit(": "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    c = table(s, d, "conversations").groupBy("conv_id").agg(text.alias("text"))
    out = c.select("conv_id", F.posexplode(tx.parse_dialog(F.col("text"), with_labels=False)).alias("k", "t"))
    return out.select("conv_id", F.col("k").cast("long").alias("k"), "t.role", "t.time", "t.content")


@query("""SELECT conv_id, string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(text) || '<|eot_id|>', '' ORDER BY turn) AS chat FROM conversations GROUP BY conv_id""")
def conv_chat_template(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("int")
    turn = F.struct("turn", "role", F.col("text").alias("content"), none.alias("start"), none.alias("end"))
    return table(s, d, "conversations").groupBy("conv_id").agg(tx.chat_text(F.sort_array(F.collect_list(turn))).alias("chat"))


@query("SELECT conv_id, turn, upper(left(trim(text), 1)) || lower(substr(trim(text), 2)) || CASE WHEN regexp_matches(trim(text), '[.?!]$') THEN '' ELSE '.' END AS caption FROM conversations")
def conv_caption(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", tx.caption(F.col("text")).alias("caption"))


@query("SELECT conv_id, turn, floor(len(string_split_regex(trim(text), '\\s+')) * 1.3::DOUBLE)::BIGINT + (turn % 3) * 500 AS tokens FROM conversations")
def conv_token_estimate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", tx.tokens_estimate(F.col("text"), F.col("turn") % 3).cast("long").alias("tokens"))


@query("SELECT event_id, CASE WHEN position('i' in event_type) > 0 THEN 'instruction' ELSE 'other' END AS label, 2 AS n, round(value, 1) AS a FROM events")
def event_step_times(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    text = F.concat(F.lit("x ["), F.round("value", 1).cast("string"), F.lit("s-99.5s] [abc] "), F.when(F.col("event_type").contains("i"), "instruction").otherwise("none"))
    times = tx.step_times(text)
    return e.select("event_id", tx.intention(text).alias("label"), F.size(times).alias("n"), F.element_at(times, 1).alias("a"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Turns and those before them; texts travel as they are and become words afterwards."""
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    c = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    words = [F.split(F.trim(F.lower(x)), r"\s+").alias(name) for x, name in (("text", "hyp"), ("before", "ref"))]
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), *words)


PAIRS = """p AS (SELECT conv_id * 1000 + turn AS pair_id, hyp, ref FROM (
  SELECT *, lag(hyp) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM (SELECT conv_id, turn, string_split_regex(trim(lower(text)), '\\s+') AS hyp FROM conversations)) WHERE ref IS NOT NULL
), k AS (SELECT unnest([1, 2, 3, 4]) AS n
), h AS (SELECT pair_id, n, array_to_string(hyp[i : i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT pair_id, hyp, n, unnest(range(1, len(hyp) - n + 2)) AS i FROM p, k) GROUP BY ALL
), r AS (SELECT pair_id, n, array_to_string(ref[i : i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT pair_id, ref, n, unnest(range(1, len(ref) - n + 2)) AS i FROM p, k) GROUP BY ALL)"""


@query(f"""
WITH {PAIRS}, m AS (SELECT h.n, sum(least(h.c, coalesce(r.c, 0))) AS correct FROM h LEFT JOIN r USING (pair_id, n, g) GROUP BY h.n
), z AS (SELECT k.n, coalesce(correct, 0) AS correct, (SELECT sum(greatest(len(hyp) - k.n + 1, 0)) FROM p) AS guess FROM k LEFT JOIN m USING (n)
), l AS (SELECT sum(len(hyp)) AS test_len, sum(len(ref)) AS ref_len FROM p
), b AS (SELECT *, (test_len + 1e-15) / (ref_len + 1e-9) AS ratio FROM l
), f AS (SELECT test_len::BIGINT AS test_len, ref_len::BIGINT AS ref_len, CASE WHEN ratio < 1 THEN exp(1 - 1 / ratio) ELSE 1 END AS bp FROM b
), q AS (SELECT n, exp(sum(ln((correct + 1e-15) / (guess + 1e-9))) OVER (ORDER BY n) / n) AS v FROM z)
SELECT test_len, ref_len, round(bp * max(v) FILTER (WHERE n = 1), 6) AS bleu_1, round(bp * max(v) FILTER (WHERE n = 2), 6) AS bleu_2, round(bp * max(v) FILTER (WHERE n = 3), 6) AS bleu_3, round(bp * max(v) FILTER (WHERE n = 4), 6) AS bleu_4 FROM f, q GROUP BY test_len, ref_len, bp""")
def bleu_corpus(s: SparkSession, d: str) -> DataFrame:
    out = metrics.bleu(_pairs(s, d).select("pair_id", "hyp", F.array("ref").alias("refs")))
    return out.select(F.col("test_len").cast("long").alias("test_len"), F.col("ref_len").cast("long").alias("ref_len"), *[F.round(f"bleu_{n}", 6).alias(f"bleu_{n}") for n in range(1, 5)])


@query(f"""
WITH {PAIRS}, t AS (SELECT ln(count(*)::DOUBLE) AS ln_n FROM p), df AS (SELECT n, g, count(*) AS df FROM r GROUP BY ALL
), hw AS (SELECT pair_id, h.n, h.g, h.c * (ln_n - ln(greatest(coalesce(df, 0), 1)::DOUBLE)) AS w FROM h LEFT JOIN df ON h.n = df.n AND h.g = df.g, t
), rw AS (SELECT pair_id, r.n, r.g, r.c * (ln_n - ln(greatest(coalesce(df, 0), 1)::DOUBLE)) AS w FROM r LEFT JOIN df ON r.n = df.n AND r.g = df.g, t
), hn AS (SELECT pair_id, n, sqrt(sum(w * w)) AS hn FROM hw GROUP BY ALL), rn AS (SELECT pair_id, n, sqrt(sum(w * w)) AS rn FROM rw GROUP BY ALL
), dt AS (SELECT pair_id, n, sum(least(hw.w, rw.w) * rw.w) AS dot FROM hw JOIN rw USING (pair_id, n, g) GROUP BY ALL
), sm AS (SELECT hn.pair_id, sum(coalesce(dot / nullif(hn * rn, 0), 0)) AS s FROM hn JOIN rn USING (pair_id, n) LEFT JOIN dt USING (pair_id, n) GROUP BY hn.pair_id)
SELECT p.pair_id, round(coalesce(s, 0) * exp(-pow(greatest(len(hyp) - 1, 0) - greatest(len(ref) - 1, 0), 2) / 72) / 4 * 10, 5) AS cider FROM p LEFT JOIN sm USING (pair_id)""")
def cider_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(s, d).select("pair_id", "hyp", F.array("ref").alias("refs"))
    # A turn is in two pairs, whose ids follow each other.
    return metrics.cider(pairs, together=F.floor(F.col("pair_id") / 64)).select("pair_id", F.round("cider", 5).alias("cider"))


@query("""WITH p AS (SELECT conv_id AS id, list(string_split(left(lower(replace(text, chr(10), ' ')), 60), ' ') ORDER BY turn) AS t FROM conversations WHERE turn < 4 GROUP BY conv_id
), x AS (SELECT id, k - 1 AS k, t[k] AS w, len(t) - 1 AS refs FROM p, range(1, 5) r(k) WHERE k <= len(t)
), g AS (SELECT id, k, n, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS c FROM x, range(1, 5) r(n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) u GROUP BY ALL
), df AS (SELECT n, g, count(DISTINCT id) AS df FROM g WHERE k > 0 GROUP BY ALL
), v AS (SELECT g.id, g.k, g.n, g.g, g.c * (ln((SELECT count(*) FROM p)::DOUBLE) - ln(greatest(coalesce(df, 0), 1)::DOUBLE)) AS w FROM g LEFT JOIN df ON g.n = df.n AND g.g = df.g
), norm AS (SELECT id, k, n, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL
), dot AS (SELECT r.id, r.k, r.n, sum(least(h.w, r.w) * r.w) AS dot FROM v r JOIN v h ON h.id = r.id AND h.k = 0 AND h.n = r.n AND h.g = r.g WHERE r.k > 0 GROUP BY ALL
), s AS (SELECT d.id, d.k, sum(coalesce(d.dot / nullif(a.norm * b.norm, 0), 0)) AS s FROM dot d JOIN norm a ON a.id = d.id AND a.k = 0 AND a.n = d.n JOIN norm b ON b.id = d.id AND b.k = d.k AND b.n = d.n GROUP BY ALL)
SELECT x.id AS conv_id, round(coalesce(sum(coalesce(s, 0) * exp(-pow(greatest(len(h.w) - 1, 0) - greatest(len(x.w) - 1, 0), 2) / 72) / 4 * 10) FILTER (WHERE x.k > 0) / max(x.refs), 0), 5) AS cider FROM x JOIN x h ON h.id = x.id AND h.k = 0 LEFT JOIN s ON s.id = x.id AND s.k = x.k GROUP BY x.id""")
def cider_references(s: SparkSession, d: str) -> DataFrame:
    """Each conversation's first turn against up to three later ones as references."""
    words = F.split(F.left(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), F.lit(60)), " ")
    c = table(s, d, "conversations").where("turn < 4").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", words.alias("t")))), lambda x: x["t"]).alias("t"))
    pairs = c.select(F.col("conv_id"), F.col("t")[0].alias("hyp"), F.slice("t", F.lit(2), F.lit(9)).alias("refs"))
    return metrics.cider(pairs, id_col="conv_id").select("conv_id", F.round("cider", 5).alias("cider"))


# --- curation, ranking, sets


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def top1_per_type(s: SparkSession, d: str) -> DataFrame:
    return rk.top_one(table(s, d, "orders"), ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE rn <= ceil(n * 0.3::DOUBLE)")
def topk_ratio(s: SparkSession, d: str) -> DataFrame:
    return rk.share_of(table(s, d, "orders"), ["o_orderpriority"], [F.col("o_totalprice"), F.col("o_orderkey")], 0.3).select("o_orderkey")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, unnest([1, 2])::BIGINT AS copy FROM nation")
def topk_ratio_repeat(s: SparkSession, d: str) -> DataFrame:
    return rk.share_of(table(s, d, "nation"), ["n_regionkey"], [F.col("n_nationkey")], 2.5).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("copy").cast("long").alias("copy"))


@query("""
WITH t AS (SELECT o_orderkey, 'train' AS use FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_totalprice >= 30000) WHERE rn <= ceil(n * 0.5::DOUBLE)
), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_totalprice >= 50000) WHERE rn = 1
), f AS (SELECT o_custkey FROM b GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5)
SELECT o_orderkey, use FROM t UNION ALL SELECT o_orderkey, 'eval' FROM b WHERE o_custkey IN (SELECT o_custkey FROM f)""")
def curate_orders(s: SparkSession, d: str) -> DataFrame:
    return quality.curate(table(s, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey", 30000, 50000, 5, 0.5).select("o_orderkey", "use")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5)")
def filter_complete_types(s: SparkSession, d: str) -> DataFrame:
    return fl.complete_types(table(s, d, "orders"), "o_custkey", "o_orderpriority", 5).select("o_orderkey")


@query("SELECT doc_id, CASE WHEN rn <= floor(n * 0.5) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def split_hash_50_50(s: SparkSession, d: str) -> DataFrame:
    return rk.split_by_share(table(s, d, "documents"), "lang", [rk.seeded_key(F.col("doc_id")), F.col("doc_id")]).select("doc_id", "split")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 400 THEN 'train' ELSE 'val' END AS split FROM orders")
def split_positional(s: SparkSession, d: str) -> DataFrame:
    return rk.split_at(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 400)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn <= greatest(floor((n - 1) * 0.2::DOUBLE), 1)")
def sample_negatives(s: SparkSession, d: str) -> DataFrame:
    return rk.sample_share(table(s, d, "documents"), ["source"], 0.2, F.col("doc_id"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, lang, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS e FROM documents) WHERE e = 1) WHERE rank <= 5")
def topk_distinct_source(s: SparkSession, d: str) -> DataFrame:
    return rk.top_distinct(table(s, d, "documents"), "lang", "source", [F.col("n_chars").desc(), F.col("doc_id")], 5).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY len(string_split_regex(trim(text), '\\s+')) DESC, doc_id) AS rn FROM documents) WHERE rn <= 10")
def topk_longest(s: SparkSession, d: str) -> DataFrame:
    return rk.first_rows(table(s, d, "documents"), ["lang"], [tx.word_count(F.col("text")).desc(), F.col("doc_id")], 10).select("doc_id")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS rn FROM lineitem) WHERE rn % 3 = 1")
def shard_by_rank(s: SparkSession, d: str) -> DataFrame:
    return rk.shard(table(s, d, "lineitem"), "l_orderkey", ["l_linenumber"], 1, 3).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_linenumber AS s, l_linenumber + l_quantity::BIGINT AS e FROM lineitem), b AS (SELECT *, greatest(1, floor((e - s) * 0.2::DOUBLE))::BIGINT AS k FROM a), c AS (SELECT *, greatest(1, (e - s) // k) AS st FROM b)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, array_to_string((range(s::BIGINT, e::BIGINT, st::BIGINT))[1:k], ',') AS frames FROM c""")
def sample_frames_stride(s: SparkSession, d: str) -> DataFrame:
    start = F.col("l_linenumber")
    x = rk.strided(start, start + F.col("l_quantity").cast("int"), 0.2)
    return table(s, d, "lineitem").select("l_orderkey", start.cast("long").alias("l_linenumber"), F.array_join(x.cast("array<string>"), ",").alias("frames"))


@query("SELECT n_name AS name, unnest([1, 2])::BIGINT AS copy FROM nation UNION ALL SELECT r_name, 1 FROM region")
def repeat_union(s: SparkSession, d: str) -> DataFrame:
    parts = [(table(s, d, "nation").select(F.col("n_name").alias("name")), 2), (table(s, d, "region").select(F.col("r_name").alias("name")), 1)]
    return st.repeated_union(parts).select("name", F.col("copy").cast("long").alias("copy"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(s: SparkSession, d: str) -> DataFrame:
    return st.done_and_todo(table(s, d, "documents"), table(s, d, "labels"), "doc_id")[1].select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def resume_done(s: SparkSession, d: str) -> DataFrame:
    return st.done_and_todo(table(s, d, "documents"), table(s, d, "labels"), "doc_id")[0].select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def blocklist_anti(s: SparkSession, d: str) -> DataFrame:
    return fl.drop_listed(table(s, d, "customer"), "c_custkey", table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")).select("c_custkey")


@query("""
WITH m AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS tr FROM orders GROUP BY 1), o AS (SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'val' WHEN 'MACHINERY' THEN 'test' END AS s FROM customer)
SELECT c_custkey AS k, CASE WHEN m.tr THEN 'train' ELSE o.s END AS split FROM customer LEFT JOIN m ON m.k = c_custkey LEFT JOIN o ON o.k = c_custkey WHERE m.tr OR o.s IS NOT NULL""")
def split_membership(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    member = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1"), "train").otherwise("val").alias("split"))
    own = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") == "BUILDING", "val").when(F.col("c_mktsegment") == "MACHINERY", "test").alias("split"))
    return jn.split_of(c.select(F.col("c_custkey").alias("k")), "k", member, own)


# --- joins and aggregates over the star schema


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_required_dim(s: SparkSession, d: str) -> DataFrame:
    dim = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return jn.required(table(s, d, "lineitem"), dim, "l_partkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "p_brand")


@query("SELECT o_orderkey, string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_collect_lines(s: SparkSession, d: str) -> DataFrame:
    child = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = jn.collected(table(s, d, "orders").select("o_orderkey"), child, "o_orderkey", ["l_partkey"], ["l_linenumber", "l_partkey"], "lines")
    return out.select("o_orderkey", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), " ").alias("lines"))


@query("SELECT o_orderkey, (SELECT arg_min(l_partkey, l_linenumber * 1000000 + l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS l_partkey FROM orders")
def join_first_match(s: SparkSession, d: str) -> DataFrame:
    right = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("place"))
    return jn.first_match(table(s, d, "orders").select("o_orderkey"), right, ["o_orderkey"], "place").select("o_orderkey", "l_partkey")


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS i, b.vec_id AS j, round(1 - abs(list_cosine_similarity(a.e, b.e)), 5) AS cost FROM v a JOIN v b ON a.label = b.label AND b.vec_id BETWEEN a.vec_id - 20 AND a.vec_id + 10 AND a.vec_id <> b.vec_id""")
def cosine_window_pairs(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    a, b = v.select("label", F.col("vec_id").alias("i"), F.col("embedding").alias("x")), v.select("label", F.col("vec_id").alias("j"), F.col("embedding").alias("y"))
    return jn.band(a, b, "label", "i", "j", -20, 10).where("i <> j").select("i", "j", F.round(tm.semantic_cost(F.col("x"), F.col("y")), 5).alias("cost"))


@query("""
WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, vec_id FROM embeddings), s AS (SELECT DISTINCT label, (label % 4) AS a, (label % 4) + 5 AS b FROM embeddings)
SELECT v.vec_id, v.f AS frame_idx FROM s JOIN v ON s.label = v.label WHERE f >= a AND f < b""")
def join_frames_slice(s: SparkSession, d: str) -> DataFrame:
    v = wn.row_index(table(s, d, "embeddings").withColumnRenamed("label", "video_uid"), ["video_uid"], ["vec_id"]).withColumn("frame_idx", F.col("frame_no").cast("long"))
    samples = v.select("video_uid").distinct().select("video_uid", (F.col("video_uid") % 4).alias("start_frame_idx"), (F.col("video_uid") % 4 + 5).alias("end_frame_idx"))
    return jn.frame_slice(samples, v.select("video_uid", "vec_id", "frame_idx")).select("vec_id", "frame_idx")


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, grouping(r_name, n_name)::BIGINT AS level FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def stats_rollup_totals(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "region").join(table(s, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ag.rollup_totals(j, ["r_name", "n_name"], [F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")])


@query("SELECT lang, floor(n_chars / 500)::BIGINT AS bin, count(*) AS n FROM documents GROUP BY ALL")
def hist_fixed_bins(s: SparkSession, d: str) -> DataFrame:
    return ag.histogram(table(s, d, "documents"), ["lang"], F.col("n_chars"), 0, 500)


@query("SELECT p_brand, label, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS label FROM part) GROUP BY ALL")
def label_explode_counter(s: SparkSession, d: str) -> DataFrame:
    return ag.exploded_counts(table(s, d, "part"), ["p_brand"], "p_type", " ")


@query("SELECT lang, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def judge_mean_scores(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return ag.judge_means(j, ["lang"], ["quality", "toxic"])[0].select("lang", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query("SELECT lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1 GROUP BY lang")
def filter_not_equal_null(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return fl.not_equal(j, "quality", 1).groupBy("lang").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT l_orderkey, sum(l_quantity) / max(o_totalprice / 1000) AS ann_ratio, count(*) AS num_steps FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
SELECT l_orderkey, round(ann_ratio, 6) AS ann_ratio, num_steps, CASE WHEN ann_ratio < 0.5 THEN 'ann_ratio below 0.5' END AS reason_to_exclude FROM a""")
def gate_ann_ratio(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.lit(0.0).alias("a"), F.col("l_quantity").alias("b"), (F.col("o_totalprice") / 1000).alias("dur"))
    out = fl.gate_ratio(fl.coverage(j, ["l_orderkey"], "a", "b", "dur"))
    return out.withColumn("ann_ratio", F.round("ann_ratio", 6))


@query("""
WITH b AS (SELECT p_partkey, 200 AS width, 100 AS height, p_partkey % 190 AS x, p_partkey % 90 AS y, p_size AS w, p_size % 7 AS h FROM part)
SELECT p_partkey FROM b WHERE NOT (x + w < 75 OR x > 125 OR y + h < 25 OR y > 75)""")
def filter_center_box(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    b = table(s, d, "part").select("p_partkey", F.lit(200).alias("width"), F.lit(100).alias("height"), (k % 190).alias("x"), (k % 90).alias("y"), F.col("p_size").alias("w"), (F.col("p_size") % 7).alias("h"))
    return fl.in_centre(b).select("p_partkey")


@query("""
WITH c AS (SELECT p_brand, split_part(p_type, ' ', 1) AS noun, count(*) AS n, max(p_retailprice) AS a FROM part GROUP BY ALL)
SELECT p_brand, string_agg(CASE WHEN n > 1 THEN n || ' ' || noun || CASE WHEN ends_with(noun, 's') THEN '' ELSE 's' END ELSE noun END, ', ' ORDER BY a DESC, noun) AS objects FROM c GROUP BY p_brand""")
def count_repeat_objects(s: SparkSession, d: str) -> DataFrame:
    return ag.objects_text(table(s, d, "part").withColumn("noun", F.split_part("p_type", F.lit(" "), F.lit(1))), "p_brand", "noun", "p_retailprice")


@query("SELECT l_orderkey, ((rn - 1) // 3)::BIGINT AS clip_id, count(*) AS n FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem) GROUP BY ALL")
def fixed_chunks(s: SparkSession, d: str) -> DataFrame:
    return wn.fixed_groups(table(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber"], 3).groupBy("l_orderkey", F.col("clip_id").cast("long").alias("clip_id")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), c AS (SELECT DISTINCT l_orderkey, (rn - 1) // 2 AS clip_id, n FROM r)
SELECT c.l_orderkey, c.clip_id::BIGINT AS clip_id, string_agg(l_partkey::VARCHAR, chr(10) ORDER BY rn) AS description, count(*) AS n_lines FROM c JOIN r ON r.l_orderkey = c.l_orderkey AND rn BETWEEN clip_id * 2 + 1 - 5 AND least((clip_id + 1) * 2, c.n) + 4 GROUP BY ALL""")
def context_chunks(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").withColumn("p", F.col("l_partkey").cast("string"))
    return wn.with_context(x, ["l_orderkey"], ["l_linenumber", "l_partkey"], 2, "p").withColumn("clip_id", F.col("clip_id").cast("long"))


@query("""
SELECT event_id, round_even(value * 2, 0)::BIGINT AS f, floor(value * 2)::BIGINT AS lo, ceil(value * 2)::BIGINT AS hi, lpad(event_id::VARCHAR, 10, '0') || '.jpg' AS file,
  round(abs(event_id % 9 - event_id % 5) ** 1.5 * 0.3 / 8, 6) AS cost, round(greatest(least(value + 10, 60) - greatest(value, 50), 0) / (20 - greatest(least(value + 10, 60) - greatest(value, 50), 0)), 6) AS iou FROM events""")
def scalar_time_functions(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(s, d, "events").select(
        "event_id",
        tm.frame_index(v, 2.0).alias("f"),
        tm.frame_index(v, 2.0, "floor").alias("lo"),
        tm.frame_index(v, 2.0, "ceil").alias("hi"),
        tm.frame_file(F.col("event_id")).alias("file"),
        F.round(tm.distance_cost(F.col("event_id") % 9, F.col("event_id") % 5, -4, 2), 6).alias("cost"),
        F.round(tm.overlap_ratio(v, v + 10, F.lit(50.0), F.lit(60.0)), 6).alias("iou"),
    )
