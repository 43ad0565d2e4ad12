"""Queries that apply the column rules and the plainer operators to the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as tx
from dialoom.functions import timing as tm
from dialoom.operators import aggregates as ag
from dialoom.operators import filters as fl
from dialoom.operators import joins as jn
from dialoom.operators import ranking as rk
from dialoom.operators import sets as st
from dialoom.plans.catalog import query
from dialoom.session import table
from dialoom.sources import readers as rd


def _cases(s: SparkSession, d: str, *values: str) -> tuple[DataFrame, Column]:
    """Events, and for each of them one of the texts, by its id."""
    return table(s, d, "events"), F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))


def _case_sql(*results: str) -> str:
    return f"[{', '.join(results)}][event_id % {len(results)} + 1]"


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, turn::DOUBLE AS time,
  CASE WHEN turn % 3 = 2 THEN '' ELSE left(split_part(trim(text), chr(10), 1), 20) || '.' END AS content, CASE WHEN role <> 'assistant' THEN '' WHEN turn % 3 = 2 THEN 'initiative|other' ELSE 'responsive|correction' END AS labels
FROM conversations WHERE role IN ('user', 'assistant') AND turn % 7 <> 5""")
def conv_parse_labels(s: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.left(F.split_part(F.trim("text"), F.lit("\n"), F.lit(1)), F.lit(20)), F.lit("."))
    said = F.when(F.col("turn") % 7 == 5, F.concat(F.lit("(aside) "), said)).when(F.col("turn") % 3 == 2, "").when(F.col("turn") % 3 == 0, F.concat(said, F.lit(" [Responsive|Correction]"))).otherwise(F.concat(F.lit("[RESPONSIVE|correction] "), said))
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(".0s] "), F.initcap("role"), F.lit(": "), said)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    c = table(s, d, "conversations").groupBy("conv_id").agg(text.alias("text"))
    out = c.select("conv_id", F.posexplode(tx.parse_dialog(F.col("text"))).alias("k", "t"))
    return out.select("conv_id", F.col("k").cast("long").alias("k"), "t.role", "t.time", "t.content", "t.labels")


@query("""SELECT conv_id, string_agg('[' || turn || '.0s] ' || upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || left(role, 3) || ' [x|' || turn || ']' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def conv_to_text(s: SparkSession, d: str) -> DataFrame:
    turn = F.struct(F.col("turn").cast("double").alias("time"), "role", F.left("role", F.lit(3)).alias("content"), F.concat(F.lit("x|"), F.col("turn").cast("string")).alias("labels"))
    return table(s, d, "conversations").groupBy("conv_id").agg(tx.conversation_text(F.sort_array(F.collect_list(turn))).alias("text"))


@query("""SELECT event_id, (event_id % 7) * 3600 + (event_id % 50) * 60 + 1.5 AS clock, event_id / 1e7 AS ticks, ((event_id % 50) * 120 + 1)::BIGINT AS frame, printf('00:%02d:%02d', event_id % 50, 30) AS shown,
  CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS cost, floor(least(event_id % 70 / 300.0 * 60, 10) * 2)::INTEGER AS pause, (event_id % 4) * 10 + greatest(event_id % 4 - 1, 0) AS tokens,
  CASE WHEN event_id % 4 > 1 THEN (event_id % 4 - 1)::INTEGER ELSE 0 END AS ranges, (200 + 2 * (event_id % 9))::INTEGER AS width, floor((50 - (event_id % 3) * 10) / 2)::INTEGER AS top FROM events""")
def clock_rules(s: SparkSession, d: str) -> DataFrame:
    e, i = table(s, d, "events"), F.col("event_id")
    clock = F.concat((i % 7).cast("string"), F.lit(":"), (i % 50).cast("string"), F.lit(":1.5"))
    wide = tm.cover_size((100 + i % 9) * 2, F.lit(200), 200)
    fit = tm.pad_size(F.lit(50), (i % 3) * 10, 50)
    return e.select(
        "event_id",
        tm.clock_seconds(clock).alias("clock"),
        tm.tick_seconds(i).alias("ticks"),
        tm.clock_frame_index(F.concat(F.lit("00:"), F.lpad((i % 50).cast("string"), 2, "0"), F.lit(":00.500")), 2.0).alias("frame"),
        tm.frame_clock((i % 50) * 120 + 59, 2.0).alias("shown"),
        tm.talk_cost(F.when(i % 3 == 0, "a").otherwise(""), F.lit("b")).alias("cost"),
        tm.pause_repeats(i % 70, 2.0).alias("pause"),
        tm.frames_tokens(i % 4, 10, True).alias("tokens"),
        F.size(tm.learn_ranges((i % 4).cast("int"), 7, 10, 1)).alias("ranges"),
        wide[0].alias("width"),
        fit[3].alias("top"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 4 <= 1 THEN 7 ELSE -100 END AS at0, 4 - event_id % 4 AS n, 5 AS size FROM events""")
def label_shift_rules(s: SparkSession, d: str) -> DataFrame:
    i = (F.col("event_id") % 4).cast("int")
    labels = tm.shifted_labels(F.array(*[F.lit(6 + k) for k in range(5)]), i, F.lit(4))
    kept = F.size(F.filter(labels, lambda x: x != -100)) + F.when(i == 0, 1).otherwise(0)
    return table(s, d, "events").select("event_id", labels[0].alias("at0"), kept.cast("long").alias("n"), F.size(labels).alias("size"))


@query("""SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#13' UNION ALL SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'STEEL') OR contains(p_type, 'TIN')
UNION ALL SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, 'ECONOMY') UNION ALL SELECT p_partkey, 'not' FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') OR p_brand IS NULL""")
def text_filters(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    out = fl.keep_equal(p, "p_brand", "Brand#13").select("p_partkey", "p_brand")
    out = out.unionByName(fl.contains_any(p, "p_type", ["STEEL", "TIN"]).select("p_partkey", F.col("p_type").alias("p_brand")))
    out = out.unionByName(fl.starts_with_any(p, "p_type", ["ECONOMY"]).select("p_partkey", F.col("p_name").alias("p_brand")))
    return out.unionByName(fl.not_among(p, "p_brand", ["Brand#11", "Brand#12"]).select("p_partkey", F.lit("not").alias("p_brand")))


@query("""SELECT conv_id, count(*) AS n FROM conversations WHERE turn <= 3 GROUP BY conv_id""")
def conv_turns_before(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("time"))).alias("turns"))
    return c.select("conv_id", F.size(fl.turns_before(F.col("turns"), F.lit(3))).cast("long").alias("n")).where("n > 0")


@query("""SELECT event_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 5 <= 3 UNION ALL SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') UNION ALL SELECT event_id FROM events WHERE event_id % 4 <> 0""")
def event_filters(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("is_relevant", F.when(F.col("event_id") % 3 == 0, "essential").when(F.col("event_id") % 3 == 1, "optional"))
    out = fl.essential(e).select("event_id")
    out = out.unionByName(fl.within_summary_budget(e.withColumn("tokens", F.col("event_id") % 5), "tokens", 3).select("event_id"))
    out = out.unionByName(fl.having_frames(e, e.where("event_type = 'signup'"), "user_id").select("event_id"))
    refs = e.withColumn("refs", F.array(F.lit("a"), F.when(F.col("event_id") % 4 == 0, "").otherwise("b")))
    return out.unionByName(fl.without_empty_reference(refs, "refs").select("event_id"))


@query("""SELECT o_orderkey, c_name, n_name, 'lab' AS domain FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def join_three_required(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("k", F.col("o_custkey"))
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey"))
    n = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), "n_name")
    return jn.all_of([o, c, n], "k").select("o_orderkey", "c_name", "n_name", fl.domain_of(F.lit("bench")).alias("domain"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'val' ELSE 'test' END AS split FROM part""")
def join_existing_split(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    info = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "val").otherwise("train").alias("split"))
    return jn.val_or_test(p.select("p_partkey"), info, "p_partkey")


@query("""SELECT s_suppkey::VARCHAR AS file, s_suppkey::VARCHAR || ',x' AS members FROM supplier WHERE s_suppkey % 2 = 0""")
def join_file_groups(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file"))
    groups = f.where("file % 2 = 0").withColumn("members", F.array("file", F.lit("x")))
    return jn.concat_groups(f, groups).select("file", F.array_join("members", ",").alias("members"))


@query("""SELECT n_nationkey, r_name AS camera, n_name || '/' || r_name AS path FROM nation CROSS JOIN region WHERE n_regionkey = r_regionkey""")
def join_existing_options(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region")
    files = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit("/"), "r_name").alias("file"))
    return jn.with_existing(n, r.select(F.col("r_name").alias("camera")), files, F.concat("n_name", F.lit("/"), "camera")).select("n_nationkey", "camera", "path")


@query("""SELECT event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 7 = 0)""")
def event_missed(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ref", F.when(F.col("event_type") == "error", "said").otherwise(""))
    return jn.missed(e, e.where("event_type = 'signup' and event_id % 7 = 0"), ["user_id"]).select("event_id")


@query("""SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS a, l_linenumber AS b FROM lineitem""")
def zip_order_lines(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    g = g.select("l_orderkey", F.transform("x", lambda t: t["l_partkey"]).alias("a"), F.transform("x", lambda t: t["l_linenumber"]).alias("b"))
    return jn.zipped(g, "a", "b").select("l_orderkey", F.col("pos").cast("long").alias("pos"), "a", "b")


@query("""SELECT 'done' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'todo', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'members', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'common', count(DISTINCT c_custkey) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def set_rules(s: SparkSession, d: str) -> DataFrame:
    c, o = table(s, d, "customer").withColumn("k", F.col("c_custkey")), table(s, d, "orders").withColumn("k", F.col("o_custkey"))
    done, todo = st.done_and_todo(c, o, "k")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(done, "done").unionByName(count(todo, "todo")).unionByName(count(st.members(c, o, "k"), "members")).unionByName(count(st.common(c, o, "k"), "common"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_id % 3 = 0) AS none, count(*) FILTER (WHERE event_id % 3 = 1) AS one, count(*) FILTER (WHERE event_id % 3 = 2) AS two FROM events GROUP BY user_id""")
def event_label_counter(s: SparkSession, d: str) -> DataFrame:
    e, text = _cases(s, d, "nothing", "label 1", "label 2")
    got = ag.label_counter(e.withColumn("text", text), ["user_id"], "text")
    of = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(0))
    return got.select("user_id", of(0).cast("long").alias("none"), of(1).cast("long").alias("one"), of(2).cast("long").alias("two"))


@query("""SELECT round(avg(value), 4) AS lm_ppl, round(avg(abs(event_id % 11 - 5)) / 2, 4) AS time_diff, round(avg(value / 2), 4) AS fluency, round(avg((event_id % 2)::DOUBLE), 4) AS token_acc, round(avg((event_id % 10 = 0)::INTEGER), 4) AS overflow_ratio FROM events""")
def event_offline_means(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    e = table(s, d, "events").select(F.col("value").alias("lm_ppl"), (i % 11 - 5).alias("frame_diff"), (F.col("value") / 2).alias("fluency"), (i % 2).alias("token_acc"), (i % 10 == 0).alias("overflow"))
    out = ag.offline_means(e, 2.0)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 1)::INTEGER AS n_image, count(*) FILTER (WHERE l_linenumber = 2)::INTEGER AS n_eos, count(*) FILTER (WHERE l_linenumber > 2)::INTEGER AS n_text FROM lineitem GROUP BY l_orderkey""")
def order_token_counts(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("int")).alias("tokens"))
    return ag.token_counts(g, "tokens", 1, 2).select("l_orderkey", "n_image", "n_eos", "n_text")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_gen, count(*) FILTER (WHERE event_type = 'error') AS n_ref, arg_min(event_id, ts) AS first_len, arg_max(event_id, ts) AS last_len, max(event_id) AS max_len FROM events GROUP BY user_id""")
def event_stream_summary(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("gen", F.when(F.col("event_type") == "click", "a").otherwise("")).withColumn("ref", F.when(F.col("event_type") == "error", "b").otherwise(""))
    return ag.stream_summary(e, ["user_id"], "ts", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || event_id)) AS rn FROM events) WHERE rn <= 3""")
def event_sample_rows(s: SparkSession, d: str) -> DataFrame:
    return rk.sample_rows(table(s, d, "events"), ["user_id"], 3, F.col("event_id")).select("user_id", "event_id")


@query("""SELECT event_id, 'it''s ' || event_id AS a, 'x "y"' AS b, 2 AS n FROM events""")
def literal_lists(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('["it\'s '), F.col("event_id").cast("string"), F.lit('", \'x "y"\']'))
    out = table(s, d, "events").withColumn("text", text).withColumn("list", rd.literal_list("text"))
    return out.select("event_id", F.col("list")[0].alias("a"), F.col("list")[1].alias("b"), F.size("list").alias("n"))
