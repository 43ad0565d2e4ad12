"""Queries that go through files, states and streams: what is written is read back, and the rows are those of the SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.plans import annotations
from dialoom.plans.catalog import query
from dialoom.session import ensure_checkpoint_dir, table
from dialoom.sources import arrow_files, readers, sinks
from dialoom.streaming import infer


def _folder(s: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(s)}/files-{uuid.uuid4().hex}"


def event_frames(s: SparkSession, d: str) -> DataFrame:
    """Events as frames of their users' streams, each with its type as a user's text."""
    texts = F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("text")))
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("frame_idx"), F.col("ts").cast("timestamp").alias("time"), texts.alias("texts"), F.col("props").alias("ref"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, date_diff('microsecond', first_value(ts) OVER w, ts) >= 500000 * 1000000::BIGINT AS over, row_number() OVER w AS k, lag(event_type) OVER w AS before
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), c AS (SELECT *, coalesce(sum(over::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past, before IS NULL OR before <> event_type AS talks FROM e
), t AS (SELECT *, lag(CASE WHEN talks THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_talk FROM c WHERE past = 0)
SELECT user_id::VARCHAR AS stream, event_id AS frame_idx, CASE WHEN talks THEN event_type || ' ' || (k - coalesce(last_talk, 0) - 1) ELSE '' END AS gen, over AS last FROM t""")
def stream_inference(s: SparkSession, d: str) -> DataFrame:
    out = infer.infer(event_frames(infer.stateful(s), d), infer.silent_until_change, max_seconds=500_000)
    return out.select("stream", "frame_idx", "gen", "last")


@query("""SELECT user_id::VARCHAR AS video_uid, k AS frame_idx, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) WHERE k >= 2 AND k < 5""")
def arrow_frames_slice(s: SparkSession, d: str) -> DataFrame:
    """One Arrow file for each user's events, and of each file the frames [2, 5)."""
    path = _folder(s)
    sinks.named_files(table(s, d, "events"), path, F.concat(F.col("user_id").cast("string"), F.lit(".arrow")), ["event_id"], "arrow")
    return arrow_files.arrow_frames(s, path).where("frame_idx >= 2 and frame_idx < 5").select("video_uid", "frame_idx", "event_type")


@query("""SELECT 'u' || printf('%06d', (k // 7)::INT) AS file, user_id, k % 7 AS row_no, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)""")
def files_of_seven_rows(s: SparkSession, d: str) -> DataFrame:
    """Each user's events in Arrow files of seven rows."""
    path = _folder(s)
    sinks.grouped_files(table(s, d, "events").select("user_id", "event_id"), path, "user_id", ["event_id"], 7, prefix="u")
    return arrow_files.arrow_frames(s, path).select(F.col("video_uid").alias("file"), "user_id", F.col("frame_idx").alias("row_no"), "event_id")


@query("""SELECT conv_id || '.json' AS file, 'dialogue' AS kind, conv_id, turn, role FROM conversations""")
def json_file_per_conversation(s: SparkSession, d: str) -> DataFrame:
    """A JSON file for each conversation: metadata and its turns in order."""
    path = _folder(s)
    sinks.json_per_key(table(s, d, "conversations").select("conv_id", "turn", "role"), path, "conv_id", ["turn"], head={"kind": "dialogue"}, under="turns")
    turn = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType())])
    whole = T.StructType([T.StructField("kind", T.StringType()), T.StructField("turns", T.ArrayType(turn))])
    read = s.read.schema(whole).option("multiLine", True).option("pathGlobFilter", "[0-9]*.json").json(path)
    return read.select(F.col("_metadata.file_name").alias("file"), "kind", F.explode("turns").alias("t")).select("file", "kind", "t.*")


def _text_files(s: SparkSession, df: DataFrame) -> str:
    """A folder of text files of the column ``value``."""
    path = _folder(s)
    df.select("value").write.text(path)
    return path


@query("""SELECT event_id, event_type FROM events""")
def jsonl_lines(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.json_lines(table(s, d, "events").select("event_id", "event_type"), path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    return readers.jsonl(s, path, schema).select("event_id", "event_type")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'train' ELSE 'val' END AS split FROM events""")
def json_by_split(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.json_by_split(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "train").otherwise("val").alias("split")), path)
    return s.read.schema("event_id long, split string").json(path)


@query("""SELECT p_partkey AS id, p_name AS name FROM part""")
def json_documents(s: SparkSession, d: str) -> DataFrame:
    """Lists of records under a name, one JSON document for each brand."""
    path = _folder(s)
    sinks.json_per_key(table(s, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), path, "p_brand", ["id"], head={"of": 1}, under="items")
    fields = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return readers.json_array(s, f"{path}/Brand*.json", fields, root="items")


@query("""SELECT s_suppkey AS file_id, s_name FROM supplier""")
def json_numbered_files(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.json_per_key(table(s, d, "supplier").select("s_suppkey", "s_name"), path, "s_suppkey", ["s_name"])
    found = readers.json_directory(s, f"{path}/[0-9]*.json", T.StructType([T.StructField("s_name", T.StringType())]))
    return found.select("file_id", "s_name")


@query("""SELECT p_partkey, p_name, p_retailprice FROM part""")
def csv_with_header(s: SparkSession, d: str) -> DataFrame:
    path, p = _folder(s), table(s, d, "part").select("p_partkey", "p_name", "p_retailprice")
    p.write.option("header", True).csv(path)
    return readers.csv(s, path, p.schema)


@query("""SELECT p_partkey, p_name FROM part""")
def csv_without_header(s: SparkSession, d: str) -> DataFrame:
    path, p = _folder(s), table(s, d, "part").select("p_partkey", "p_name")
    p.write.option("sep", "\t").csv(path)
    return readers.headerless(s, path, p.schema)


@query("""SELECT trim(p_name) AS value FROM part WHERE p_partkey % 3 > 0""")
def text_lines(s: SparkSession, d: str) -> DataFrame:
    return readers.lines(s, _text_files(s, table(s, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("value"))))


@query("""SELECT event_id / 1e7 AS start, (event_id + 15) / 1e7 AS "end", event_type AS text FROM events""")
def tick_lines(s: SparkSession, d: str) -> DataFrame:
    value = F.concat_ws("\t", F.col("event_id").cast("string"), (F.col("event_id") + 15).cast("string"), "event_type")
    return readers.tick_lines(s, _text_files(s, table(s, d, "events").select(value.alias("value"))))


@query("""SELECT s_suppkey || '.jsonl' AS file, s_nationkey / 1e7 AS duration FROM supplier""")
def tick_pair_files(s: SparkSession, d: str) -> DataFrame:
    """A file for each supplier that holds two ticks."""
    path = _folder(s)
    ticks = table(s, d, "supplier").select("s_suppkey", F.explode(F.array(F.lit(7), F.col("s_nationkey") + 7)).alias("tick"))
    rows = ticks.select("s_suppkey", "tick", F.col("tick").cast("string").alias("line"))
    sinks.named_files(rows, path, F.concat(F.col("s_suppkey").cast("string"), F.lit(".jsonl")), ["tick"], "jsonl", value="line")
    return readers.timing_pair(s, f"{path}/*.jsonl")


@query("""SELECT avg(value) AS mean_value, count(*) AS n FROM events""")
def metrics_file(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.metrics(table(s, d, "events").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n")), path)
    return s.read.schema("mean_value double, n long").json(path)


@query("""SELECT user_id, event_id FROM events WHERE event_id >= 10 AND event_id < 90""")
def columnar_slice(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.columnar(table(s, d, "events").select("user_id", F.col("event_id").alias("frame_idx"), "event_type"), path, ["event_type"])
    return readers.frames(s, path, 10, 90).select("user_id", F.col("frame_idx").alias("event_id"))


# --- annotation parsers

_RAW = """e AS (SELECT user_id, event_id, event_type, coalesce(value, 0) AS v, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000000.0 AS s FROM events)"""


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Events as (video_uid, seq, type, start, end), hours from the user's first event taken as seconds."""
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    e = table(s, d, "events").withColumn("us", micros)
    first = e.groupBy("user_id").agg(F.min("us").alias("first"))
    start = (F.col("us") - F.col("first")) / 3600000000.0
    return e.join(first, "user_id").select(F.col("user_id").cast("string").alias("video_uid"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), start.alias("start"), (start + F.coalesce("value", F.lit(0.0)) / 10).alias("end"))


def _parsed(videos: DataFrame) -> DataFrame:
    bounds = F.array_join(F.transform("clips", lambda c: F.format_string("%d-%d", F.floor(c["start"] * 8), F.floor(c["end"] * 8))), ",")
    return videos.select("video_uid", F.col("num_steps").cast("long").alias("num_steps"), F.col("num_substeps").cast("long").alias("num_substeps"), "description", F.round("ann_ratio", 6).alias("ann_ratio"), bounds.alias("clips"))


@query(f"""WITH {_RAW}, l AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'assistant' WHEN 'error' THEN 'user' ELSE '' END AS role, s, s + v / 10 AS en, CASE WHEN event_type = 'signup' THEN 'Start' ELSE event_type || event_id END AS t FROM e
), m AS (SELECT user_id, event_id, role, CASE WHEN role = '' THEN s ELSE (s + en) / 2 END AS st, en, CASE WHEN role = '' THEN t ELSE role || ': "' || t || '"' END AS t FROM l
), b AS (SELECT user_id, coalesce(arg_min(en, struct_pack(a := st, b := event_id)) FILTER (WHERE t = 'Start'), 0) AS begin, max(en) AS duration FROM m GROUP BY user_id
), k AS (SELECT m.*, role = '' AS step, sum((role = '')::INT) OVER (PARTITION BY m.user_id ORDER BY st, event_id) AS no FROM m JOIN b ON m.user_id = b.user_id WHERE st >= begin
), g AS (SELECT user_id, no, max(st) FILTER (WHERE step) AS st, max(en) FILTER (WHERE step) AS own, greatest(max(en) FILTER (WHERE step), max(st)) AS en, max(t) FILTER (WHERE step) AS t, string_agg(printf('- [%.1fs] %s', st, t) || chr(10), '' ORDER BY st, event_id) FILTER (WHERE NOT step) AS subs, count(*) FILTER (WHERE NOT step) AS n FROM k WHERE no > 0 GROUP BY user_id, no
), x AS (SELECT user_id, no, st, en, own, n, printf('[%.1fs-%.1fs] %s', st, en, t) || chr(10) || coalesce(subs, '') AS lines FROM g UNION ALL SELECT user_id, 0, begin / 2, begin, NULL, 0, printf('- [%.1fs] start', begin / 2) || chr(10) FROM b
), c AS (SELECT user_id, (no // 7)::INT AS c, arg_min(st, no) AS a, arg_max(en, no) AS z FROM x GROUP BY ALL
), cs AS (SELECT user_id, string_agg(floor(a * 8)::BIGINT || '-' || floor(z * 8)::BIGINT, ',' ORDER BY c) AS clips FROM c GROUP BY user_id)
SELECT x.user_id::VARCHAR AS video_uid, count(*) AS num_steps, sum(n)::BIGINT AS num_substeps, string_agg(lines, '' ORDER BY no) AS description, round(coalesce(sum(own - st), 0) / nullif(max(duration), 0), 6) AS ann_ratio, max(clips) AS clips
FROM x JOIN b ON x.user_id = b.user_id JOIN cs ON cs.user_id = x.user_id GROUP BY x.user_id""")
def parsed_timed_lines(s: SparkSession, d: str) -> DataFrame:
    """Events as a recording's tick lines: views, purchases and starts are steps, clicks and errors what is said."""
    r = _raw(s, d)
    role = F.when(F.col("type") == "click", "assistant").when(F.col("type") == "error", "user").otherwise("")
    lines = r.select("video_uid", "seq", role.alias("role"), "start", "end", F.when(F.col("type") == "signup", "Start").otherwise(F.concat("type", F.col("seq").cast("string"))).alias("text"))
    return _parsed(annotations.PARSERS["wtag"](lines, lines.groupBy("video_uid").agg(F.max("end").alias("duration"))))


@query(f"""WITH {_RAW}, a AS (SELECT user_id, event_id, s AS st, s + v / 10 AS en, event_type || event_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM e WHERE event_type IN ('view', 'purchase')
), f AS (SELECT user_id, event_id, s AS st, s + v / 10 AS en, CASE WHEN event_id % 3 = 0 THEN 'take' ELSE 'take ' || event_type END AS t FROM e WHERE event_type IN ('click', 'error') AND event_id % 5 > 0
), g AS (SELECT a.user_id, a.i, a.st, a.en, printf('[%.1fs-%.1fs] %s', a.st, a.en, a.t) || chr(10) || coalesce(string_agg(printf(' - [%.1fs] %s', f.st, f.t) || chr(10), '' ORDER BY f.event_id), '') AS lines, count(f.st) AS n
  FROM a LEFT JOIN f ON f.user_id = a.user_id AND ((f.st >= a.st AND f.st < a.en) OR (f.en > a.st AND f.en <= a.en) OR (f.st < a.st AND f.en > a.en)) GROUP BY a.user_id, a.i, a.st, a.en, a.t
), c AS (SELECT user_id, (i // 21)::INT AS c, arg_min(st, i) AS a, arg_max(en, i) AS z FROM g GROUP BY ALL
), cs AS (SELECT user_id, string_agg(floor(a * 8)::BIGINT || '-' || floor(z * 8)::BIGINT, ',' ORDER BY c) AS clips FROM c GROUP BY user_id)
SELECT g.user_id::VARCHAR AS video_uid, count(*) AS num_steps, sum(n)::BIGINT AS num_substeps, string_agg(lines, '' ORDER BY i) AS description, round(CASE WHEN arg_max(en, i) > 0 THEN sum(en - st) / arg_max(en, i) ELSE 0 END, 6) AS ann_ratio, max(clips) AS clips FROM g JOIN cs ON cs.user_id = g.user_id GROUP BY g.user_id""")
def parsed_activities(s: SparkSession, d: str) -> DataFrame:
    """Events as activities, and the fine actions that overlap them."""
    r = _raw(s, d)
    coarse = r.where("type in ('view', 'purchase')").select("video_uid", "seq", "start", "end", F.concat("type", F.col("seq").cast("string")).alias("text"))
    noun = F.when(F.col("seq") % 3 == 0, "").otherwise(F.upper("type"))
    fine = r.where("type in ('click', 'error')").select("video_uid", "seq", "start", "end", F.lit("Take").alias("verb"), noun.alias("noun"), F.when(F.col("seq") % 5 == 0, 1).alias("confusion"))
    return _parsed(annotations.PARSERS["epfl"](coarse, fine))


@query(f"""WITH {_RAW}, m AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN s + v / 20 ELSE s END AS st, s + v / 10 AS en, CASE event_type WHEN 'view' THEN 'step' WHEN 'click' THEN 'said' WHEN 'error' THEN 'action' WHEN 'purchase' THEN 'action' ELSE 'long' END AS kind,
  event_type AS ty, event_id % 7 AS h FROM e
), k AS (SELECT *, sum((kind = 'step')::INT) OVER (PARTITION BY user_id ORDER BY st, event_id) AS no FROM m WHERE kind = 'step' OR (kind = 'said' AND h > 0) OR (kind = 'action' AND h <> 3)
), q AS (SELECT *, row_number() OVER (PARTITION BY user_id, no, CASE WHEN kind = 'action' THEN ty || h % 2 ELSE kind || event_id END ORDER BY st, event_id) AS dup FROM k WHERE no > 0
), g AS (SELECT user_id, no, max(st) FILTER (WHERE kind = 'step') AS st, max(en) FILTER (WHERE kind = 'step') AS en, max(event_id) FILTER (WHERE kind = 'step') AS id,
  string_agg(CASE WHEN kind = 'said' THEN printf(' - [%.1fs] %s: "say %d"', st, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END, event_id) ELSE printf(' - [%.1fs-%.1fs] grab %s%s%s', st, en, CASE WHEN h % 2 = 0 THEN 'red ' ELSE '' END, ty, CASE WHEN event_id % 4 = 0 THEN ' (ERROR: none)' ELSE '' END) END || chr(10), '' ORDER BY st, event_id) FILTER (WHERE kind <> 'step' AND dup = 1) AS subs,
  count(*) FILTER (WHERE kind <> 'step' AND dup = 1) AS n, no = max(no) OVER (PARTITION BY user_id) AS last FROM q GROUP BY user_id, no
), z AS (SELECT user_id, 'long ' || arg_max(event_id, struct_pack(a := st, b := event_id)) FILTER (WHERE kind = 'long') AS summary, max(en) AS duration, sum(en - st) FILTER (WHERE kind = 'step') AS ann FROM m GROUP BY user_id)
SELECT g.user_id::VARCHAR AS video_uid, count(*) AS num_steps, sum(CASE WHEN last THEN 0 ELSE n END)::BIGINT AS num_substeps, string_agg(printf('[%.1fs-%.1fs] do %d', st, en, id) || chr(10) || CASE WHEN last THEN '' ELSE coalesce(subs, '') END, '' ORDER BY no) || 'Summary: ' || coalesce(max(summary), '') || chr(10) AS description,
  round(max(ann) / nullif(max(duration), 0), 6) AS ann_ratio FROM g JOIN z ON g.user_id = z.user_id GROUP BY g.user_id""")
def parsed_attributed(s: SparkSession, d: str) -> DataFrame:
    """Events as steps, speech and fine actions told by attributes."""
    r, i = _raw(s, d), F.col("seq")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    said = F.create_map(F.lit("Conversation Purpose"), F.when(i % 2 == 0, "student-asks").otherwise("instructor-tells"), F.lit("Transcription"), F.when(i % 7 > 0, text(" say ", i, "\n")).otherwise(" "))
    action = F.create_map(
        F.lit("Action Correctness"), F.when(i % 4 == 0, "Wrong").otherwise("Correct Action"), F.lit("Verb"), F.when(i % 7 == 3, "hold").otherwise("grab"), F.lit("Noun"), F.col("type"), F.lit("Adjective"), F.when(i % 7 % 2 == 0, "red").otherwise("none")
    )
    step, long = F.create_map(F.lit("Action sentence"), text("do_", i)), F.create_map(F.lit("Long form description"), text("long ", i))
    attributes = F.when(F.col("type") == "view", step).when(F.col("type") == "click", said).when(F.col("type").isin("error", "purchase"), action).otherwise(long)
    events = r.select("video_uid", "seq", "start", "end", attributes.alias("attributes"))
    return _parsed(annotations.PARSERS["holoassist"](events, r.groupBy("video_uid").agg(F.max("end").alias("duration")))).drop("clips")
