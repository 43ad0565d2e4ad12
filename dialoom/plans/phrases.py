"""Queries that apply the text rules to the driver's texts; the SQL computes each rule anew from the same texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as tx
from dialoom.functions import timing as tm
from dialoom.functions.chat import chat_format
from dialoom.operators import packing
from dialoom.operators import sets as st
from dialoom.operators import windows as wn
from dialoom.plans.catalog import query
from dialoom.session import table


def _cat(*parts: Column | str | int) -> Column:
    """Parts joined; texts are literal, other values columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(number: Column, *values: Column | str) -> Column:
    """The value of a number modulo so many."""
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (number % len(values) + 1).cast("int"))


@query("""WITH x AS (SELECT conv_id, turn, (['Initiative ', 'it is RESPONSIVE ', 'responsive initiative '])[turn % 3 + 1] || role AS who, role || (['Feedback, Instruction', ' INFO sharing', 'none', 'Correction of info'])[(conv_id + turn) % 4 + 1] AS what FROM conversations
), y AS (SELECT *, CASE WHEN contains(lower(who), 'initiative') THEN 'initiative' ELSE 'responsive' END AS w,
  concat_ws(',', CASE WHEN contains(lower(what), 'instruction') THEN 'instruction' END, CASE WHEN contains(lower(what), 'correction') THEN 'correction' END, CASE WHEN contains(lower(what), 'info') THEN 'info_sharing' END, CASE WHEN contains(lower(what), 'feedback') THEN 'feedback' END) AS t FROM x
), z AS (SELECT conv_id, turn, w, CASE WHEN t = '' THEN 'other' ELSE t END AS t FROM y)
SELECT conv_id, turn, w AS who, t AS what, CASE turn % 4 WHEN 0 THEN w || '|' || t WHEN 1 THEN w || '|' || t ELSE 'initiative|other' END AS label FROM z""")
def label_rules(s: SparkSession, d: str) -> DataFrame:
    """Labels made of the turns' roles and marks."""
    c, turn = table(s, d, "conversations"), F.col("turn")
    who = _cat(_pick(turn, "Initiative ", "it is RESPONSIVE ", "responsive initiative "), F.col("role"))
    what = _cat(F.col("role"), _pick(F.col("conv_id") + turn, "Feedback, Instruction", " INFO sharing", "none", "Correction of info"))
    mark = _cat("[", who, "|", what, "]")
    whole = _pick(turn, _cat("a ", mark, " b"), _cat(mark, "[x|y]"), F.col("role"), "a [x|y] b")
    return c.select("conv_id", "turn", tx.initiativity(who).alias("who"), tx.intention(what).alias("what"), tx.turn_label(whole).alias("label"))


@query(r"""WITH x AS (SELECT p_partkey, p_name, p_type, ([ 'The {"a": ' || p_size || '.5, "b": 2} end', 'x {"a": 1} --- so {"a": ' || p_size || ', "b": ' || p_partkey || '} {"a": 9}', 'x --- {' || chr(10) || '"a": 3}', '--- {"a": x} --- {"a": 4}'])[p_partkey % 4 + 1] AS judged FROM part
), y AS (SELECT *, regexp_extract(CASE WHEN contains(judged, '---') THEN split_part(judged, '---', 2) ELSE judged END, '\{[^\n]*?\}') AS body FROM x)
SELECT p_partkey, (p_partkey % 90)::INTEGER AS answer, 'step ' || p_name AS summary, 'The time elapsed since the start of the task is ' || printf('%.1f', p_partkey / 20.0) || ' seconds. step ' || p_name AS note,
  CASE WHEN json_valid(body) THEN (body->>'$.a')::DOUBLE END AS a, CASE WHEN json_valid(body) THEN (body->>'$.b')::DOUBLE END AS b, p_type AS goal,
  CASE WHEN contains(lower(p_type), 'tin') THEN 'can' WHEN contains(lower(p_type), 'steel') THEN 'knife' ELSE 'plain' END AS recipe FROM y""")
def answer_rules(s: SparkSession, d: str) -> DataFrame:
    p, key, name, kind = table(s, d, "part"), F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    judged = _pick(key, _cat('The {"a": ', F.col("p_size"), '.5, "b": 2} end'), _cat('x {"a": 1} --- so {"a": ', F.col("p_size"), ', "b": ', key, '} {"a": 9}'), 'x --- {\n"a": 3}', '--- {"a": x} --- {"a": 4}')
    scores, summary = tx.judge_scores(judged, ("a", "b")), _cat("SUMMARY: none\nmore\n** SUMMARY: step ", name, " : end")
    return p.select(
        "p_partkey",
        tx.answer_int(_cat("First 7.\nANSWER: about ", key % 90, " of 99")).alias("answer"),
        tx.summary_line(summary).alias("summary"),
        tx.progress_note(key / 20, summary).alias("note"),
        scores["a"].alias("a"),
        scores["b"].alias("b"),
        tx.goal_line(_cat("**", kind, "** \nmore")).alias("goal"),
        tx.by_keyword(kind, (("tin", "can"), ("steel", "knife")), "plain").alias("recipe"),
    )


@query("""WITH x AS (SELECT p_partkey, p_name AS n, p_type AS t, p_brand AS b, (['attach', 'detach', 'screw'])[p_partkey % 3 + 1] AS verb,
  (['', p_name || ',', p_name || ':', p_name])[p_partkey % 4 + 1] AS pre, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END AS suf,
  CASE WHEN p_partkey % 5 > 0 THEN 'C ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '.' ELSE '' END END AS first, (['and takes ' || p_type, NULL, NULL, 'and a'])[p_partkey % 4 + 1] AS second,
  floor(p_retailprice * 10::DOUBLE ** (p_partkey % 13))::BIGINT * (1 - p_partkey % 2 * 2) AS size FROM part
), y AS (SELECT *, verb || ' ' || n || CASE WHEN verb = 'attach' THEN ' to ' ELSE ' from ' END || t AS done, concat_ws(' ', first, second) AS told FROM x)
SELECT p_partkey, CASE WHEN abs(size) < 1e3 THEN size::VARCHAR WHEN abs(size) < 1e6 THEN printf('%.1fK', size / 1e3) WHEN abs(size / 1e3) < 1e6 THEN printf('%.1fM', size / 1e3 / 1e3) WHEN abs(size / 1e3 / 1e3) < 1e6 THEN printf('%.1fG', size / 1e3 / 1e3 / 1e3)
    WHEN abs(size / 1e3 / 1e3 / 1e3) < 1e6 THEN printf('%.1fT', size / 1e3 / 1e3 / 1e3 / 1e3) ELSE printf('%.1fP', size / 1e3 / 1e3 / 1e3 / 1e3 / 1e3) END AS size,
  n || ([ '-val', '_test_val', '_test', ''])[p_partkey % 4 + 1] AS short, CASE WHEN told <> '' AND NOT ends_with(told, '.') THEN told || '.' ELSE told END AS narration,
  CASE WHEN pre = '' THEN upper(suf[1]) || suf[2:] WHEN suf = '' THEN pre WHEN pre[-1] IN (',', ':') THEN pre || ' ' || lower(suf[1]) || suf[2:] ELSE pre || ' ' || upper(suf[1]) || suf[2:] END AS joined,
  done, CASE WHEN verb = 'attach' THEN replace(replace(done, 'attach', 'detach'), 'to', 'from') ELSE replace(replace(done, 'detach', 'attach'), 'from', 'to') END AS undone,
  upper(t[1]) || lower(t[2:]) AS capital, replace(n, '_', ' ') || ' users ' || t || ' user unintelligible' AS clean, b || '_' || p_partkey || '__' || t AS clip FROM y""")
def phrase_rules(s: SparkSession, d: str) -> DataFrame:
    p, key, name, kind = table(s, d, "part"), F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    first = F.when(key % 5 == 0, _cat("#C C #UNSURE ", name)).otherwise(_cat("#C C ", name, F.when(key % 3 == 0, ".").otherwise("")))
    second = _pick(key, _cat("#C C takes ", kind), _cat("#C C ", kind, " #Unsure"), "#O X", "#C C a #C C b")
    done, undone = tx.mistake_text(_pick(key, "attach", "detach", "screw"), name, kind)
    before = _pick(key, "", _cat(name, ","), _cat(name, ":"), name)
    after = F.when(key % 5 == 0, "").when(key % 2 == 0, F.lower(kind)).otherwise(kind)
    return p.select(
        "p_partkey",
        tx.size_text(F.floor(F.col("p_retailprice") * F.pow(F.lit(10.0), key % 13)) * (1 - key % 2 * 2)).alias("size"),
        tx.short_name(_cat(name, _pick(key, "-val-L1", "_test_val_x", "_test.1", ""))).alias("short"),
        tx.narration(F.array(first, second, F.lit("#C C third"))).alias("narration"),
        tx.connected(before, after).alias("joined"),
        done.alias("done"),
        undone.alias("undone"),
        tx.capitalised(kind).alias("capital"),
        tx.normalised(_cat("\t ", name, "_students_", kind, "_student *unintelligible*unintelligible\n")).alias("clean"),
        tx.named_clip(F.col("p_brand"), key.cast("string"), view=kind).alias("clip"),
    )


@query("""SELECT event_id, printf('[%.1fs-%.1fs] %s', event_id / 8.0, value * 7 / 20, event_type) AS step, printf(' - [%.1fs] %s', (event_id * 5 + 5) / 100.0, event_type) AS substep FROM events WHERE value IS NOT NULL""")
def step_lines(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("value is not null")
    return e.select("event_id", tx.step_line(F.col("event_id") / 8, F.col("value") * 7 / 20, F.col("event_type")).alias("step"), tx.substep_line((F.col("event_id") * 5 + 5) / F.lit(100.0), F.col("event_type")).alias("substep"))


@query("""SELECT p_brand, string_agg('Task ' || p_partkey || ': ' || p_name || ' (domain: ' || p_type || ')' || chr(10) || '1. ' || p_name || chr(10) || '2. size ' || p_size || chr(10) || chr(10), '' ORDER BY p_partkey) AS tasks FROM part GROUP BY p_brand""")
def brand_catalogues(s: SparkSession, d: str) -> DataFrame:
    task = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("domain"), F.array("p_name", _cat("size ", F.col("p_size"))).alias("steps"))
    return table(s, d, "part").groupBy("p_brand").agg(tx.task_catalogue(F.sort_array(F.collect_list(task))).alias("tasks"))


@query("""WITH x AS (SELECT event_id, user_id, event_id * 37 % 101 / 100.0 AS p, lag(event_id * 37 % 101 / 100.0) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT event_id, coalesce(b - p > 0.1, false) OR p <= 0.5 AS talk FROM x""")
def event_talk_gate(s: SparkSession, d: str) -> DataFrame:
    """Who talks by the fall of a silence probability, or where it is low."""
    e = table(s, d, "events").withColumn("p", F.col("event_id") * 37 % 101 / F.lit(100.0))
    return wn.talk_drop(e, ["user_id"], ["event_id"], "p", 0.1).select("event_id", "talk")


@query("""SELECT p_partkey, p_brand || ',' || p_brand || ',' || replace(p_type, ' ', '_') AS users, lower(replace(p_type, ' ', '_')) || '|stream|' || (p_size * CASE WHEN p_partkey % 2 = 0 THEN 1024 ELSE 1 END) || '|' || CASE WHEN p_partkey % 3 = 0 THEN '0.25' ELSE 'NULL' END || '|drop' AS setup,
  'root/' || p_brand || '/prepared/' || replace(p_type, ' ', '_') || '.jsonl' AS path FROM part""")
def setup_rules(s: SparkSession, d: str) -> DataFrame:
    p, key, kind = table(s, d, "part"), F.col("p_partkey"), F.replace("p_type", F.lit(" "), F.lit("_"))
    setup = _cat(F.lower(kind), "|stream|", F.col("p_size"), _pick(key, "k", ""), "|", _pick(key, "0.25", "x", "y"), "|drop")
    one = tx.eval_setups(setup)[0]
    shown = F.concat_ws("|", one["dataset"], one["runner"], one["max_len"].cast("string"), F.coalesce(one["threshold"].cast("string"), F.lit("NULL")), one["context"])
    return p.select("p_partkey", F.array_join(tx.user_types(_cat(F.col("p_brand"), "@2,", kind)), ",").alias("users"), shown.alias("setup"), tx.dataset_path(_cat(F.col("p_brand"), "/", kind), "root/").alias("path"))


@query("""WITH x AS (SELECT conv_id, turn, role, ' <|begin_of_text|>' || (['<image><image>;<image>', '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)])[turn % 2 + 1] || (['.', left(replace(text, chr(10), ' '), 25)])[conv_id % 2 + 1] || '<|eot_id|>more' AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND conv_id % 2 = 0 THEN '' ELSE split_part(replace(replace(replace(trim(split_part(t, '<|eot_id|>', 1)), '<image>', ''), ';', ''), '<|begin_of_text|>', ''), '<|end_header_id|>' || chr(10) || chr(10), 1 + (turn % 2)::INT) END AS clean,
  CASE WHEN turn % 2 = 1 THEN role END AS said_by FROM x""")
def chat_rules(s: SparkSession, d: str) -> DataFrame:
    """Generated texts with marks, headers and images, cleaned."""
    c, turn = table(s, d, "conversations"), F.col("turn")
    made = _cat(" <|begin_of_text|>", _pick(turn, "<image><image>;<image>", _cat("<|start_header_id|>", F.col("role"), "<|end_header_id|>\n\n")), _pick(F.col("conv_id"), ".", F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(25))), "<|eot_id|>more")
    t = tx.cleaned_turn(made, separator=";")
    return c.select("conv_id", "turn", t["text"].alias("clean"), t["role"].alias("said_by"))


@query("""WITH x AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := left(text, 10)) ORDER BY turn) AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(list_reduce(list_concat([''], list_transform(list_filter(c, lambda t: t.role = 'user'), lambda t: t.text)), lambda a, b: CASE WHEN a = '' THEN b ELSE a || chr(10) || chr(10) || b END), '') AS system, coalesce(trim(split_part(c[1].text, 'e', 1)), '') AS instruction FROM x""")
def combined_texts(s: SparkSession, d: str) -> DataFrame:
    """User texts as system turns, joined; the text before a mark of elapsed time or knowledge."""
    turn = F.struct("turn", F.when(F.col("role") == "user", "system").otherwise(F.col("role")).alias("role"), F.left("text", F.lit(10)).alias("content"))
    c = table(s, d, "conversations").withColumn("role", F.when(F.col("role") == "system", "old").otherwise(F.col("role"))).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("c"))
    first = F.replace(F.col("c")[0]["content"], F.lit("e"), _pick(F.col("conv_id"), "The time elapsed since x", "Task knowledge: y"))
    return c.select("conv_id", tx.combined_system(F.col("c")).alias("system"), tx.instruction_of(first).alias("instruction"))


def _told(s: SparkSession, d: str) -> DataFrame:
    """Conversations as turns of a system, frames and texts: every turn is preceded by its frames, the fourth asks for a summary."""
    shown = F.struct(F.lit("frames").alias("role"), F.lit("").alias("content"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + F.length("text") % 7 + 1).alias("end"))
    role = F.when(F.col("turn").isin(0, 2, 4), "system").otherwise(F.col("role"))
    text = F.when(F.col("turn") == 4, "Please summarize it").when((F.col("turn") == 2) & (F.col("conv_id") % 3 > 0), "Task knowledge: old").when((F.col("turn") == 0) & (F.col("conv_id") % 4 == 0), "Task knowledge: here").otherwise(F.left("text", F.lit(5)))
    said = F.struct(role.alias("role"), text.alias("content"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    both = table(s, d, "conversations").select("conv_id", "turn", F.array(shown, said).alias("t"))
    return both.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"])).alias("turns"))


@query("""WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations)
SELECT conv_id, 2 * (least(top, 4) + 1) AS n, max(CASE WHEN turn = least(top, 4) AND top >= 4 THEN turn * 10 + length(text) % 7 + 1 WHEN top < 4 THEN -1 END) AS "end" FROM m GROUP BY conv_id, top""")
def turns_until_summary(s: SparkSession, d: str) -> DataFrame:
    out = _told(s, d).withColumn("u", packing.until_summary(F.col("turns"), F.lit(-1).cast("long")))
    return out.select("conv_id", F.size("u.turns").cast("long").alias("n"), "u.end")


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn IN (0, 2, 4) THEN 'system' ELSE role END AS r, CASE WHEN turn = 4 THEN 'Please summarize it' WHEN turn = 2 AND conv_id % 3 > 0 THEN 'Task knowledge: old' WHEN turn = 0 AND conv_id % 4 = 0 THEN 'Task knowledge: here' ELSE left(text, 5) END AS t FROM conversations
), y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, r ORDER BY turn) AS k FROM x)
SELECT conv_id, turn, r AS role, CASE WHEN r = 'system' AND k = 1 AND NOT contains(t, 'Task knowledge: ') THEN t || ' Task knowledge: know ' || conv_id ELSE t END AS content FROM y WHERE NOT (r = 'system' AND k = 2 AND contains(t, 'Task knowledge: '))""")
def knowledge_placed(s: SparkSession, d: str) -> DataFrame:
    numbered = _told(s, d).select("conv_id", F.transform("turns", lambda t, i: t.withField("start", F.floor(i / 2))).alias("turns"))
    placed = numbered.select("conv_id", F.explode(packing.knowledge_in_first(F.col("turns"), _cat("know ", F.col("conv_id")))).alias("t"))
    return placed.where("t.role <> 'frames'").select("conv_id", F.col("t.start").alias("turn"), "t.role", "t.content")


_SHOWN = """t AS (SELECT conv_id, 2 * turn AS i, 'frames' AS role, repeat('<i><i>;', (1 + turn % 3)::INT)[:-2] AS text, 1 + turn % 3 AS n FROM conversations
  UNION ALL SELECT conv_id, 2 * turn + 1, role, {said}, 0 FROM conversations)"""


def _shown(s: SparkSession, d: str) -> DataFrame:
    """Conversations with one to three frames before each turn."""
    frames = F.struct(F.lit("frames").alias("role"), F.lit("").alias("content"), F.lit(0).alias("start"), (1 + F.col("turn") % 3).cast("int").alias("end"))
    said = F.struct("role", F.concat(F.lit(" "), F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(9)), F.lit(" \n")).alias("content"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    both = table(s, d, "conversations").select("conv_id", F.struct("turn", F.array(frames, said).alias("t")).alias("x"))
    return both.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"])).alias("turns"))


@query(f"""WITH {_SHOWN.format(said="'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(left(replace(text, chr(10), ' '), 9)) || '<|eot_id|>'")}
SELECT conv_id, 'headers' AS kind, '<|begin_of_text|>' || string_agg(text, '' ORDER BY i) AS chat FROM t GROUP BY conv_id
UNION ALL SELECT conv_id, 'plain', string_agg(text, '' ORDER BY i) FROM (SELECT conv_id, i, CASE WHEN n > 0 THEN text ELSE upper(role[1]) || role[2:] || ': ' || trim(replace(split_part(text, '<|end_header_id|>' || chr(10) || chr(10), 2), '<|eot_id|>', '')) || chr(10) END AS text FROM t) GROUP BY conv_id""")
def chat_formats(s: SparkSession, d: str) -> DataFrame:
    """Conversations in each registered chat format."""
    shown = _shown(s, d)
    out = None
    for kind in ("headers", "plain"):
        text = chat_format(kind, image="<i>", per_image=2, separator=";").text(F.col("turns"))
        one = shown.select("conv_id", F.lit(kind).alias("kind"), text.alias("chat"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_SHOWN.format(said="'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(left(replace(text, chr(10), ' '), 9)) || '<|eot_id|>'")}
, p AS (SELECT *, 17 + coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t)
SELECT conv_id, b::BIGINT AS start, (b + length(text))::BIGINT AS "end" FROM p WHERE role = 'assistant' UNION ALL SELECT conv_id, (b + k * 7 - 1)::BIGINT, (b + k * 7)::BIGINT FROM p, range(1, 3) r(k) WHERE role = 'frames' AND k < n""")
def chat_learn_ranges(s: SparkSession, d: str) -> DataFrame:
    """What is learned of a conversation's text: its answers, and the separators between frames."""
    ranges = chat_format("headers", image="<i>", per_image=2, separator=";").learn_ranges(F.col("turns"))
    out = _shown(s, d).select("conv_id", F.explode(ranges).alias("r"))
    return out.select("conv_id", F.col("r")[0].cast("long").alias("start"), F.col("r")[1].cast("long").alias("end"))


@query("""WITH w AS (SELECT conv_id * 100 + turn AS id, string_split_regex(trim(text), '\\s+') AS w FROM conversations
), t AS (SELECT id, unnest(range(len(w))) AS i, length(unnest(w)) % 9 AS x FROM w
), e AS (SELECT id, i AS e, lag(i, 1, -1) OVER (PARTITION BY id ORDER BY i) AS before FROM t WHERE x = 4
), o AS (SELECT a.id, a.i FROM t a JOIN t b ON a.id = b.id AND b.i = a.i + 1 WHERE a.x = 2 AND b.x = 3
), f AS (SELECT id, i AS e, lag(i, 1, -1) OVER (PARTITION BY id ORDER BY i) AS before FROM t WHERE x = 6)
SELECT e.id, (min(o.i) + 2)::INTEGER AS start, (e.e + 1)::INTEGER AS "end", 'assistant' AS kind FROM e JOIN o ON o.id = e.id AND o.i > e.before AND o.i < e.e GROUP BY e.id, e.e
UNION ALL SELECT f.id, f.e::INTEGER, (f.e + 1)::INTEGER, CASE WHEN max(n.x) = 4 THEN 'talk' ELSE 'w2t' END FROM f JOIN t g ON g.id = f.id AND g.x = 5 AND g.i > f.before AND g.i <= f.e LEFT JOIN t n ON n.id = f.id AND n.i = f.e + 1 GROUP BY f.id, f.e""")
def token_learn_ranges(s: SparkSession, d: str) -> DataFrame:
    """Answers and frame decisions in arrays of tokens, here the lengths of a turn's words modulo 9."""
    ids = F.transform(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+"), lambda w: (F.length(w) % 9).cast("int"))
    c = table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), ids.alias("ids"))
    return c.select("id", F.explode(tm.marked_ranges(F.col("ids"), (2, 3), 4, 5, 6)).alias("r")).select("id", "r.*")


@query("""SELECT n_name, split FROM nation, (VALUES ('train'), ('val'), ('test')) s(split)""")
def labels_by_split(s: SparkSession, d: str) -> DataFrame:
    return st.with_each(table(s, d, "nation").select("n_name"), "split", ["train", "val", "test"])
