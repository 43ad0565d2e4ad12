"""Column expressions over dialogue text: parsing, labels, formatting, chat templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels of assistant turns, the form of a dialogue's line and of a label in it, the tokens that a PTB-style tokeniser drops, verbs that carry no action.
INTENTIONS = (("instruction", "instruction"), ("correction", "correction"), ("info", "info_sharing"), ("feedback", "feedback"))
DEFAULT_LABEL = "initiative|other"
PUNCTUATION = ("''", "'", "``", "`", "-lrb-", "-rrb-", "-lcb-", "-rcb-", ".", "?", "!", ",", ":", "-", "--", "...", ";")
DIALOG_LINE, LABEL_MARK = r"^\[(.*?)s\] (.*?): (.*)", r"\[(.*?)\|(.*?)\]"
PASSIVE_VERBS = ("hold", "touch", "rotate", "inspect")

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("time", T.DoubleType()), T.StructField("content", T.StringType()), T.StructField("labels", T.StringType())])


def word_count(text: Column) -> Column:
    """Words between runs of white space; an empty text has none."""
    held = F.trim(text)
    return F.when(F.length(held) == 0, 0).otherwise(F.size(F.split(held, r"\s+")))


def initiativity(text: Column) -> Column:
    """'initiative' before 'responsive', in any case; a text with neither is an error."""
    text = F.lower(text)
    return F.when(text.contains("initiative"), "initiative").when(text.contains("responsive"), "responsive").otherwise(F.raise_error(F.concat(F.lit("no initiativity in "), text)).cast("string"))


def intention(text: Column) -> Column:
    """All intentions in fixed order, in any case, joined by commas; 'other' if there is none."""
    held = F.concat_ws(",", *[F.when(F.lower(text).contains(mark), name) for mark, name in INTENTIONS])
    return F.when(held == "", "other").otherwise(held)


def turn_label(text: Column) -> Column:
    """``initiativity|intention`` of the first ``[..|..]`` in a text, DEFAULT_LABEL if there is none or it cannot be parsed."""
    mark = lambda k: F.regexp_extract(text, LABEL_MARK, k)
    first = F.when(F.lower(mark(1)).contains("initiative"), "initiative").when(F.lower(mark(1)).contains("responsive"), "responsive")
    return F.coalesce(F.concat(first, F.lit("|"), intention(mark(2))), F.lit(DEFAULT_LABEL))


def parse_dialog(text: Column, with_labels: bool = True) -> Column:
    """Array of turns from lines ``[12.5s] Role: content [initiativity|intention]``; the label may stand anywhere and is cut out.

    Lines of another form, times that are no numbers, roles but user and assistant, and contents that begin with a
    parenthesis go; empty contents stay. Neighbours of one role and time are joined, unless the new text equals what is there.
    """

    def turn(line: Column) -> Column:
        part = lambda k: F.regexp_extract(line, DIALOG_LINE, k)
        role, said = F.lower(part(2)), F.trim(part(3))
        labels = F.when(role == "assistant", turn_label(said)).otherwise("") if with_labels else F.lit("")
        plain = F.trim(F.regexp_replace(said, LABEL_MARK, ""))
        return F.struct(role.alias("role"), part(1).try_cast("double").alias("time"), plain.alias("content"), labels.alias("labels"), said.startswith("(").alias("aside"))

    lines = F.transform(F.split(text, "\n"), turn)
    good = F.filter(lines, lambda t: t["role"].isin("user", "assistant") & t["time"].isNotNull() & ~t["aside"])
    return merge_adjacent(good)


def merge_adjacent(turns: Column) -> Column:
    """Turns with neighbours of one role and time joined by a space; a repetition of the joined text is dropped."""
    kind = T.ArrayType(TURN)

    def step(done: Column, turn: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = (F.size(done) > 0) & (last["role"] == turn["role"]) & (last["time"] == turn["time"])
        text = F.when(last["content"] == turn["content"], last["content"]).otherwise(F.concat_ws(" ", last["content"], turn["content"]))
        joined = F.struct(last["role"].alias("role"), last["time"].alias("time"), text.alias("content"), last["labels"].alias("labels"))
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(F.struct(turn["role"].alias("role"), turn["time"].alias("time"), turn["content"].alias("content"), turn["labels"].alias("labels")))))

    return F.aggregate(turns, F.from_json(F.lit("[]"), kind), step)


def conversation_text(turns: Column, head_tail: int | None = None) -> Column:
    """``[t s] Role: content [labels]`` lines, each ended by a line feed; with ``head_tail`` only the first and last half of so many, and '...' between."""

    def line(t: Column) -> Column:
        labels = F.when(F.length(F.coalesce(t["labels"], F.lit(""))) > 0, F.concat(F.lit(" ["), t["labels"], F.lit("]"))).otherwise("")
        return F.concat(F.lit("["), t["time"].cast("string"), F.lit("s] "), F.initcap(t["role"]), F.lit(": "), t["content"], labels)

    lines = F.transform(turns, line)
    if head_tail:
        half = head_tail // 2
        short = F.concat(F.slice(lines, 1, half), F.array(F.lit("...")), F.slice(lines, -half, half))
        lines = F.when(F.size(lines) > head_tail, short).otherwise(lines)
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def step_times(text: Column) -> Column:
    """All times in brackets, ``[1.0s]`` or ``[1.0s-2.0s]``, as numbers; what is no number is skipped."""
    held = F.regexp_extract_all(text, F.lit(r"\[(.*?)\]"), F.lit(1))
    parts = F.flatten(F.transform(held, lambda b: F.split(b, "-")))
    return F.filter(F.transform(parts, lambda p: F.left(p, F.length(p) - 1).try_cast("double")), lambda x: x.isNotNull())


def answer_int(text: Column) -> Column:
    """The first number after 'answer:', null without one."""
    return F.regexp_extract(F.lower(text), r"(?s)answer:.*?(\d+)", 1).try_cast("int")


def summary_line(text: Column) -> Column:
    """Of the last line with 'SUMMARY', what stands between its first and second colon."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("SUMMARY"))
    return F.trim(F.split_part(F.try_element_at(lines, F.lit(-1)), F.lit(":"), F.lit(2)))


def progress_note(time: Column, text: Column) -> Column:
    """The elapsed time and the summary of an answer; an answer without one is an error."""
    shown = F.concat(F.lit("The time elapsed since the start of the task is "), one_digit(time), F.lit(" seconds. "), summary_line(text))
    return F.when(text.contains("SUMMARY"), shown).otherwise(F.raise_error(F.concat(F.lit("no summary in "), text)).cast("string"))


def judge_scores(text: Column, names: tuple[str, ...]) -> Column:
    """Scores from the first {...} of one line between the first and the second '---', of the whole text without such a mark, as a struct; null if they cannot be read."""
    body = F.regexp_extract(F.when(text.contains("---"), F.split_part(text, F.lit("---"), F.lit(2))).otherwise(text), r"(\{.*?\})", 1)
    return F.from_json(F.when(F.length(body) > 0, body), T.StructType([T.StructField(n, T.DoubleType()) for n in names]))


def goal_line(text: Column) -> Column:
    """The first line without stars, trimmed."""
    return F.trim(F.replace(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit("*"), F.lit("")))


def by_keyword(text: Column, cases: tuple[tuple[str, str], ...], default: str) -> Column:
    """The value of the first keyword that the text holds, in any case."""
    return reduce(lambda rest, c: F.when(F.lower(text).contains(c[0]), c[1]).otherwise(rest), reversed(cases), F.lit(default))


def narration(passes: Column) -> Column:
    """One sentence from the first two narrations: the actor's mark becomes 'C' in the first and 'and' in the second.

    Those marked unsure in any case and those that do not start with the actor's mark go; of one that holds the mark again, only what is before it stays. '' if nothing is left.
    """

    def said(p: Column, i: Column) -> Column:
        own = F.substring(p, 5, 1_000_000_000)
        own = F.when(own.contains("#C C"), F.rtrim(F.split_part(own, F.lit("#C C"), F.lit(1)))).otherwise(own)
        return F.when(~F.lower(p).contains("#unsure") & p.startswith("#C C"), F.concat(F.when(i == 0, "C").otherwise("and"), own))

    text = F.trim(F.array_join(F.filter(F.transform(F.slice(passes, 1, 2), said), lambda x: x.isNotNull()), " "))
    return F.when(F.coalesce(F.size(passes), F.lit(0)) <= 0, "").when((text != "") & ~text.endswith("."), F.concat(text, F.lit("."))).otherwise(text)


def capitalised(text: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1_000_000)))


def caption(text: Column) -> Column:
    """Capitalised, with a full stop unless it ends in one of . ? !"""
    held = capitalised(F.trim(text))
    return F.when(held.rlike(r"[.?!]$") | (held == ""), held).otherwise(F.concat(held, F.lit(".")))


def plural(noun: Column, n: Column) -> Column:
    return F.when((n > 1) & ~noun.endswith("s"), F.concat(noun, F.lit("s"))).otherwise(noun)


def mistake_text(verb: Column, this: Column, that: Column) -> tuple[Column, Column]:
    """What was done, and what it corrects: 'attach' goes with 'to', all other verbs with 'from'; the correction of an attaching has 'detach' for every 'attach' and 'from' for every 'to', that of any other verb the reverse."""
    to = verb == "attach"
    done = F.concat_ws(" ", verb, this, F.when(to, "to").otherwise("from"), that)

    def turned(*words: str) -> Column:
        return F.replace(F.replace(done, F.lit(words[0]), F.lit(words[1])), F.lit(words[2]), F.lit(words[3]))

    return done, F.when(to, turned("attach", "detach", "to", "from")).otherwise(turned("detach", "attach", "from", "to"))


def connected(first: Column, second: Column) -> Column:
    """Two phrases with a space between: the second begins in lower case after a comma or colon, else in upper case; an empty one leaves the other, a second one alone begins in upper case."""
    rest = F.substring(second, 2, 1_000_000_000)
    upper, lower = (F.concat(change(F.left(second, F.lit(1))), rest) for change in (F.upper, F.lower))
    return F.when(first == "", upper).when(second == "", first).when(F.right(first, F.lit(1)).isin(",", ":"), F.concat(first, F.lit(" "), lower)).otherwise(F.concat(first, F.lit(" "), upper))


def ptb_tokens(text: Column) -> Column:
    """Lower-cased tokens without punctuation: words and marks are split by a pattern, which approximates the PTB rules."""
    apart = F.regexp_replace(F.lower(F.replace(text, F.lit("\n"), F.lit(" "))), r"([.,!?;:()\[\]{}\"`]|--|\.\.\.|n't|'(?:s|m|d|re|ve|ll)\b)", " $1 ")
    return F.filter(F.split(F.trim(apart), r"\s+"), lambda t: (t != "") & ~t.isin(*PUNCTUATION, "(", ")", "[", "]", "{", "}", '"'))


def chat_text(turns: Column, image: str = "<image>", per_image: int = 1, separator: str = "") -> Column:
    """Turns with role headers and end marks; turns of frames are image tokens, images joined by the separator."""

    def one(t: Column) -> Column:
        frames = F.array_join(F.array_repeat(F.lit(image * per_image), (t["end"] - t["start"]).cast("int")), separator)
        said = F.concat(F.lit("<|start_header_id|>"), t["role"], F.lit("<|end_header_id|>\n\n"), F.trim(t["content"]), F.lit("<|eot_id|>"))
        return F.when(t["role"] == "frames", frames).otherwise(said)

    return F.array_join(F.transform(turns, one), "")


def cleaned_turn(text: Column, image: str = "<image>", separator: str = "") -> Column:
    """(text, role) of generated text up to its end mark, without the start mark, image tokens and separators.

    Where a role's header is there, the role is what stands before its end and the text what stands behind, as it is; else the role is null and a lone full stop is silence.
    """
    cut = F.regexp_replace(F.split_part(text, F.lit("<|eot_id|>"), F.lit(1)), r"^\s+|\s+$", "")
    for mark in ("<|begin_of_text|>", image, *([separator] if separator else [])):
        cut = F.replace(cut, F.lit(mark), F.lit(""))
    head = "<|end_header_id|>\n\n"
    end = F.instr(cut, head)
    role = F.replace(F.substring(cut, F.lit(1), end - 1), F.lit("<|start_header_id|>"), F.lit(""))
    return F.when(end > 0, F.struct(F.substring(cut, end + len(head), F.length(cut)).alias("text"), role.alias("role"))).otherwise(
        F.struct(F.when(cut == ".", "").otherwise(cut).alias("text"), F.lit(None).cast("string").alias("role"))
    )


def cleaned(text: Column, image: str = "<image>", separator: str = "") -> Column:
    """The text of ``cleaned_turn``."""
    return cleaned_turn(text, image, separator)["text"]


def combined_system(turns: Column) -> Column:
    """The contents of system turns, a blank line between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "system"), lambda t: t["content"]), "\n\n")


def instruction_of(text: Column) -> Column:
    """What stands before the elapsed time or the task knowledge."""
    return F.trim(F.split_part(F.split_part(text, F.lit("The time elapsed since"), F.lit(1)), F.lit("Task knowledge: "), F.lit(1)))


def size_text(n: Column) -> Column:
    """A whole number with K, M, G, T or P, in steps of 1000; numbers of less than 1000 in size as they are."""
    out, scaled = F.format_string("%d", F.when(F.abs(n) < 1000, n).cast("long")), n.cast("double")
    for unit in ("K", "M", "G", "T", "P"):
        larger = F.abs(scaled) >= 1000
        scaled = scaled / 1000.0
        out = F.when(larger, F.concat(one_digit(scaled), F.lit(unit))).otherwise(out)
    return out


def short_name(name: Column) -> Column:
    """A data set's name up to and with its first 'val'; without one, its first 'test'."""
    until = lambda mark: F.concat(F.split_part(name, F.lit(mark), F.lit(1)), F.lit(mark))
    return F.when(name.contains("val"), until("val")).when(name.contains("test"), until("test")).otherwise(name)


def user_types(text: Column) -> Column:
    """``type@n,...`` as an array with each type n times; n is 1 if left out."""
    return F.flatten(F.transform(F.split(text, ","), lambda p: F.array_repeat(F.split_part(p, F.lit("@"), F.lit(1)), F.coalesce(F.split_part(p, F.lit("@"), F.lit(2)).try_cast("int"), F.lit(1)))))


def eval_setups(text: Column) -> Column:
    """``dataset|runner|maxlen|threshold|context`` setups, comma between, as structs; 4k is 4096."""

    def one(s: Column) -> Column:
        part = lambda k: F.split_part(s, F.lit("|"), F.lit(k))
        size = F.when(part(3).endswith("k"), F.regexp_extract(part(3), r"^(\d+)", 1).try_cast("int") * 1024).otherwise(part(3).try_cast("int"))
        return F.struct(part(1).alias("dataset"), part(2).alias("runner"), size.alias("max_len"), part(4).try_cast("double").alias("threshold"), part(5).alias("context"))

    return F.transform(F.split(text, ","), one)


def dataset_path(text: Column, root: str) -> Column:
    """``folder/file`` as the path of its prepared samples."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.split_part(text, F.lit("/"), F.lit(1)), F.lit("/prepared/"), F.split_part(text, F.lit("/"), F.lit(2)), F.lit(".jsonl"))


def task_catalogue(tasks: Column) -> Column:
    """Of an array of tasks (id, name, domain, steps): a head line, numbered steps and a blank line for each."""

    def one(t: Column) -> Column:
        steps = F.transform(t["steps"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n")))
        return F.concat(F.lit("Task "), t["id"].cast("string"), F.lit(": "), t["name"], F.lit(" (domain: "), t["domain"], F.lit(")\n"), F.array_join(steps, ""), F.lit("\n"))

    return F.array_join(F.transform(tasks, one), "")


def tokens_estimate(text: Column, images: Column, per_image: int = 500) -> Column:
    """1.3 tokens a word and a fixed number an image."""
    return F.floor(word_count(text) * F.lit(1.3)) + images * per_image


def one_digit(x: Column) -> Column:
    """A number with one digit after the point, rounded as the double's exact value is, ties to even: 0.25 is 0.2 and 0.35, which lies below, 0.3.

    20 |x| is kept as an exact sum of two doubles (the upper 26 bits of x, and the rest), so the comparison with the tie is exact below 1e14.
    """
    size = F.abs(x.cast("double"))
    upper = size * 134217729.0
    upper = upper - (upper - size)
    a, b = upper * 20.0, (size - upper) * 20.0
    half = F.floor((a + b) / 2.0)
    over = (a - (half * 2 + 1)) + b
    k = half + F.when((over > 0) | ((over == 0) & (half % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"))


def step_line(start: Column, end: Column, text: Column) -> Column:
    """``[1.0s-2.5s] text``."""
    return F.concat(F.lit("["), one_digit(start), F.lit("s-"), one_digit(end), F.lit("s] "), text)


def substep_line(start: Column, text: Column) -> Column:
    """`` - [1.0s] text``."""
    return F.concat(F.lit(" - ["), one_digit(start), F.lit("s] "), text)


def normalised(text: Column) -> Column:
    """Trimmed; underscores as spaces, every 'student' as 'user', ``*unintelligible*`` gone."""
    held = F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("_"), F.lit(" "))
    return F.replace(F.replace(held, F.lit("student"), F.lit("user")), F.lit("*unintelligible*"), F.lit(""))


def named_clip(*parts: Column, view: Column | None = None) -> Column:
    """A recording's name: its parts joined by underscores, and the view behind two."""
    name = F.concat_ws("_", *parts)
    return name if view is None else F.concat(name, F.lit("__"), view)
