"""Column expressions for times, frames, intervals and costs of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """``h:m:s.f`` as seconds."""
    part = lambda k: F.split_part(text, F.lit(":"), F.lit(k)).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def tick_seconds(ticks: Column) -> Column:
    """Ticks of 100 ns as seconds."""
    return ticks / F.lit(10_000_000.0)


def frame_index(seconds: Column, fps: float, mode: str = "round") -> Column:
    """Frame number of a time: rounded half to even, floor or ceil."""
    value = seconds * F.lit(float(fps))
    return {"round": F.bround(value, 0), "floor": F.floor(value), "ceil": F.ceil(value)}[mode].cast("long")


def clock_frame_index(text: Column, fps: float) -> Column:
    """Frame number of ``hh:mm:ss.ms``, whose fraction is a whole number of milliseconds."""
    ms = F.coalesce(F.split_part(text, F.lit("."), F.lit(2)).try_cast("int"), F.lit(0))
    return frame_index(clock_seconds(F.split_part(text, F.lit("."), F.lit(1))) + ms / 1000.0, fps)


def frame_clock(index: Column, fps: float) -> Column:
    """``hh:mm:ss`` of a frame; a rest of a second counts as one, without carry."""
    total = index / F.lit(float(fps))
    whole = F.floor(total)
    seconds = whole % 60 + F.when(total > whole, 1).otherwise(0)
    return F.format_string("%02d:%02d:%02d", (whole / 3600).cast("int"), ((whole % 3600) / 60).cast("int"), seconds.cast("int"))


def frame_file(index: Column, suffix: str = ".jpg") -> Column:
    return F.concat(F.lpad(index.cast("string"), 10, "0"), F.lit(suffix))


def sample_step(rate: Column, fps: float) -> Column:
    """Every how many frames one is kept."""
    return F.floor((rate + 0.5) / F.lit(float(fps))).cast("int")


def least_distance(time: Column, times: Column) -> Column:
    """Least distance of a time to an array of times; null without times."""
    return F.array_min(F.transform(times, lambda t: F.abs(t - time)))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 if they do not meet."""
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    whole = (a1 - a0) + (b1 - b0) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def distance_cost(i: Column, j: Column, left: int, right: int, factor: float = 0.3, power: float = 1.5) -> Column:
    """|i - j| ** power, scaled so that the window's far end costs ``factor``."""
    reach = max(abs(left), right)
    return F.pow(F.abs(i - j).cast("double"), F.lit(power)) * F.lit(factor / reach**power)


def talk_cost(a: Column, b: Column) -> Column:
    """0 if both or neither say something, else 1."""
    return F.when((a != "") == (b != ""), 0.0).otherwise(1.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_cost(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.abs(cosine(a, b))


def match_window(seconds: tuple[float, float], fps: float) -> tuple[int, int]:
    """A window of seconds in frames, cut towards 0."""
    return int(seconds[0] * fps), int(seconds[1] * fps)


#: Match windows in seconds by data set.
MATCH_SECONDS = {
    "narration": (-2.5, 2.5),
    "ego4d": (-4.0, 8.5),
    "epickitchens": (-1.5, 3.0),
    "holoassist": (-1.5, 2.5),
    "egoexolearn": (-2.0, 3.5),
    "assembly101": (-2.0, 4.0),
    "wtag": (-3.0, 6.0),
}


def tokens_per_image(patches: int, with_class: bool = True) -> int:
    return patches * patches + int(with_class)


def frames_tokens(n: Column, per_image: int, separator: bool) -> Column:
    """Tokens of n frames: those of each image and, if used, a separator between two."""
    return n * per_image + (F.greatest(n - 1, F.lit(0)) if separator else 0)


def pause_repeats(words: Column, fps: float) -> Column:
    """How many times a frame is shown while a text of so many words is read, at 300 words a minute, for 10 s at most."""
    return F.floor(F.least(words / 300.0 * 60, F.lit(10.0)) * fps).cast("int")


def learn_ranges(n_frames: Column, image_chars: int, per_image: int, separator_chars: int) -> Column:
    """Character ranges of the separators between the images of n frames, which are what is learned of them."""
    block = image_chars * per_image
    starts = lambda i: i * block + (i - 1) * separator_chars
    none = F.array().cast("array<array<int>>")
    return F.when(n_frames > 1, F.transform(F.sequence(F.lit(1), n_frames - 1), lambda i: F.array(starts(i), starts(i) + separator_chars))).otherwise(none)


def shifted_labels(tokens: Column, start: Column, end: Column, ignore: int = -100) -> Column:
    """Labels of a token array: the tokens of [start, end), one place to the left; other places are ignored."""
    return F.transform(tokens, lambda t, i: F.when((i >= start - 1) & (i < end - 1), F.get(tokens, i + 1)).otherwise(F.lit(ignore)))


def cover_size(width: Column, height: Column, side: int) -> tuple[Column, Column]:
    """Width and height that cover a square of ``side`` with the same shape."""
    scale = F.lit(float(side)) / F.least(width, height)
    return F.round(width * scale).cast("int"), F.round(height * scale).cast("int")


def pad_size(width: Column, height: Column, side: int) -> tuple[Column, Column, Column, Column]:
    """Width and height that fit a square of ``side``, and the left and top padding."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    w, h = F.round(width * scale).cast("int"), F.round(height * scale).cast("int")
    return w, h, F.floor((side - w) / 2).cast("int"), F.floor((side - h) / 2).cast("int")


def marked_ranges(ids: Column, opening: tuple[int, ...], closing: int, frame: int, decision: int, rate: float = 1.0, key: Column | None = None) -> Column:
    """Ranges (start, end, kind) of a token array that are learned: answers, then the places at which a frame decides to talk.

    An answer runs from behind ``opening``, a sequence of tokens, up to and with the next ``closing``; an opening inside an answer is text, one without a closing is none. A frame's place is
    the first ``decision`` token at or behind a ``frame`` token; it is 'talk' if ``closing`` follows, else 'w2t', of which a seeded share ``rate``, by ``key`` and place, is kept.
    """
    none = F.array().cast("array<int>")
    places = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1)).otherwise(none)

    def let(value: Column, body: object) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def at(token: int) -> Column:
        return F.filter(places, lambda i: F.get(ids, i) == token)

    def opens(i: Column) -> Column:
        held = F.get(ids, i) == opening[0]
        for k, token in enumerate(opening[1:], 1):
            held = held & F.coalesce(F.get(ids, i + k) == token, F.lit(False))
        return held

    def between(marks: Column, ends: Column, own: int) -> Column:
        """For each end the first mark behind the end before it, and before it or, with ``own``, at it."""
        return F.transform(ends, lambda e, j: F.struct(F.get(F.filter(marks, lambda m: (m > F.when(j == 0, -1).otherwise(F.get(ends, F.greatest(j - 1, F.lit(0))))) & (m < e + own)), F.lit(0)).alias("mark"), e.alias("end")))

    def made(start: Column, end: Column, kind: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("kind"))

    answers = let(at(closing), lambda ends: F.transform(F.filter(between(F.filter(places, opens), ends, 0), lambda x: x["mark"].isNotNull()), lambda x: made(x["mark"] + len(opening), x["end"] + 1, F.lit("assistant"))))
    kind = lambda p: F.when(F.coalesce(F.get(ids, p + 1) == closing, F.lit(False)), "talk").otherwise("w2t")
    frames = let(at(decision), lambda ends: F.transform(F.filter(between(at(frame), ends, 1), lambda x: x["mark"].isNotNull()), lambda x: made(x["end"], x["end"] + 1, kind(x["end"]))))
    if rate < 1:
        share = lambda x: F.conv(F.substring(F.md5(F.concat_ws(":", (F.lit("") if key is None else key).cast("string"), x["start"].cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
        frames = F.filter(frames, lambda x: (x["kind"] == "talk") | (share(x) < rate))
    return F.concat(answers, frames)
