"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A test item of m distinct five-word shingles is held by a document if at least t = ceil(0.75 m)
of them are among the document's. Items are partitioned by size, m within a factor 4/3; a partition has its own
sketches: of each item the k = m - t + 1 shingles of least hash (its bottom-k MinHash), and the threshold under which all of
these lie. A document that holds t of the m shingles misses at most m - t, so it holds at least one of any k: with this k the search
misses nothing, whatever the document's length. A document's sketch for a partition is its hashes up to the
partition's threshold, taken only if the document is large enough for an item of it; where sketches meet, the pair is a
candidate and is verified by counting shared shingles as strings. A fixed number of hash bands tuned for Jaccard similarity
would miss short items in documents of thousands of words; sketches by size do not.

Defined results: null or blank texts and items have no shingles and match nothing; a text of
one to four words is one shingle; repeated rows, or rows of equal ids, each give their own
result rows; empty tables give no rows; extra columns are ignored. Words are lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.texts import distinct_texts, text_key

SHINGLE = 5
PERCENT = 75
#: Sketch rows of 24 bytes that may be broadcast; a larger sketch is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The lower-cased words; one empty word for a blank text. Kept in a column of its own before a lambda reads it, else each element splits the text anew."""
    return F.split(F.trim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")


def has_words(w: Column) -> Column:
    return F.get(w, F.lit(0)) != ""


def _starts(w: Column, size: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the runs of ``size`` words, of all words if there are fewer; ``w`` must not be empty."""
    return F.transform(_starts(w, size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """The distinct runs of ``size`` words as strings."""
    return F.array_distinct(F.transform(_starts(w, size), lambda i: F.concat_ws(" ", F.slice(w, i + 1, size))))


def _items(benchmark: DataFrame, size: int, percent: int) -> DataFrame:
    """(ikey, shingles, n_item, need) of every distinct item that has words."""
    own = benchmark.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("ikey"), words(F.col("text")).alias("w"))
    own = own.where(has_words(F.col("w"))).dropDuplicates(["ikey"]).select("ikey", shingles(F.col("w"), size).alias("shingles"))
    n = F.size("shingles")
    return own.select("ikey", "shingles", n.alias("n_item"), F.expr(f"cast(div({percent} * size(shingles) + 99, 100) as int)").alias("need"))


def partition_of(n: Column) -> Column:
    """The number of the size partition: sizes up to a power of 4/3."""
    return F.ceil(F.round(F.log(n.cast("double")) / F.log(F.lit(4 / 3)), 9)).cast("int")


def sketches(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(part, ikey, need, h): the bottom-k hashes of each item, k by the item's size."""
    hashes = F.transform("shingles", lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(k)) for k in range(size)]))
    least = F.slice(F.array_sort(hashes), F.lit(1), F.col("n_item") - F.col("need") + 1)
    return items.select(partition_of(F.col("n_item")).alias("part"), "ikey", "need", F.explode(least).alias("h"))


def threshold(parts: list, n: Column) -> Column:
    """The largest hash that a document of ``n`` shingles probes with; ``parts`` are (least need, threshold) of the partitions. Null if it is too small for all."""
    out, held = F.lit(None).cast("long"), None
    for need, top in sorted((int(need), int(top)) for need, top in parts):
        held = top if held is None else max(held, top)
        out = F.when(n >= need, F.lit(held)).otherwise(out)
    return out


def containment_pairs(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, ikey, n_shared, n_item) for distinct texts that hold a distinct item."""
    items = _items(benchmark, size, percent)
    sketch = sketches(items, size)
    small = sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parts = [(r.need, r.top) for r in sketch.groupBy("part").agg(F.min("need").alias("need"), F.max("h").alias("top")).collect()]  # a row for each size partition
    texts = distinct_texts(docs).select("key", "text")
    probe = texts.select("key", words(F.col("text")).alias("w")).where(has_words(F.col("w")))
    n = F.greatest(F.size("w") - (size - 1), F.lit(1))
    probe = probe.select("key", n.alias("n"), threshold(parts, n).alias("top"), "w").where("top is not null")
    probe = probe.select("key", "n", "top", F.explode(shingle_hashes(F.col("w"), size)).alias("h")).where("h <= top")
    met = probe.join(F.broadcast(sketch) if small else sketch, "h").where("n >= need")
    candidates = met.groupBy("key").agg(F.collect_set("ikey").alias("ikeys"))
    held = texts.join(candidates, "key").select("key", words(F.col("text")).alias("w"), "ikeys").select("key", shingles(F.col("w"), size).alias("own"), F.explode("ikeys").alias("ikey")).join(items, "ikey")
    shared = F.size(F.array_intersect("own", "shingles"))
    counted = held.select("key", "ikey", shared.alias("n_shared"), "n_item", "need")
    return counted.where(F.col("n_shared") >= F.col("need")).drop("need")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every row of ``docs`` and item that it holds."""
    pairs = containment_pairs(docs, benchmark, size, percent)
    names = benchmark.where(F.col("text").isNotNull()).select("item_id", text_key(F.col("text")).alias("ikey"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text")).alias("key"))
    share = F.round(F.col("n_shared") / F.col("n_item"), 6)
    return rows.join(pairs.join(names, "ikey"), "key").select("doc_id", "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"), share.alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that hold an item; rows without text stay."""
    bad = containment_pairs(docs, benchmark, size, percent).select(F.col("key").alias("_held")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_key(F.col("text")).alias("_key"))
    return rows.join(bad, F.col("_key") == F.col("_held"), "left_anti").select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0)
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, round(count(*) / n_item, 6) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item
HAVING 100 * count(*) >= 75 * n_item
"""
