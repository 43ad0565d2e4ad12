"""Mixing sources to target weights by systematic sampling.

Sources have weights; their targets share all words by weight, a target stops at 3 times its source's
size, and the excess is shared again by weight among the others until none is above. Inside a source every
document's expected number of copies is target / size of the source; these are prefix-summed over the
source's documents in order of (size, doc_id), one random offset in [0, 1) is added, and a document is
emitted once for each whole number that its own share crosses. As documents stand in order of size, the words
taken differ from the target by at most the size of the source's largest document, and no document is
taken more than 3 times.

Prefix sums run over ranges of rows (``running``), so a source with a third of all documents spans many tasks; only
(doc_id, source, size) travel for the query. Shares are kept as whole-number fractions, so that no rounding at a boundary
emits a document twice. The excess is shared in rounds of one aggregate over a table of sources.

Defined results: a null text has size 0; a source without words has target 0 and is taken 0 times; null is a source,
the last; repeated rows are documents of their own; rows alike in source, size and doc_id share their copies in any order, so the
result's rows are the same on every run; an empty table gives no rows; columns of any name pass through ``mixed``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.components import cut, drop
from dialoom.operators.running import running_total

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
_WORD = r"[^\x20\x09-\x0D]"
_BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no white space, without an array of them."""
    marks = F.length(F.regexp_replace(text, rf"[\x20\x09-\x0D]*+{_WORD}++[\x20\x09-\x0D]*+", "w"))
    return F.when(text.rlike(_WORD), marks).otherwise(0).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, list[DataFrame]]:
    """((source, source_size, target, num, den), tables to drop) of (source, source_size); a source's documents are taken num / den times each."""
    placed, table = running_total(sources, F.lit(0), [F.col("source").asc_nulls_last()], F.lit(1), "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = cut(placed.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")))
    total, share = known.agg(F.sum("source_size"), F.sum("weight")).first()
    left, among = int(total or 0), int(share or 0)
    while True:  # what capped sources leave grows from round to round, so a source once capped stays so
        above = F.col("cap").cast(_BIG) * F.lit(among).cast("decimal(20,0)") < F.col("weight").cast(_BIG) * F.lit(left).cast("decimal(20,0)")
        cap, light = known.where(above).agg(F.sum("cap"), F.sum("weight")).first()
        rest, others = int(total or 0) - int(cap or 0), int(share or 0) - int(light or 0)
        if (rest, others) == (left, among):
            break
        left, among = rest, others
    free = F.col("weight") * F.lit(left)
    target = F.when(above, F.col("cap").cast("double")).otherwise(free.cast("double") / F.lit(float(max(among, 1))))
    num = F.when(above, F.lit(most).cast("long")).otherwise(free)
    den = F.when(above, F.lit(1).cast(_BIG)).otherwise(F.lit(max(among, 1)).cast("decimal(18,0)") * F.greatest(F.col("source_size"), F.lit(1)).cast("decimal(18,0)"))
    return known.select("source", "source_size", target.alias("target"), num.alias("num"), den.cast(_BIG).alias("den")), [table, known]


def allocate(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", size: Column | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies in a struct ``mix``; the columns of ``docs`` stay, in a struct ``doc``."""
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    given = given.withColumn("size", F.coalesce(word_count(F.col(f"doc.`{text}`")) if size is None else size, F.lit(0)).cast("long"))
    return _allocated(given.withColumn("source", F.col(f"doc.`{source}`")), F.col(f"doc.`{doc_id}`"), seed)


def _allocated(given: DataFrame, doc_id: Column, seed: str) -> DataFrame:
    placed, table = running_total(given, F.col("source"), [F.col("size"), doc_id], F.lit(1), "place")
    shares, tables = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10)
    offset = F.expr("draw * den div 4294967296").cast(_BIG)
    shares = cut(shares.withColumn("draw", draw.cast("decimal(18,0)")).withColumn("offset", offset).select(F.col("source").alias("_source"), "source_size", "target", "num", "den", "offset"))
    drop(*tables)
    met = placed.join(shares, F.col("source").eqNullSafe(F.col("_source")))

    def crossed(place: str) -> str:
        return f"(cast({place} as decimal(18,0)) * cast(num as decimal(20,0)) + offset) div den"

    copies = F.expr(f"{crossed('place')} - {crossed('place - 1')}")
    return met.select("doc", F.struct("size", "source_size", "target", copies.alias("copies")).alias("mix"))


def mixed(docs: DataFrame, **how: str) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as it is taken, in the same columns."""
    return allocate(docs, **how).where("mix.copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("mix.copies"))).alias("copy")).select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    lean = docs.select("doc_id", "source", F.coalesce(word_count(F.col("text")), F.lit(0)).alias("size"))
    return allocate(lean, size=F.col("doc.size")).select("doc.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


ORACLE = rf"""
with docs as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}+')), 0)::bigint as size from documents),
sources as (select source, sum(size)::bigint as s, ([{", ".join(map(str, WEIGHTS))}])[((row_number() over (order by source nulls last)) - 1) % {len(WEIGHTS)} + 1]::bigint as w from docs group by source),
steps as (select w, s, (sum(s) over ())::hugeint - coalesce(sum({MOST} * s) over (order by {MOST}.0 * s / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::hugeint as l,
    (sum(w) over (order by {MOST}.0 * s / w, source nulls last rows between current row and unbounded following))::hugeint as a from sources),
level as (select l, a from steps where w * l <= {MOST} * s * a order by l desc, a desc limit 1),
shares as (select source, s, {MOST} * s * a < w * l as above, w, l, a from sources, level),
rates as (select source, s, case when above then ({MOST} * s)::double else (w * l)::double / a end as target,
    case when above then {MOST}::hugeint else w * l end as num, case when above then 1::hugeint else a * greatest(s, 1) end as den,
    ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::bigint::hugeint as draw from shares),
placed as (select doc_id, source, size, (row_number() over (partition by source order by size, doc_id nulls first))::hugeint as k from docs)
select doc_id, size, s as source_size, target, size * ((k * num + draw * den // 4294967296) // den - ((k - 1) * num + draw * den // 4294967296) // den)::bigint as taken
from placed p join rates r on p.source is not distinct from r.source
"""
