"""The pipeline's stages against what their operators say, and a brute-force version on a small corpus."""

import os
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from dialoom.llm import op03_quality, op08_jaccard, op10_decontaminate
from dialoom.session import table
from tests.llm.test_ops import check_packing

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    at, columns = docs, docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, at, SF)
        df.write.parquet(str(tmp_path / name))
        out[name] = at = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert at.columns == columns
            assert at.dtypes == docs.dtypes
    good = {r.doc_id for r in op03_quality.score_quality(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in out["quality"].collect()} == good
    groups = {r.component_id for r in op08_jaccard.digest(out["quality"]).collect()}
    assert Counter(r.doc_id for r in out["near_duplicates"].collect()) == Counter(groups)
    texts = {r.doc_id: (r.text or "").split() for r in out["near_duplicates"].collect()}
    seen = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    for r in out["repeated_passages"].collect():
        w = texts[r.doc_id]
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        assert r.text.split() == [x for i, x in enumerate(w) if i not in gone]
    bad = {r.doc_id for r in op10_decontaminate.contaminated(out["repeated_passages"], table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in out["decontamination"].collect()} == set(texts) - bad
    assert check_packing(out["packing"].collect(), [(r.doc_id, r.text) for r in out["decontamination"].collect()]) == 0


def test_run_equals_stages(spark, tmp_path):
    """The pieces of ``run`` hold what the stages kept one after the other: each document's ids once, in order."""
    at = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, SF).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def whole(rows):
        """Ids' checks by document where its pieces are the same cuts, else their lengths."""
        out = Counter()
        for r in rows:
            out[r.doc_id, r.doc_tokens] += r.length
        return out

    got = corpus_pipeline.run(spark, SF).collect()
    assert whole(got) == whole(at.collect())
    assert all(n % tokens == 0 for (_, tokens), n in whole(got).items())
    assert set(key) <= set(got[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_on_an_empty_table_and_on_nulls(spark, tmp_path):
    """Documents without rows give no pieces; null and blank texts, null ids and clashing columns pass through."""
    docs, labels, benchmark = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    odd = docs.where("doc_id < 40").unionByName(docs.where("doc_id < 3").withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    odd = odd.withColumns({c: F.lit("clash") for c in ("key", "_key", "label", "score", "bucket", "payload", "n", "h")})
    odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "odd" / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "odd" / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in got} - {None} <= set(range(40))
    assert sum(r.length for r in got) > 0
