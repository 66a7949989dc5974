import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from cairn.llm import queries
from cairn.llm.common import remainder, table
from cairn.llm.mixing import mix
from cairn.llm.quality import score_quality
from cairn.llm.simhash import simhash_groups

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_their_rows(spark):
    docs = table(spark, SF, "documents").cache()
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "token_output"]
    stage = dict(corpus_pipeline.STAGES)

    apart = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    good = {r["doc_id"] for r in score_quality(docs, table(spark, SF, "labels"), ~apart, apart).where("predicted = 1").collect()}
    kept = stage["quality"](spark, docs, SF).cache()
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == good

    groups = simhash_groups(kept).collect()
    one = stage["near_dedup"](spark, kept, SF).cache()
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {r["component_id"] for r in groups}

    items = [" ".join((r["text"] or "").lower().split()) for r in table(spark, SF, "benchmark").collect()]
    clean = stage["decontamination"](spark, one, SF).cache()
    leaked = {r["doc_id"] for r in one.collect() if any(i and i in " ".join((r["text"] or "").lower().split()) for i in items)}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - leaked

    mixed = stage["mixing"](spark, clean, SF)
    order = [r["doc_id"] for r in mix(clean).orderBy("mix_position").collect()]
    assert mixed.columns == columns and [r["doc_id"] for r in mixed.collect()] == order

    out = sorted(stage["token_output"](spark, mixed, SF).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == order
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:i]) for i in range(len(out))]

    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, out))


def test_stages_take_odd_rows(spark, clash, empty):
    """Nulls, repeated ids, clashing names and no rows at all."""
    named = clash.selectExpr("*", "'mine' as th", "'mine' as rank", "'mine' as k2")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, SF)
        assert out.columns == named.columns and out.where("th <> 'mine' or rank <> 'mine' or fp <> 'clash'").count() == 0
        assert out.count() == named.count() if name == "mixing" else 0 <= out.count() <= named.count()
        none = stage(spark, empty, SF)
        assert none.columns == empty.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, named, SF).count() == named.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_every_operator_is_registered():
    assert "pipeline" in queries.QUERIES
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1


def test_held_out_rows_follow_crc32(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("r", remainder("doc_id", 4)).collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows)
