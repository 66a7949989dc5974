"""A corpus in five stages: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
``documents``. Filtering stages judge each row in place and keep the rest untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import fresh_path, remainder, short_batches, table
from cairn.llm.decontaminate import drop_contaminated
from cairn.llm.mixing import in_mixed_order, mix
from cairn.llm.quality import fit_texts, keep_quality
from cairn.llm.simhash import keep_one
from cairn.llm.token_output import token_output


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; learns from labelled documents that are not held out.

    A null text is judged as an empty one; rows with a null id are judged and not learned from; repeated rows are judged alike.
    """
    apart = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return keep_quality(docs, fit_texts(docs, table(spark, sf_dir, "labels"), ~apart))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: of the least id (null last), then text.

    Null texts and ids and repeated ids are rows like any other; an empty table stays one.
    """
    short_batches(spark)
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark; those without text hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture; ties go by a hash of the row, columns keep their values."""
    return in_mixed_order(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files in the order of the mixture and returns what they hold, a row for each document.

    The order is found again from the rows, so that it does not hang on that of files; a null text is just the end id.
    """
    import public_tokenizers

    short_batches(spark)

    return token_output(mix(docs), public_tokenizers.path("byte_bpe_50k.json"), order=[F.col("mix_position")])


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: Fingerprints, discriminants and encodings have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
