"""From raw documents to token ids, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``. All
but the last keep the columns of ``docs``.

1. quality: documents that the classifier scores below its threshold go.
2. near_dedup: one document of each group of near-duplicates stays; documents are
   linked from a similarity of 0.80, where op1 has 0.85.
3. decontaminate: documents with a passage of a test item go.
4. pii: personal data is replaced by its kind, and ``n_chars`` follows.
5. bpe: each text becomes token ids, with the hash of what they decode to.

Null texts count as empty. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.llm import bpe, decontam, neardup, pii, quality
from kerf.llm.common import materialize, table


#: Percent of shingles of five words that near copies share.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out("id"))
    return quality.accepted(docs, weights)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.distinct_documents(docs, percent=NEAR_PERCENT)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = bpe.bpe_round_trip(docs)
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
