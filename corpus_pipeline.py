"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, near_dedup, packing, queries, toxicity
from tidemark.llm.common import own_columns, stored

#: A learnt score, a packing and files can't be put in SQL; tests hold each stage against SQL or a plain version.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.table(spark, sf_dir, "labels").where(toxicity.fold() != 2)
    model = toxicity.trained(docs, labels)
    return own_columns(toxicity.scored(docs, model).where(F.col("score") < toxicity.THRESHOLD), docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = own_columns(line_dedup.dedup_lines(docs), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_dedup.deduplicated(docs).where(~F.col("kept")).select(F.col("doc").alias("doc_id"))
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, queries.table(spark, sf_dir, "benchmark"))
    return own_columns(found.where(~F.col("contaminated")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
