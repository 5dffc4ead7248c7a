"""A corpus pipeline of five operators: what a stage rejects goes, the rest is the next one's input.

STAGES: (name, function) with function(spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
run() applies them to the table documents, each stage's result written as Parquet to the shared folder and read again.
Rows without doc_id stay through the stages that compare documents. Null and empty texts have no language and go in the second
stage. Very long texts are ones like others. Columns besides those of the table documents, of any name, are kept up to the last
stage. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.llm import common, decontam, langid, neardup, packing, registry, toxicity

#: Similarity in percent from which near copies go.
NEAR_PERCENT = 80

#: Not expressible in SQL: two stages apply trained models.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model, trained on the labelled ones, marks."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told."""
    return langid.keep_identified(docs, langid.train(docs))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among the ids."""
    ids = ids.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays, in one row."""
    removed = neardup.near_duplicates(docs, percent=NEAR_PERCENT).where("not kept")
    kept = without(docs, removed)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    again = common.saved(again)
    if again.isEmpty():
        return kept
    again = again.select(F.col("doc_id").alias("again"))
    once = kept.join(again, kept["doc_id"] == again["again"], "left_semi").dropDuplicates(["doc_id"])
    return without(kept, again.withColumnRenamed("again", "doc_id")).union(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return without(docs, decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, registry.tokenizer_path())


STAGES = [
    ("toxicity", clean),
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
