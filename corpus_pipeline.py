"""From raw documents to packed sequences: five stages, each an operator of cellwright.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import mixing, packing, pii, text_dedup, toxicity
from cellwright.llm._shared import in_small_batches
from cellwright.sources.scratch import new_folder, remove, temporary

#: Documents with at least this score go.
TOXIC = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of the documents at hand and drop those that score as toxic."""
    in_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(toxicity.scorer(toxicity.fit(docs, labels))(F.col("text")) < TOXIC)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: the one with the smallest doc_id, those without an id last, and of rows that share that id
    the first by place. Texts without words are groups of their own; of those that share an id one stays for each text."""
    return text_dedup.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, ids included."""
    in_small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", to_target_weights),
    ("packing", packed),
]

#: Trained weights, hashes and a tokenizer decide: no SQL gives these rows. Tests hold the operators against brute force and run() against
#: plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves behind is deleted once its result is written, each result once the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, name)
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
