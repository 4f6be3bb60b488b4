"""Cleaning and packing a corpus: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as
Parquet in the shared folder and reads it back as the next one's documents. All but the last return
the columns of documents. Each row gets its own verdict, whatever its doc_id. No SQL can express the stages, so there is no oracle.
"""

from __future__ import annotations

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import materialise, table
from wakeline.llm.decontaminate import matches
from wakeline.llm.near_copies import distinct_rows
from wakeline.llm.packing import pack
from wakeline.llm.pii import find, redacted
from wakeline.llm.toxicity import clean, train

PACKING_BYTES = 1 << 21  # of text at once: the stages before leave an executor little memory
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose chance of a toxic grade reaches the operator's threshold."""
    return clean(docs.select(*COLUMNS), train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, with the smallest doc_id; five-word shingles, similarity 0.8."""
    return distinct_rows(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a passage of the benchmark."""
    rows = materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so that a row keeps its number
    found = matches(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind."""
    found = find(docs, COLUMNS[1:])
    clean = redacted(F.col("text"), F.col("spans")).alias("text")
    return found.select("doc_id", clean, "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), group_bytes=PACKING_BYTES)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
