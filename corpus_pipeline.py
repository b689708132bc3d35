"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gets what the one before it kept, as written to
Parquet and read again. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import line_dedup, mixing, packing, quality_rules, simhash_vp
from sketchloom.llm.common import beside, new_folder, read, ship


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep."""
    labels = read(spark, sf_dir, "labels")
    return quality_rules.passing(docs, quality_rules.train(docs, labels))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that they lose; n_chars follows the text."""
    rest, back = beside(docs, "doc_id", "text")
    got, lost = line_dedup.deduplicated(docs.select("doc_id", "text", *rest)), F.col("n_dropped") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return got.select(*[F.when(lost, new[c.lower()]).otherwise(back(c)).alias(c) if c.lower() in new else back(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, Jaccard 0.8 or more."""
    return simhash_vp.deduplicated(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, as often as it takes them."""
    return mixing.sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The stages train a model and search for packings: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's rows written and read again."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), new_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
