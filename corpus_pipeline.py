"""A corpus pipeline: toxic documents go, of near copies one stays, secrets are masked, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.llm import packing, secrets, simhash, toxicity
from nearloom.llm.components import components
from nearloom.llm.queries import BYTE_BPE, table
from nearloom.llm.runtime import stored


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones, does not take for toxic."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, chain).where(~F.col("is_toxic")).select(*docs.columns)


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row with the smallest id.  Rows without an id stay, and so do different texts of one id.

    Texts are near copies if their fingerprints differ in two bits or fewer.
    Of what that leaves, those within five bits are too, if their texts
    confirm it: five-word shingles 0.8 alike or more.
    """
    # Rows are grouped by numbers of their own, stored so that they stay the same: one doc_id may name several texts.
    rows = stored(docs.where(F.col("doc_id").isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    first = F.min(F.struct("doc_id", "_hash", "_row")).alias("it")
    named = rows.select("_row", "doc_id", F.xxhash64("text").alias("_hash"))
    groups = stored(simhash.grouped(simhash.fingerprints(rows, "_row")).select(F.col("doc_id").alias("_row"), "fp", "component_id"), "groups")
    kept = named.join(groups, "_row").groupBy("component_id").agg(first).select(F.col("it._row").alias("_row"))
    one = stored(rows.join(kept, "_row", "left_semi"), "one")
    prints = groups.join(kept, "_row", "left_semi").select(F.col("_row").alias("doc_id"), "fp")
    wider = stored(components(simhash.similar(one, prints, "_row")).withColumnRenamed("node", "_row"), "wider")
    stay = named.join(wider, "_row").groupBy("component").agg(first).select(F.col("it._row").alias("_row"))
    one = one.join(wider.join(stay, "_row", "left_anti"), "_row", "left_anti").select(*docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def documents_are_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("simhash near-dedup", near_copies_go),
    ("secret scans", secrets_are_masked),
    ("best-fit packing", documents_are_packed),
]

#: SQL can express neither the classifier nor the fingerprints nor the tokenizer; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
