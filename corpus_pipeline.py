"""Cleaning of the documents table in stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and applies one operator to all
documents that its predecessor kept. All stages but the last return the
columns of documents; a document without id is kept by all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm import (
    op1_decontam,
    op2_packing,
    op6_pii,
    op9_superminhash,
    op10_toxicity,
)
from tradetally.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not find toxic."""
    net = op10_toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    scored = op10_toxicity.score(spark, docs, net, out_col="_toxic")
    return scored.where(F.col("_toxic") < op10_toxicity.THRESHOLD).drop("_toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id;
    rows that share its id stay. A stage on word shingles links from a
    similarity of 0.8 on; the 0.85 is that of the op9 query only."""
    gone = op9_superminhash.near_duplicates(spark, docs, num=80).where("not kept").select("doc_id")
    gone = stored(spark, gone.distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = op1_decontam.find_leaks(spark, docs, table(spark, sf_dir, "benchmark"))
    leaks = stored(spark, leaks.where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    found = op6_pii.cleaned(spark, docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in fixed token windows, with their ids. Workers
    live on through the other stages, so they keep few words."""
    return op2_packing.pack(spark, docs, remembered=250_000)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packing),
]

#: The stages' models and tokenizer are beyond SQL; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(spark, docs, f"stage-{name}")
    return docs
