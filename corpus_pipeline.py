"""A training-corpus pipeline over ``documents``: toxicity, line dedup, SimHash near-dedup, mixing to
target weights, SentencePiece encoding. Each stage takes the rows its predecessor kept and returns
the columns of documents (the last one: the encoded texts)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volforge.llm import line_dedup, mixing, sentencepiece_fst, simhash, toxicity
from volforge.llm.common import fresh, shared_dir, table

MAX_REPEATS = 1.5      # of the rarest source in the mix; the most frequent one is taken once


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents share; n_chars follows the new text."""
    made = fresh(docs, "deduped")
    out = line_dedup.dedup_lines(docs, out_col=made)
    changed = F.col(f"{made}.n_dropped") > 0
    text = F.when(changed, F.col(f"{made}.text")).otherwise(F.col("text"))
    named = {"text": text}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.when(changed, F.length(F.col(f"{made}.text")).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(named[c].alias(c) if c in named else F.col(c) for c in docs.columns))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id."""
    return simhash.keep_one_per_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of rarer sources up to MAX_REPEATS times on average."""
    copies = fresh(docs, "copies")
    mixed = mixing.mix(docs, out_col=copies, max_repeats=MAX_REPEATS, cover=True)
    return mixing.realise(mixed, copies).select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_ids, ids of each copy in the mix."""
    coded = sentencepiece_fst.encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("SentencePiece encoding", sentencepiece_stage),
]

# SentencePiece encoding and the toxicity model have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/stage-{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
