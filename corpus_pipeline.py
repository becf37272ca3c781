"""The corpus pipeline: five stages applied one after the other to the documents table.

quality classifier, line dedup, MinHash near-dedup, mixing to target weights, byte-level BPE.  Every stage takes what
its predecessor kept and returns the columns of ``documents``; the last one adds token ids and decoded text.
A stage changes ``text`` and ``n_chars`` together.  Defined cases are those of the operators: see their
modules.  Rows that repeat an id pass the filters one by one; near-dedup keeps one row per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import bpe, language_model, line_dedup, minhash, mixing
from stationlake.llm.registry import let_workers_import
from stationlake.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Models, rates and token ids have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text accepts."""
    return language_model.classify(docs, _labels(spark, sf_dir)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated long lines; a document that consisted of nothing else stays, without text."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more.

    Groups are linked by ids; the row of a group with its smallest id stays (of rows that repeat it, one).
    """
    found = minhash.groups(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by rates that meet the target weights of the domains.

    The classifier learns from labelled documents as they came, by language: those that the stages before leave are no
    fair sample of their domains (of toxic ones in one language fewer stay), and a language would count as a domain.
    """
    labels = _labels(spark, sf_dir)
    evidence = mixing.fit_classifier(_documents(spark, sf_dir), labels, by="lang")
    rates = mixing.fit_rates(mixing.posteriors(docs, labels, evidence), mixing.TARGETS)
    return mixing.apply_rates(docs, rates).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    coded = bpe.decode(bpe.encode(docs.select(*COLUMNS)))
    return coded.withColumns({"n_tokens": F.size("token_ids").cast("long"), "decoded": F.col("decoded").cast("string")})


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage is written to the shared folder and read again."""
    let_workers_import(spark)
    docs = _documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
