"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, PII redaction, BPE encoding.

Each stage works on all its predecessor kept and returns the columns of documents, the last one the encoded documents.
Between stages the rows are written as Parquet below the shared folder and read again.

Decisions: a text in no known language goes; of each class of near duplicates the document with the smallest id stays, and its
rows if it repeats; a document that contains a benchmark window goes; personal data is replaced by its kind.  Rows are judged
by id and text together: an id that repeats with other texts is several documents, a null id one like others.  Empty tables
pass through; extra columns, whatever their names, are carried up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm import bpe_codec, decontamination, language_id, near_duplicates, personal_data
from tallyroom.llm.tables import kept, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, judged by models of all rows that have a language."""
    return language_id.identify(docs, F.lit(True), carry=True).where("NOT rejected").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that of the smallest id, a null id being the last."""
    return near_duplicates.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark window."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.where("NOT contaminated").select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the text."""
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of ids and of the text decoded from them."""
    said = bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return said.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", known_languages),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("bpe_codec", encoded),
]

#: No SQL expresses language models, boosted trees or BPE merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
