"""Corpus pipeline over ``documents``: each stage applies one operator of ``evidencelens.llm`` to what its predecessor kept.

Language ID rejects texts without a language and sets ``lang`` to its prediction; near-dedup keeps one document of each group; decontamination
drops documents that contain a benchmark item; the secret scan replaces live credentials in the text; the last stage encodes.
A stage keeps all columns of its input, under their names, whatever further ones there are. Rows with null or wordless text
go with the first stage; an empty table stays empty through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelens.llm import bpe, decontamination, language_id, near_dedup, secret_scans
from evidencelens.llm.text import ship, table
from evidencelens.session import materialise

#: Texts whose best language is less likely than this are rejected.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, ``lang`` set to it. Learns from the labelled documents that are not held out."""
    found = language_id.predicted(docs, "text", language_id.fit(docs), "__guess").filter((F.col("__guess.lang") != language_id.UNKNOWN) & (F.col("__guess.score") >= MIN_SCORE))
    return found.withColumn("lang", F.col("__guess.lang")).drop("__guess")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked at five words and 80 % that with the smallest id (of equal ids, one text; of repeated rows, one)."""
    groups = near_dedup.near_duplicates(docs, F.col("doc_id"), F.col("text"), shingle=5, percent=80)
    winners = groups.select(F.col("winner.doc_id").alias("__id"), F.col("winner.text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__hash_of", F.xxhash64("text"))
    kept = rows.join(winners, (F.col("__hash_of") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return kept.drop("__id", "__hash").dropDuplicates(["__hash_of", "doc_id"]).drop("__hash_of")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    items = table(spark, sf_dir, "benchmark")
    return decontamination.without_items(docs, "text", items, F.col("item_id"), F.col("text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live credentials in ``text`` are replaced and ``n_chars`` follows."""
    return secret_scans.redact(docs, "text", repository=F.col("doc_id"), owner=F.col("source")).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, their number and the digests of ids and decoded text."""
    return bpe.round_trip(docs, F.col("doc_id"), F.col("text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe", encode),
]

#: Models and hashes are not SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's result is written to the shared folder and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
