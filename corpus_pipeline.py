"""A training corpus from `documents`: five stages, each written as Parquet and read again before the next.

Every stage takes any table with the columns of `documents` and drops other columns, whatever their names. Rows with nulls in any
column, empty and very long texts and repeated rows go through all stages as each says; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyworks.llm import linededup, mixing, packing, simhash, toxicity
from plyworks.llm.common import remember, scope, shared_folder, table, text_tags

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: words a shingle, and the similarity that the shingles must have.
NEAR_WIDTH, NEAR_SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models reject go. A null or empty text says nothing and stays; so does everything if the labels lack a class."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity_score(model, F.col("text")) < 0.3).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text. A document that loses all its lines stays, empty, and a null text stays null.

    A null id sorts before every other; rows that repeat an id are one document, each with its own lines."""
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    changed = F.col("__n_dropped") > 0
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of near copies connect, those whose five-word shingles have a Jaccard similarity of 0.8, the smallest doc_id stays.

    Where an id comes with several texts, each text goes or stays by its own group; texts are told apart by two 64-bit hashes. Documents without an id
    all stay."""
    groups = simhash.near_copies(docs, width=NEAR_WIDTH, least=NEAR_SIMILARITY)
    gone = groups.filter("doc_id <> kept").select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), F.col("tag2").alias("__tag2")).distinct()
    tag, tag2 = text_tags("text")
    return docs.join(gone, (F.col("doc_id") == F.col("__doc")) & (tag == F.col("__tag")) & (tag2 == F.col("__tag2")), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the schedule reads it. A null source is a source; a text without words
    comes as often as the place where it lies is read."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the training sequences with their texts: a row per piece of a document, with lang and source. A text without words is a piece of size 0 outside all bins.

    Rows that repeat an id are told apart by two hashes of their texts, tag and tag2, and equal ones by their copy; the pieces of a copy, joined in order, are its text."""
    return packing.packed_texts(docs, keep=("lang", "source"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("simhash near-dedup", drop_near_copies), ("mixing sources", mix_sources), ("best-fit packing", pack_bins)]

#: Language models, XXH64 fingerprints, hashed order and best fit have no SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's table lies in the shared folder and goes once the next one is written; the last one is the result and stays."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    with scope(spark):
        for n, (_, stage) in enumerate(STAGES):
            with scope(spark):  # tables of the stage's own
                stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
            if n < len(STAGES) - 1:
                remember(f"{folder}/{n}")
    return docs
