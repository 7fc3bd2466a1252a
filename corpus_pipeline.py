"""The training corpus from raw documents: five stages, each one operator over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import language, mixing, packing, simhash, substrings
from parlance.llm.common import materialize
from parlance.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a smaller share is rejected; with no evidence, each of four has a quarter.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of no language the corpus is labelled with.

    A null or empty text has no letter. Rows of one doc_id, or of none, are judged each on its own text; where no row
    has a language there is no model, and nothing passes. No rows give no rows.
    """
    model = language.fit(docs.select("doc_id", "lang", "text"))
    found = language.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, and of repeated rows, the document with the smallest doc_id stays.

    Rows of one doc_id, or of none, are documents of their own: each group keeps its first by doc_id (null last)
    and hash of the text. Rows equal in both keep the smallest of the other columns.
    """
    first = simhash.first_of_groups(docs.select("doc_id", "text"))
    # the join deals by these keys, and so does the removal of repeated rows: the texts are shuffled once
    kept = docs.select(*COLUMNS, *simhash.row_keys()).join(first, simhash.ROW_KEYS, "left_semi")
    kept = kept.groupBy(*simhash.ROW_KEYS).agg(F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return kept.select(F.when(~F.col("missing"), F.col("number")).alias("doc_id"), "text", "rest.*").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 bytes or more that a document with a smaller doc_id has too; n_chars follows.

    Rows of one doc_id never cost each other a byte, and rows without one stay as they are. A null text stays null,
    and its n_chars too; a text may become empty. No rows give no rows.
    """
    cut = substrings.remove_repeats(docs.select("doc_id", "text", "lang", "source"), length=50, with_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Documents without words come through once. A null source is a source. Rows alike in doc_id and text are rounded
    alike; their copies are rows. No rows give no rows.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), weights=(3, 1, 2), share=1.5, most=2).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: one row a piece of a document. Null and empty texts are their end id; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path(), end_id=1, capacity=4096)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL cannot express the trained, hashed and packed stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
