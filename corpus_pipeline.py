"""Corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
contaminated documents go, and what is left is encoded.

Each stage takes and returns the columns of ``documents`` (the last returns token ids instead). Its result is written
as Parquet and read again as the next one's input, so a lost executor costs no earlier stage. SQL can't express the
trained, fuzzy and vocabulary stages, so there is no ``ORACLE_SQL``; the stages are tested against brute force.

Edge cases: null texts pass all filters and encode to no ids; documents that lose all their lines to line dedup go,
others keep what is left of them, with ``n_chars`` counted anew; rows that repeat id and text are one document for the
near-duplicate stage; an empty table gives empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, decontaminate, lines, ngram_join, toxicity
from docketry.llm.common import remove, shared_folder, table, temporary_tables


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.deduplicated(docs, drop_emptied=True)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else kept


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, percent=80)  # the job's shingles; op9 has its own


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # needed here alone

    return bpe.encoding_digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", remove_contaminated),
    ("BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from the shared folder. What the stages before it wrote there is removed."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
