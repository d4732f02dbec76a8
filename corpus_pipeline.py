"""A training corpus from the table documents, in five stages.

Each stage takes the documents that the one before it kept and returns them with
the same columns; the last writes token files and returns what they hold. A stage's
result is written as Parquet in the cluster's shared folder and read again, so a
lost executor costs no earlier stage. Whole texts are read, of any length; an empty table gives an
empty result. Repeated rows (equal in all columns) count as so many documents until near duplicates go.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tintline.llm.common import shared_folder, table
from tintline.llm.decontaminate import clean_rows
from tintline.llm.jaccard_join import one_of_each_group
from tintline.llm.quality_rules import quality_filter
from tintline.llm.queries import MAX_EPOCHS
from tintline.llm.source_mix import mix_rows
from tintline.llm.token_output import read_digest, token_folder, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null, empty and blank texts among them, as they have no 50 words."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; of rows that tie in it, one."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item's window occurs go; null texts and items have no words."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: every document once, those of small sources again. A null source is a source."""
    return mix_rows(docs, max_epochs=MAX_EPOCHS).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; per document, read from them: doc_id, start, n_tokens, ids_crc32.

    Documents that mixing repeats follow one another; a null text would be its end id alone.
    """
    out = token_folder(spark)
    write_tokens(docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digest(spark, out)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", tokens),
]

#: The last stage's ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
