"""A training corpus from raw documents in five stages, each one of the operators of ``fieldcal.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcal.llm.bpe import bpe
from fieldcal.llm.jaccard_join import keep_one
from fieldcal.llm.line_dedup import line_dedup
from fieldcal.llm.mixing import mixed
from fieldcal.llm.quality import keep_good
from fieldcal.llm.scratch import saved

#: Documents of a lower score go; shingles of so many words and so high a similarity make near copies.
LEAST_QUALITY = 0.3
SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
VOCABULARY = "byte_bpe_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY, label_col="quality")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share stay once; ``n_chars`` follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs, SHINGLE_WORDS, *SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their byte offsets; the decoded bytes are compared with the text by hash."""
    text = F.make_valid_utf8(F.coalesce("text", F.lit(""))).cast("binary")
    marked = docs.select("doc_id", "source", "text", F.xxhash64(text).alias("mark"))
    coded = bpe(marked, public_tokenizers.path(VOCABULARY), keep=("doc_id", "source", "mark"))
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets",
        (F.xxhash64("decoded") == F.col("mark")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encoded),
]

#: The classifier cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
