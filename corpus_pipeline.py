"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's ``docs``.  Rows are told apart
by their place in that table, so repeated ids and null ids do no harm."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewloom.llm.common import id_remainder, prepare, read_table, scratch_path, stored
from reviewloom.llm.decontaminate import contamination
from reviewloom.llm.jaccard_join import jaccard_components
from reviewloom.llm.language_id import identify_languages
from reviewloom.llm.mixing import mixed_rows
from reviewloom.llm.queries import END_ID, TOKENIZER
from reviewloom.llm.token_store import encode_documents
from reviewloom.operators.joins import bounded_broadcast

ROW = "__row"
#: Row numbers (8 bytes each) that are broadcast at most.
MOST_BROADCAST_ROWS = 1 << 20


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows numbered in ``gone`` (id), which are few as a rule: up to
    MOST_BROADCAST_ROWS their numbers go to the texts, beyond that both are shuffled."""
    gone = bounded_broadcast(stored(gone.select(F.col("id").alias(ROW)), "gone"), MOST_BROADCAST_ROWS)
    return _numbered(docs).join(gone, ROW, "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or unlike all learned languages.

    Models learn from rows with a language, but for every fourth by crc32 of the id."""
    prepare(spark)
    rows = _numbered(docs).withColumn("__learn", id_remainder(F.col("doc_id"), 4) != 2)
    found = identify_languages(rows, F.col("__learn"), id_col=ROW)
    return _without(docs, found.filter("rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group over links of Jaccard similarity 0.8 on five-word shingles.

    The smallest doc_id stays (a null one only if there is no other; of repeated ids the first row)."""
    prepare(spark)
    groups = jaccard_components(_numbered(docs), id_col=ROW, n=5, num=80, den=100).select("id", "component_id")
    ids = _numbered(docs).select(F.col(ROW).alias("id"), "doc_id").join(groups, "id")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("f"))
    return _without(docs, ids.join(first, "component_id").filter("id != f.id").select("id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in windows of benchmark items."""
    prepare(spark)
    found = contamination(_numbered(docs), read_table(spark, sf_dir, "benchmark", "item_id", "text"), id_col=ROW)
    return _without(docs, found.filter("contaminated").select("id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix by weights 1, 2, 3 takes them."""
    prepare(spark)
    return mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the token files."""
    prepare(spark)
    return encode_documents(docs, TOKENIZER, END_ID, special=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

#: Language models and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
