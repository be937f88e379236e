"""Documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``; other columns of ``docs``, whatever their names, are dropped.
Rows are judged one by one: repeated rows stay apart, a null doc_id is an id like any
other that sorts last, whole texts are read however long, and an empty table gives an
empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, lang_id, packing, simhash, substring
from siltstone.llm.queries import BYTE_BPE
from siltstone.session import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: a null or empty text, and one without letters. A null lang is
    filled in; with no lang to learn from at all, every document goes."""
    model = lang_id.fit(docs.filter(lang_id.is_training()).select("text", "lang"))
    known = lang_id.predict(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != "und")
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of smallest doc_id, of equal ids the first row. Texts
    without words are one group. ``docs`` must be a table, as rows are numbered by their place."""
    return simhash.keep_one(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of smaller doc_id holds are taken out of the texts, and n_chars
    follows. A document that loses all its words goes; a null or short text stays as it is, and so does what rows of
    equal doc_id share. ``docs`` must be a table."""
    return substring.without_repeats(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, with all rows of the same doc_id; a text without words stays. An empty ``benchmark``
    takes nothing."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. A null or empty text is its end id alone; pieces of equal length take each other's places in any order."""
    return packing.pack_documents(docs.select(*COLUMNS), BYTE_BPE)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn a model and encode with a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate results are Parquet files in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
