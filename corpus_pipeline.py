"""A corpus pipeline of five stages: language, near duplicates, benchmark items, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; what it decides takes effect on what it returns.
run() writes what a stage returns to the shared folder and reads it again as the next stage's input, so a lost executor
costs at most the stage at hand. All stages but the last return the columns of documents.

Defined results, stage by stage: a null or empty text, or one without letters, goes in the first stage; a null id is no
reason for a row to go or to stay, in any stage, and rows that share an id are judged by their own texts; repeated rows are
copies, of which the second stage keeps one; of equally good languages the alphabetically first is filled in; further
columns of documents, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, language_id, near_dedup, pii, sentencepiece_codec
from quern.llm.queries import table, tokenizer_path
from quern.llm.shared import Workspace

#: A text stays if at least this share of its letters is in one of the learned languages.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or with no language of at least LEAST_SCORE of the letters, go; missing labels are filled in. Where no row has a label and a text, no language is known and all rows stay."""
    if docs.where("lang is not null and text is not null").isEmpty():
        return docs
    # the rows travel as one column: docs may have columns with the operator's names
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("quern_row"), F.col("text"))
    found = language_id.identify(given, docs, drop=("text",))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.coalesce("quern_row.lang", "lang_pred").alias(c) if c == "lang" else F.col("quern_row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id stays, one without an id only if no row of the class has one."""
    return near_dedup.first_of_each_class(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold an item of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the names of their kinds; n_chars follows the text."""
    return pii.redact_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the ids of the text's pieces, and whether they decode to the text."""
    return sentencepiece_codec.encode_texts(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), round_trip=True, drop=("text",))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_items", benchmark_items),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: No stage can be said in SQL: trained models, min-hash classes and alignment are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for documents."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.write(name, stage(spark, docs, sf_dir))
    return docs
