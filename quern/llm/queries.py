"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, decontaminate, language_id, near_dedup, pii, quality, repeats, sentencepiece_codec, token_store, url_filter
from .shared import Workspace, id_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 4) == 2
    found = language_id.identify(docs.select("doc_id", "text"), docs.where(~held_out), drop=("text",))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), id_remainder("doc_id", 10) == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), drop=("text",))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'tokens').path}/files"
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    token_store.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), definition, path)
    return token_store.read_tokens(spark, path)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), round_trip=True, drop=("text",))


QUERIES = {"op1_url_filter": op1_url_filter, "op2_language_id": op2_language_id, "op3_near_duplicates": op3_near_duplicates, "op4_pii": op4_pii, "op5_brown_lm": op5_brown_lm, "op6_token_files": op6_token_files, "op7_sentencepiece": op7_sentencepiece, "op8_quality": op8_quality, "op9_repeats": op9_repeats, "op10_decontaminate": op10_decontaminate}
#: The other operators train models, align or code; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_url_filter": url_filter.sql(), "op3_near_duplicates": near_dedup.sql(), "op9_repeats": repeats.sql()}
