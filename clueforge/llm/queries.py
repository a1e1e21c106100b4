"""The queries of this subpackage, each a thin application of its operator to a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.llm import decontaminate, hard_negatives, jaccard_join, language_id, lm_scoring, merkle_manifest, pii_scan, secret_scan, topk_search, vector_packing, warc_derive
from clueforge.llm.bpe_codec import encode_decode
from clueforge.llm._text import training_row
from clueforge.llm.token_counts import count_tokens
from clueforge.session import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive.derive(warc_derive.responses_of_pages(table(spark, sf_dir, "pages")), ("page_id",))


def language_model(docs: DataFrame) -> dict:
    """The language model of a corpus, from the labelled rows that are not held out."""
    return language_id.train(docs.where(training_row("doc_id", 4, 2)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keep = {"doc_id": F.col("doc_id"), "held_out": ~training_row("doc_id", 4, 2)}
    return language_id.predict(docs, language_model(docs), keep)


def secret_model(docs: DataFrame) -> secret_scan.Scanner:
    """Models of generated random strings, and of identifiers and the tokens of all texts."""
    return secret_scan.fit(docs)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secret_model(docs)
    return secret_scan.scan(docs, model.table, least_each=model.least_each)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), decontaminate.item_parts(table(spark, sf_dir, "benchmark")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = training_row("doc_id", 7, 2)
    return lm_scoring.score(docs, lm_scoring.train(docs.where(learn)), ~learn)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op10_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan.scan(table(spark, sf_dir, "documents"), pii_scan.train(spark))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op3_warc_derive": op3_warc_derive,
    "op2_language_id": op2_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op6_decontaminate": op6_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_pii_scan": op10_pii_scan,
    "op11_packing": op11_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": topk_search.oracle_sql(),
    "op3_warc_derive": warc_derive.oracle_sql(),
    "op6_decontaminate": decontaminate.oracle_sql(),
    "op7_jaccard_join": jaccard_join.oracle_sql(),
    "op12_hard_negatives": hard_negatives.oracle_sql(),
    "op13_merkle_manifest": merkle_manifest.oracle_sql(),
}
