"""Queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import language_id, secret_scan
from quillstone.llm.bpe import bpe_encode
from quillstone.llm.fingerprints import document_fingerprints, folding_sql
from quillstone.llm.frames import materialise, table
from quillstone.llm.license_scan import license_scan
from quillstone.llm.mpegts import multiplex_table, transport_streams
from quillstone.llm.simhash_dedup import near_duplicates
from quillstone.llm.slack_pack import pack_min_slack
from quillstone.llm.suffix_dedup import repeated_passages
from quillstone.llm.token_pack import pack_best_fit


#: Where the public vocabularies lie; read on the driver only.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "word_start", "word_stop", "first")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media, so each page is multiplexed first: html and url as two streams."""
    return transport_streams(multiplex_table(table(spark, sf_dir, "pages"), "page_id", "html", "url"), "page_id", "ts", payload=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "kept")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run, whose ledger is written for the next."""
    scan = secret_scan.secret_scan(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    materialise(scan.ledger, "ledger")
    return scan.findings


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_min_slack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_media_columns": op3_media_columns,
    "op4_bpe": op4_bpe,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_token_output": op6_token_output,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
}

SQL = {
    "op2_document_fingerprints": f"""
        SELECT doc_id,
               CASE WHEN canon IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY canon) END AS group_id,
               CASE WHEN canon IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY canon) END AS group_size
        FROM (SELECT doc_id, {folding_sql("text")} AS canon FROM documents)""",
    "op7_secret_scan": secret_scan.oracle_sql(),
}
