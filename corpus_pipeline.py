"""The corpus pipeline: documents to packed training windows, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import language_id, secret_scan
from quillstone.llm.frames import materialise, table, unpack_row, with_rows
from quillstone.llm.queries import TOKENIZER
from quillstone.llm.simhash_dedup import near_duplicates
from quillstone.llm.slack_pack import pack_min_slack
from quillstone.llm.suffix_dedup import cut_repeats, repeated_passages


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows an edited text."""
    if "n_chars" not in docs.columns:
        return docs
    return unpack_row(docs, with_rows(docs, text="text"), "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are near to no language's centroids, or have no letter.

    Null and empty texts go, as they have none. Each row is judged by its whole
    text, whatever its id; repeated rows alike. The model is fitted on the
    stage's own input; without labels, or rows, all documents go.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group.

    A document is an id and a text: different texts under one id, or without
    one, are judged apart; rows that repeat both, null ids included, count as
    copies, and one of them stays. Of a group the document of the least id
    stays (null ids last), then of the least text hash, then of the least row
    hash. Null and empty texts, and those without a letter or digit, all stay.
    An empty table stays empty. The texts of rows that go aren't compared again.
    """
    found = near_duplicates(docs).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "kept", "copies")
    d = with_rows(docs, id="doc_id", text="text").select("row", "id", F.xxhash64("text").alias("key"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])
    found = materialise(found, "near")
    gone, several = found.filter("NOT kept OR copies > 1"), found.filter("kept AND copies > 1")
    whole = d.join(gone, same(d, gone), "left_anti").select("row")
    repeated = d.join(several, same(d, several), "left_semi").groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return unpack_row(docs, whole.unionByName(repeated))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the first occurrence of each passage of 50 words or more that repeats.

    First by id (null ids first), then by text hash and place. Rows equal in id
    and text are one document here and stay alike. Null, empty and shorter
    texts stay as they are; a document of which nothing is left goes. Passages
    are searched in whole texts of any length.
    """
    return _sized(cut_repeats(docs, repeated_passages(docs)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its rule's name; all rows stay.

    Null and empty texts stay as they are; repeated rows and ids are edited
    alike, each by its own text. Of overlapping secrets the first is named.
    """
    return _sized(secret_scan.redact(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048, filled by minimum bin slack: one row a window.

    Null and empty texts have no tokens and are in no window; repeated rows and
    null ids are packed like others; long texts are split without loss. An
    empty table has no windows.
    """
    return pack_min_slack(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

#: Models, fingerprints and packing are beyond SQL; the tests hold the stages against plain versions of what they do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
