"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Native DataFrame operations only.  Each step groups only what the step before left in a group of two or
more, and the full content is hashed for those groups alone.  Groups are counted with partial aggregation
on (key, doc_id) first, so a group that holds a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import small_side, text_or_empty

#: Characters that the second step hashes.
PREFIX_CHARS = 256


def _suspects(docs: DataFrame, prefix_chars: int) -> DataFrame:
    """(length, prefix hash) pairs that at least two rows share."""
    narrow = docs.select(
        F.octet_length(text_or_empty()).alias("len"),
        F.xxhash64(F.substring(text_or_empty(), 1, prefix_chars)).alias("head"),
    )
    lengths = narrow.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len")
    return (
        narrow.join(small_side(lengths, "lengths"), "len", "left_semi")
        .groupBy("len", "head")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("len", "head")
    )


def _decided(docs: DataFrame, prefix_chars: int, hash_all: bool) -> DataFrame:
    """(row, keep_id, group_size, kept, full_hash, kept_rows): row holds all columns of ``docs``, so none can clash."""
    keys = small_side(_suspects(docs, prefix_chars).withColumn("suspect", F.lit(True)), "suspects")
    full = F.sha2(F.coalesce("row.text", F.lit("")), 256)
    marked = (
        docs.select(
            F.struct(*docs.columns).alias("row"),
            F.octet_length(text_or_empty()).alias("len"),
            F.xxhash64(F.substring(text_or_empty(), 1, prefix_chars)).alias("head"),
        )
        .join(keys, ["len", "head"], "left")
        .select("row", "suspect", (full if hash_all else F.when(F.col("suspect"), full)).alias("full_hash"))
    )
    groups = (
        marked.where("suspect")
        .groupBy("full_hash", F.col("row.doc_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("full_hash")
        .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", "id").alias("kept_rows"))
        .where("group_size > 1")
    )
    keep = F.when(F.col("group_size").isNull(), F.col("row.doc_id")).otherwise(F.col("keep_id"))
    return marked.join(small_side(groups, "groups"), "full_hash", "left").select(
        "row",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("row.doc_id")).alias("kept"),
        "full_hash",
        F.coalesce("kept_rows", F.lit(1)).cast("long").alias("kept_rows"),
    )


_RESULTS = ("keep_id", "group_size", "kept", "full_hash", "kept_rows")


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, hash_all: bool = False) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and full_hash.

    Texts are equal when identical after no change; a null text counts as empty.  The row with the largest
    doc_id stays.  A row whose doc_id is null stays only in a group without any id.  Rows that repeat both
    doc_id and text are one document given twice: both carry the same decision and both count in
    group_size (``kept_rows`` tells how many rows carry kept_id).  full_hash (SHA-256, lower-case hex) is
    null for rows that the cheaper steps have settled, unless ``hash_all``.  Texts of any length are only
    hashed.  Any further columns of ``docs`` pass through; of those that have the name of a result column,
    the result's stays.
    """
    own = [c for c in docs.columns if c not in _RESULTS]
    return _decided(docs, prefix_chars, hash_all).select(*[F.col("row").getField(c).alias(c) for c in own], *_RESULTS)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with their own columns, whatever their names.

    Where the row that stays is given more than once, or a group has no id at all, one row stays: of rows
    that differ in further columns, the one whose columns come first as JSON text.
    """
    kept = _decided(docs, PREFIX_CHARS, False).where("kept")
    again = (F.col("group_size") > 1) & ((F.col("kept_rows") > 1) | F.col("row.doc_id").isNull())
    repeated = kept.where(again).groupBy("full_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.where(~again).select("row").unionByName(repeated.select("row")).select("row.*")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, hash_all=True).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256")
    )


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
