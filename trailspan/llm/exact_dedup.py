"""Exact dedup by progressive refinement: length, then a hash of the first characters, then the full hash.

Two texts are equal when they are the same after each run of ASCII white space became one
space. Only rows whose length and then whose head occur more than once take part in the full
hash: the others never leave the scan with their text. Every grouping is a sum or a minimum
that Spark combines before it shuffles, so a group with a third of all rows is a row per task;
the decisions go back to the rows by joins, which adaptive execution splits.

Defined cases: null text counts as empty. Rows with the same id and the same text are one
document stored more than once: all its rows get the same answer, each counts in
``group_size``. A null id is never the smallest unless all ids of the group are null; then
``keep_id`` is null and the rows stay. An empty table gives an empty result. Other columns of
the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters of the normalised text that the second step hashes.
HEAD_CHARS = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; single spaces are left alone, which is faster."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS, digest_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and with ``digest_col`` the SHA-256 of its normalised text.

    With ``digest_col`` the one scan hashes every text, and no text is shuffled. Without, ``docs`` should be a table that can be
    scanned twice: only rows that share length and head with another row are read again and hashed whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    digest = [F.sha2("t", 256).alias("full")] if digest_col else []
    narrow = written(rows.select("doc_id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, head_chars)).alias("head"), *digest), "exact-narrow")

    lengths = written(narrow.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select("n"), "exact-lengths")
    same_length = narrow.join(lengths, "n", "left_semi")
    # Keys of groups are written, so that a join deals both of its sides out itself and can split a hot key.
    heads = written(same_length.groupBy("n", "head").agg(F.count("*").alias("c")).where("c > 1").select("n", "head"), "exact-heads")
    same_head = same_length.join(heads, ["n", "head"], "left_semi")

    if digest_col:
        # The scan has hashed every text already, as asked: groups follow from the narrow rows, and no text is read again.
        out = narrow.join(_groups(same_head), ["n", "full"], "left")
    else:
        # Nulls do not meet in a join by equality; flag and value together do.
        wanted = same_head.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id")).distinct()
        read = rows.select("doc_id", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t")
        full = written(read.join(wanted, ["no_id", "id"], "left_semi").select(
            "doc_id", "no_id", "id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, head_chars)).alias("head"), F.sha2("t", 256).alias("full"),
        ), "exact-full")
        key = ["no_id", "id", "n", "head"]
        decided = full.join(_groups(full), ["n", "full"]).select(*key, "keep_id", "group_size").distinct()
        out = narrow.select("doc_id", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "n", "head").join(decided, key, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"),
        *([F.col("full").alias(digest_col)] if digest_col else []),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """n, full, keep_id, group_size of texts that several rows share, as a written table."""
    found = rows.groupBy("n", "full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return written(found, "exact-groups")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates of the whole documents table, with the digest of each normalised text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs, digest_col="text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
