"""Exact dedup by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical after white space is taken out. Rows are
grouped by the length of that normalised text, then by a hash of its head, then
by the digest of the whole; rows that are alone at one level never reach the next.
The normalised length needs the whole text and every row is returned with its
digest, so each text is read once, in one narrow scan that shuffles none of it;
the levels then read one small column after another, the digest only of rows
that share length and head.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import attach, discard, scratch_table

#: Fixed value: the characters that don't count.
BLANK = r"[\x20\x09-\x0D]+"
#: Code points of the normalised text that the second level hashes.
HEAD = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def _shared(rows: DataFrame, on: list[str]) -> DataFrame:
    """Keys that two rows or more have, with their number ``size``."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def exact_duplicates(documents: DataFrame, head: int = HEAD) -> DataFrame:
    """``documents`` (doc_id, text) to (doc_id, keep_id, group_size, kept, text_sha256), one row each.

    Of equal texts the row with the most code points in its original text stays,
    then the one with the smallest doc_id (null ids last), then any one of rows that repeat
    an id. Null and empty texts, and those of white space alone, are equal to each
    other. Rows that repeat a doc_id are rows of their own: each counts, one is
    kept. ``text_sha256`` is the lowercase hex digest of the normalised text in
    UTF-8. Other columns are ignored; an empty table gives an empty result. A group
    of any size is a sum and a least row, both made before rows are shuffled.
    """
    bare = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), normalised(F.col("text")).alias("bare"))
    rows = scratch_table(bare.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "chars", F.length("bare").alias("length"),
        F.xxhash64(F.substring("bare", 1, head)).alias("head"), F.sha2("bare", 256).alias("digest")), "exact-rows")
    total = rows.count()
    by_length = scratch_table(_shared(rows, ["length"]), "exact-lengths")
    same_length = attach(rows.select("length", "head"), by_length, ["length"], total)
    by_head = scratch_table(_shared(same_length.drop("size"), ["length", "head"]), "exact-heads")
    level = ["length", "head", "digest"]
    same_head = scratch_table(attach(rows, by_head, ["length", "head"], total).drop("size"), "exact-candidates")

    least = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    groups = scratch_table(same_head.groupBy(*level).agg(F.count(F.lit(1)).alias("size"), least.alias("keep")).where("size > 1"), "exact-groups")
    copies = attach(same_head.select("uid", "doc_id", *level), groups, level, total).select(
        "uid", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("uid") == F.col("keep.uid")).alias("kept"), F.col("digest").alias("text_sha256"))
    copies = scratch_table(copies, "exact-copies")
    alone = rows.join(copies.select("uid"), "uid", "left_anti").select(
        "uid", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("digest").alias("text_sha256"))
    for table in (by_length, by_head, same_head, groups):
        discard(table)
    return copies.unionByName(alone).drop("uid")
