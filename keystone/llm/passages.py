"""What word-window and byte-string deduplication share: row keys, repeated keys, removal spans.

A row is known by (k, h): its id, and a hash of its text. Rows that are alike in
both are alike in everything these operators decide, so repeated rows need no
key of their own; each still counts as an occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def with_row_key(documents: DataFrame) -> DataFrame:
    """Add k long and h long; a null id is ``NO_ID``, a null text hashes as one."""
    return documents.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("h", F.xxhash64("text"))


def repeated(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """The rows whose key occurs at least twice (a row counts ``weight`` times).

    Counts are summed before the shuffle and each key comes back once, so a key
    with a large share of the rows is one row on that side and splits on the other.
    """
    often = rows.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("n")).where("n > 1").drop("n")
    return rows.join(often, list(keys), "left_semi")


def per_row(spans: DataFrame, *fields: str) -> DataFrame:
    """(k, h, spans): the distinct spans of each row, in order."""
    return spans.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("spans"))


def other_columns(documents: DataFrame):
    """Struct ``row`` of all columns but the text, so that none can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("row")
