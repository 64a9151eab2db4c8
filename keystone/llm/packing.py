"""Packing documents into sequences by the sum of squares.

Open sequences are counted per residual gap. A piece goes where the sum of the
squared counts becomes least: into an open sequence with one of the gaps, or a
new one. Pieces are dealt by a hash into groups of about ``group_pieces``, each
packed by one task, longest pieces first; only lengths and checksums are shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import key_as_text, scratch_table
from keystone.llm.tokens import LibraryEncoder, batches_of, default_vocabulary, encoder


def sum_of_squares_pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the order given (each 1..capacity).

    Ties go to the smallest gap that holds the piece.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; count[0] and count[capacity] stay 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        # change of the sum when gap g (size..capacity) turns into g - size: 2 (c[g - size] - c[g] + 1),
        # less what doesn't count: the bin that is full, and the gap that a new bin never had
        change = 2 * (count[: capacity - size + 1] - count[size:] + 1)
        open_ = count[size:] > 0
        change[0] = 1 - 2 * count[size]
        open_[-1] = True
        if size == capacity:
            gap = capacity
        else:
            change[-1] = 2 * count[capacity - size] + 1
            gap = size + int(np.argmin(np.where(open_, change, np.iinfo(np.int64).max)))
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        left = gap - size
        if left:
            stacks[left].append(b)
            count[left] += 1
        bins[k], offsets[k] = b, capacity - gap
    return bins, offsets


def pieces_of(documents: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with the end id, cut only when over ``capacity``."""
    def run(batches):
        enc = encoder(LibraryEncoder, vocabulary)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in batches_of(texts):
                rows = []
                for doc, raw in zip(pdf["doc_id"].iloc[a:b], enc.encode_batch(texts[a:b]), strict=True):
                    ids = np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        x = ids[start:start + capacity]
                        rows.append((doc, piece, start, len(x), zlib.crc32(x.tobytes())))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
    return key_as_text(documents).mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")


def pack_documents(documents: DataFrame, vocabulary: str | None = None, capacity: int = 4096, end_id: int = 1,
                   group_pieces: int = 50_000) -> DataFrame:
    """``documents`` (doc_id, text) to (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are the end id alone. Rows that repeat a doc_id are
    packed as documents of their own. Other columns are ignored; an empty table
    gives an empty result. Every id of every document is in exactly one piece.
    """
    pieces = scratch_table(pieces_of(documents, vocabulary or default_vocabulary(), capacity, end_id)
                           .withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True])
        b, offset = sum_of_squares_pack(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="uid").assign(sequence_id=pdf["group"].to_numpy() + b * groups, offset=offset).drop(columns="group")

    schema = ("doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    packed = pieces.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("group").applyInPandas(pack, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
