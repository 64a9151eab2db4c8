"""Token ids in files coded with a static range asymmetric numeral system.

One frequency table, counted over all documents, codes every block. A block
holds up to ``BLOCK_IDS`` ids in ``LANES`` interleaved states that share one
stream of 16-bit words, and every ``CHECKPOINT`` steps it notes the states and
the place in the stream, so any stretch of a block can be decoded by itself.
Header, checkpoints and stream are covered by one CRC-32, the decoded ids by another.

Block bytes, little-endian:
    8s   magic "RANSBLK1"      u32 ids         u32 lanes     u32 steps between checkpoints
    u32  crc32 of the ids as unsigned 32-bit  u32 checkpoints  u32 words in the stream
    checkpoints x (u32 words used, lanes x u32 state)
    words x u16                u32 crc32 of all bytes before
Blocks lie in the rows of Parquet files written by Spark (part, block, n_ids,
payload, each with the list of its documents), beside
``frequencies`` (id, freq; -1 is the escape), so a failed task leaves no half file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystone.llm.common import discard, key_as_text, scratch_table
from keystone.llm.tokens import LibraryEncoder, batches_of, default_vocabulary, encoder
from keystone.session import ensure_checkpoint_dir

MAGIC = b"RANSBLK1"
LANES = 2048
CHECKPOINT = 32
BLOCK_IDS = 1 << 18
#: Bits of the scaled frequencies; states lie in [2**16, 2**32) and give or take 16 bits at a time.
SCALE_BITS = 16
SCALE = 1 << SCALE_BITS
LOW = 1 << 16
HEAD = struct.Struct("<8sIIIIII")


class FrequencyTable:
    """Scaled frequencies of ids, summing to ``SCALE``; other ids are an escape and 16 plain bits.

    ``ids`` and ``freq`` are aligned; the last symbol is the escape.
    """

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        assert len(freq) == len(ids) + 1 and int(freq.sum()) == SCALE and (freq > 0).all()
        self.ids, self.freq = ids.astype(np.int64), freq.astype(np.uint32)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint32)
        self.escape = len(ids)
        self.symbol = np.full(LOW, self.escape, dtype=np.int64)
        self.symbol[self.ids] = np.arange(len(ids))
        self.at_slot = np.repeat(np.arange(len(freq)), freq)

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> FrequencyTable:
        """Scale counts of the ids 0..65535; ids that would get less than half a slot share the escape."""
        total = max(1, int(counts.sum()))
        kept = np.flatnonzero(counts * (2 * SCALE) >= total)
        rest = total - int(counts[kept].sum())
        weight = np.append(counts[kept], max(rest, 1)).astype(np.float64)
        freq = np.maximum(1, np.floor(weight * (SCALE - len(weight)) / weight.sum())).astype(np.int64)
        freq[np.argmax(freq)] += SCALE - int(freq.sum())
        return cls(kept, freq)


def encode_block(ids: np.ndarray, table: FrequencyTable, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    """Code ids below 65536. The coder runs backwards so that the decoder runs forwards."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    sym = table.symbol[ids]
    freq, start = table.freq[sym], table.start[sym]
    state = np.full(lanes, LOW, dtype=np.uint32)
    words: list[np.ndarray] = []  # in coding order; reversed at the end
    used, notes = 0, []
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        esc = np.flatnonzero(sym[a:b] == table.escape)
        out = []
        if len(esc):  # the decoder reads the plain words of a step after its states' words
            out.append(ids[a:b][esc[::-1]].astype(np.uint16))
        high = x >> np.uint32(16)
        full = high >= f                     # x >= f << 16 without leaving 32 bits
        if full.any():
            out.append(x[full][::-1].astype(np.uint16))
            x = np.where(full, high, x)
        q = x // f
        state[: b - a] = (q << np.uint32(SCALE_BITS)) + (x - q * f) + start[a:b]
        words += out
        used += sum(map(len, out))
        if s % checkpoint == 0:
            notes.append((used, state.astype(np.uint32)))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, dtype=np.uint16)
    notes = notes[::-1]
    raw = HEAD.pack(MAGIC, n, lanes, checkpoint, zlib.crc32(ids.astype("<u4").tobytes()), len(notes), len(stream))
    raw += b"".join(struct.pack("<I", used - u) + s.astype("<u4").tobytes() for u, s in notes)
    raw += stream.astype("<u2").tobytes()
    return raw + struct.pack("<I", zlib.crc32(raw))


def decode_block(raw: bytes, table: FrequencyTable, from_checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
    """Ids of a block, or of ``checkpoints`` stretches of it from one checkpoint on."""
    if len(raw) < HEAD.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("damaged block: checksum of its bytes")
    magic, n, lanes, every, crc, marks, size = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a block")
    if not n:
        return np.zeros(0, dtype=np.uint32)
    at = HEAD.size + from_checkpoint * 4 * (lanes + 1)
    used = struct.unpack_from("<I", raw, at)[0]
    state = np.frombuffer(raw, "<u4", lanes, at + 4).astype(np.uint32)
    stream = np.frombuffer(raw, "<u2", size, HEAD.size + marks * 4 * (lanes + 1))
    steps = -(-n // lanes)
    first = from_checkpoint * every
    last = steps if checkpoints is None else min(steps, first + checkpoints * every)
    out = np.empty(min(n, last * lanes) - first * lanes, dtype=np.uint32)
    ids = np.append(table.ids, 0).astype(np.uint32)
    for s in range(first, last):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        x = state[: b - a]
        slot = x & np.uint32(SCALE - 1)
        sym = table.at_slot[slot]
        x = table.freq[sym] * (x >> np.uint32(SCALE_BITS)) + slot - table.start[sym]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint32(16)) | stream[used:used + len(low)]
        used += len(low)
        state[: b - a] = x
        got = ids[sym]
        esc = np.flatnonzero(sym == table.escape)
        got[esc] = stream[used:used + len(esc)]
        used += len(esc)
        out[a - first * lanes:b - first * lanes] = got
    if from_checkpoint == 0 and last == steps and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block: checksum of its ids")
    return out


def token_ids(documents: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of whole texts with the end id, as little-endian uint16."""
    def run(batches):
        enc = encoder(LibraryEncoder, path)
        end = np.array([end_id], dtype="<u2").tobytes()
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in batches_of(texts):
                raw = [r + end for r in enc.encode_batch(texts[a:b])]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b], "n_tokens": [len(r) // 2 for r in raw], "ids": raw})
    out = key_as_text(documents).mapInPandas(run, "doc_id string, n_tokens long, ids binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _counts(batches):
    total = np.zeros(LOW, dtype=np.int64)
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            raw = b"".join(pdf["ids"].iloc[at:at + 1000])
            total += np.bincount(np.frombuffer(raw, "<u2"), minlength=LOW)
    ids = np.flatnonzero(total)
    yield pd.DataFrame({"id": ids.astype(np.int32), "n": total[ids]})


BLOCKS = ("part int, block int, n_ids long, payload binary, "
          "docs array<struct<seq:long,doc_id:string,n_tokens:long,whole:boolean>>")


def _blocks(ids: np.ndarray, freq: np.ndarray):
    """Documents of a partition, in order, to its blocks."""
    def run(batches):
        table = FrequencyTable(ids, freq)
        held, size, block, seq, part = [], 0, 0, 0, 0

        def flush():
            nonlocal held, size, block
            whole = np.concatenate([x for *_, x in held])
            docs = [{"seq": s, "doc_id": d, "n_tokens": len(x), "whole": w} for s, d, w, x in held]
            out = pd.DataFrame({"part": [part], "block": [block], "n_ids": [len(whole)],
                                "payload": [encode_block(whole, table)], "docs": [docs]})
            held, size, block = [], 0, block + 1
            return out

        for pdf in batches:
            for doc, raw, p in zip(pdf["doc_id"], pdf["ids"], pdf["part"], strict=True):
                part, x, a = p, np.frombuffer(raw, "<u2"), 0
                while a < len(x):
                    take = min(len(x) - a, BLOCK_IDS - size)
                    held.append((seq, doc, take == len(x), x[a:a + take]))
                    a, size = a + take, size + take
                    if size == BLOCK_IDS:
                        yield flush()
                seq += 1
        if held:
            yield flush()
    return run


def write_token_files(documents: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 2) -> str:
    """Write the ids of ``documents`` in ascending doc_id order; returns the folder.

    Null and empty texts are written as the end id alone. Null ids come first;
    rows that repeat a doc_id follow one another, shorter ones first. A document
    longer than what is left of a block goes on in the next one. Other columns are
    ignored; an empty table gives files without rows.
    """
    spark = documents.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokens = scratch_table(token_ids(documents, vocabulary or default_vocabulary(), end_id), "token-ids")
    # at most 65536 rows: one for each id
    counts = tokens.select("ids").mapInPandas(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_id = np.zeros(LOW, dtype=np.int64)
    by_id[counts["id"].to_numpy()] = counts["n"].to_numpy()
    table = FrequencyTable.from_counts(by_id)
    freq = pd.DataFrame({"id": np.append(table.ids, -1), "freq": table.freq.astype(np.int64)})
    spark.createDataFrame(freq, "id long, freq long").coalesce(1).write.parquet(f"{path}/frequencies")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = tokens.repartitionByRange(n, "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "ids")
    rows = placed.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "ids") \
        .mapInPandas(_blocks(table.ids, table.freq.astype(np.int64)), BLOCKS)
    rows.write.option("compression", "none").parquet(f"{path}/blocks")
    discard(tokens)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode a folder: (doc_id, start, n_tokens, ids_crc32), one row for each document written."""
    # at most 65537 rows
    freq = spark.read.parquet(f"{path}/frequencies").toPandas().sort_values("id")
    ids, scaled = np.append(freq["id"].to_numpy()[1:], -1)[:-1], np.append(freq["freq"].to_numpy()[1:], freq["freq"].to_numpy()[0])
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # one row for each part, whatever the number of ids
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("offset"))

    def run(batches):
        table = FrequencyTable(ids, scaled)
        for pdf in batches:
            for part, block, payload, docs in zip(pdf["part"], pdf["block"], pdf["payload"], pdf["docs"], strict=True):
                raw = decode_block(payload, table).astype("<u4")
                sizes = np.array([d["n_tokens"] for d in docs])
                ends = np.cumsum(sizes)
                if len(raw) != ends[-1]:
                    raise ValueError("a block's ids and documents differ in number")
                whole = np.array([d["whole"] for d in docs])
                cut = [raw[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                yield pd.DataFrame({"part": part, "block": block, "seq": [d["seq"] for d in docs],
                                    "doc_id": [d["doc_id"] for d in docs], "at": ends - sizes, "n_tokens": sizes,
                                    "whole": whole, "ids_crc32": [zlib.crc32(c) for c in cut],
                                    "ids": [None if w else c for w, c in zip(whole, cut, strict=True)]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "start": [pdf["start"].min()], "n_tokens": [pdf["n_tokens"].sum()],
                             "ids_crc32": [zlib.crc32(b"".join(pdf["ids"]))]})

    # each block is decoded once; only the shares of documents that a block's end cuts keep their ids
    shares = scratch_table(blocks.mapInPandas(run, "part int, block int, seq long, doc_id string, at long, n_tokens long, whole boolean, "
                                                   "ids_crc32 long, ids binary"), "token-shares")
    placed = shares.join(offsets, ["part", "block"]).join(base, "part") \
        .withColumn("start", F.col("base") + F.col("offset") + F.col("at"))
    out = ["doc_id", "start", "n_tokens", "ids_crc32"]
    # a document cut by a block's end: its shares, of one text, meet again
    cut = placed.where("not whole").groupBy("part", "seq").applyInPandas(
        joined, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return placed.where("whole").select(*out).unionByName(cut).withColumn("doc_id", F.col("doc_id").cast("long"))


def token_file_index(documents: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files of ``documents`` to the shared folder and read them back."""
    return read_token_files(documents.sparkSession, write_token_files(documents, None, vocabulary, end_id))
