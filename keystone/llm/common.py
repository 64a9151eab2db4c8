"""Scratch tables and the vectorised hashing shared by the text operators.

Hashes are polynomials modulo 2**64 over a fixed random table, evaluated with
prefix sums so that every word or window of a document costs one subtraction.
They are used over at most a few hundred symbols at a time; words of more than
``LONG_WORD`` bytes are hashed with BLAKE2 instead, where a polynomial modulo a
power of two would have structured collisions.
"""

from __future__ import annotations

import gc
import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystone.session import ensure_checkpoint_dir

LONG_WORD = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and reread it.

    This cuts lineage (a lost executor reruns tasks of one step only) and then
    lets the driver's JVM drop the shuffle files of the finished step.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(table: DataFrame) -> None:
    """Delete a scratch table that only steps already written have read."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, keys: DataFrame, on: list[str], total: int, most: int = 1000) -> DataFrame:
    """Inner join of ``rows`` to ``keys``, whose ``size`` says how many of the ``total`` rows each key has.

    At most ``most`` keys can hold over total / most rows: these are broadcast, so that
    their rows stay where they are. The rest is an ordinary join in which no key is hot.
    ``on`` columns are not null.
    """
    hot = F.col("size") > total / most
    crowded = F.broadcast(keys.where(hot))
    return rows.join(crowded, on).unionByName(
        rows.join(crowded.select(*on), on, "left_anti").join(keys.where(~hot), on))


def key_as_text(documents: DataFrame) -> DataFrame:
    """(doc_id string, text): ids pass through pandas as text, where null would turn them into floats."""
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (each input bit reaches each output bit)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept and grown per process)."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[base] = (out[0], out[1])
    p, q = _powers[base]
    return p[:n], q[:n]


def window_hashes(symbols: np.ndarray, w: int, base: int = _BASE) -> np.ndarray:
    """Hash of each run of ``w`` consecutive 64-bit symbols (empty if there are fewer)."""
    n = len(symbols)
    if n < w:
        return np.zeros(0, dtype=np.uint64)
    p, q = powers(n, base)
    c = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(symbols * p, out=c[1:])
    return mix((c[w:] - c[:-w]) * q[: n - w + 1])


def stretch_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each stretch [start, end) of 64-bit symbols, its length included."""
    p, q = powers(len(symbols) + 1, base)
    c = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * p[:-1], out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts] + mix((ends - starts).astype(np.uint64)))


def byte_symbols(data: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(data, dtype=np.uint8)]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def word_hashes(data: bytes, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each word of a text in UTF-8."""
    if starts is None:
        starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    p, q = powers(len(data))
    c = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_symbols(data) * p, out=c[1:])
    h = mix((c[ends] - c[starts]) * q[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least value of each ``w`` consecutive ones, by block prefix and suffix minima."""
    n = len(a)
    if n < w:
        return a[:0]
    if w == 1:
        return a
    padded = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, dtype=a.dtype)
    padded[:n] = a
    grid = padded.reshape(-1, w)
    pre = np.minimum.accumulate(grid, axis=1).ravel()
    suf = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def equal_runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of equal neighbours."""
    if not len(a):
        z = np.zeros(0, dtype=np.int64)
        return z, z
    s = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    return s, np.diff(np.concatenate([s, [len(a)]]))


def places(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, reach: int, keys: np.ndarray) -> np.ndarray:
    """1, or 2 if a run's key is at two places or more in the run itself (as in periodic texts).

    A run covers the grams from its start to ``reach`` beyond its last window start.
    """
    out = np.ones(len(starts), dtype=np.int64)
    s = np.sort(grams)
    if len(again := s[1:][s[1:] == s[:-1]]):
        for i in np.flatnonzero(np.isin(keys, again)):
            out[i] = min(2, int((grams[starts[i]:starts[i] + sizes[i] + reach] == keys[i]).sum()))
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of length ``n``, true inside any [start, end)."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def utf8(text) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return text.encode("utf-8") if isinstance(text, str) else b""
