"""Removal of repeated word windows by level-wise doubling.

Windows are counted at a quarter of the wanted length first. Those that are
repeated, alone, go on to twice that length, and so on up to the length itself
or until none is left. At each level but the last, a wanted window is
represented by the least (by hash) of the shorter windows inside it: two equal
windows have equal parts, so nothing repeated is lost, and neighbours share
their representative, so a level counts a fraction of the positions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import (covered, discard, equal_runs, places, scratch_table, sliding_min, stretch_hashes, utf8,
                                 window_hashes, word_hashes, word_spans)
from keystone.llm.passages import other_columns, per_row, repeated, with_row_key

FIRST_BASE = 0xA0761D6478BD642F | 1
SECOND_BASE = 0xD1342543DE82EF95 | 1


def level_lengths(window: int) -> list[int]:
    """Doubling lengths that end at ``window``: 9, 18, 35 for 35."""
    out = [window]
    while len(out) < 3 and out[0] > 3:
        out.insert(0, -(-out[0] // 2))
    return out


def level_runs(words: np.ndarray, length: int, window: int, starts: np.ndarray | None):
    """Runs of window starts with the same representative: (first start, length of the run, key, places of the key)."""
    grams = window_hashes(words, length)
    least = sliding_min(grams, window - length + 1)
    if starts is None:
        s, n = equal_runs(least)
        return s, n, least[s], places(grams, s, n, window - length, least[s])
    value = least[starts]
    # a run ends where the starts have a gap, too
    s, n = equal_runs(value + (starts - np.arange(len(starts))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return starts[s], n, value[s], places(grams, starts[s], n, window - length, value[s])


def _expand(spans) -> np.ndarray:
    """Starts of all windows in runs (start, n)."""
    return np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in spans]))


def _first(length: int, window: int):
    """Runs of the first level, over all windows."""
    cols = ("k", "h", "start", "n", "key", "places")

    def run(batches):
        for pdf in batches:
            out = []
            for k, h, text in zip(pdf["k"], pdf["h"], pdf["text"], strict=True):
                words = word_hashes(utf8(text))
                if len(words) >= window:
                    s, n, key, at = level_runs(words, length, window, None)
                    out.append((np.full(len(s), k), np.full(len(s), h), s, n, key.view(np.int64), at))
            yield _frame(cols, out)
    return run


def _second(length: int, window: int):
    """Runs of the second level over candidates, each with two digests of all its words."""
    cols = ("k", "h", "start", "n", "key", "places", "c1", "c2")

    def run(batches):
        for pdf in batches:
            out = []
            for k, h, text, have in zip(pdf["k"], pdf["h"], pdf["text"], pdf["spans"], strict=True):
                words = word_hashes(utf8(text))
                s, n, key, at = level_runs(words, length, window, _expand(have))
                c1, c2 = (stretch_hashes(words, s, s + n + window - 1, b).view(np.int64) for b in (FIRST_BASE, SECOND_BASE))
                out.append((np.full(len(s), k), np.full(len(s), h), s, n, key.view(np.int64), at, c1, c2))
            yield _frame(cols, out)
    return run


def _whole(window: int):
    """All windows of the given runs, by two hashes."""
    cols = ("key", "c1", "c2", "offset", "w1", "w2", "places")

    def run(batches):
        for pdf in batches:
            out = []
            for text, runs in zip(pdf["text"], pdf["runs"], strict=True):
                words = word_hashes(utf8(text))
                w1, w2 = window_hashes(words, window), window_hashes(words, window, SECOND_BASE)
                for r in runs:
                    a, n = r["start"], r["n"]
                    out.append((*(np.full(n, r[c]) for c in ("key", "c1", "c2")), np.arange(n), w1[a:a + n].view(np.int64),
                                w2[a:a + n].view(np.int64), np.full(n, min(2, r["copies"]))))
            yield _frame(cols, out)
    return run


def _frame(cols, out) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(cols, map(np.concatenate, zip(*out, strict=True)), strict=True)) if out
                        else {c: np.zeros(0, np.int64) for c in cols})


def repeated_windows(documents: DataFrame, window: int = 35) -> DataFrame:
    """(k, h, spans): per row the runs (first word, number) of starts of windows that also start elsewhere.

    Rows without any are left out. Before the last level, runs that are equal in
    all their words collapse: one that is in several places is repeated as a
    whole, and only representatives with different runs go on to be compared
    window by window, one run of each kind, by 128 bits a window.
    """
    base = with_row_key(documents).select("k", "h", "text")
    quarter, half, _ = level_lengths(window)
    ident = ["key", "c1", "c2"]
    runs = scratch_table(base.mapInPandas(_first(quarter, window), "k long, h long, start int, n int, key long, places int"), "windows-1")
    found = scratch_table(per_row(repeated(runs, "key", weight="places"), "start", "n"), "window-candidates")
    discard(runs)
    # from here on only texts that still hold candidates are read
    held = scratch_table(base.join(found, ["k", "h"]), "window-texts")
    discard(found)
    runs = scratch_table(held.mapInPandas(_second(half, window), "k long, h long, start int, n int, key long, places int, c1 long, c2 long"),
                         "windows-2")
    kinds = scratch_table(runs.groupBy(*ident).agg(
        F.count("*").alias("copies"), F.sum("places").alias("places"), F.min(F.struct("k", "h", "start", "n")).alias("at")), "window-kinds")
    per_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("places").alias("all")).where(F.col("all") > 1)
    judged = kinds.join(per_key, "key")
    whole = (F.col("kinds") == 1) & (F.col("copies") > 1)
    alone = judged.where(whole).select(*ident, F.array(F.struct(F.lit(0).alias("a"), F.col("at.n").alias("n"))).alias("s"))
    asked = judged.where(~whole).groupBy("at.k", "at.h").agg(
        F.collect_list(F.struct("at.start", "at.n", *ident, "copies")).alias("runs"))
    windows = scratch_table(held.select("k", "h", "text").dropDuplicates(["k", "h"]).join(asked, ["k", "h"]).mapInPandas(
        _whole(window), "key long, c1 long, c2 long, offset int, w1 long, w2 long, places int"), "windows-3")
    hit = repeated(windows, "w1", "w2", weight="places").groupBy(*ident).agg(
        F.collect_list(F.struct(F.col("offset").alias("a"), F.lit(1).alias("n"))).alias("s"))
    placed = runs.select("k", "h", "start", *ident).join(alone.unionByName(hit), ident) \
        .select("k", "h", "start", F.explode("s").alias("s")).select("k", "h", (F.col("start") + F.col("s.a")).alias("start"), "s.n")
    out = scratch_table(per_row(placed, "start", "n"), "window-starts")
    for table in (held, runs, kinds, windows):
        discard(table)
    return out


def remove_repeated_windows(documents: DataFrame, window: int = 35, least: int = 12) -> DataFrame:
    """Each row as (row struct of its other columns, text, n_words, n_removed, kept_text, removed).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word covered by a window of
    ``window`` words that also starts anywhere else, in the same document or
    another, is removed; windows are judged on the input. ``kept_text`` joins the
    kept words by one space and ``removed`` lists the removed runs as (start, end)
    in words. Null and empty texts have no words, shorter texts lose none, rows
    that repeat another lose all that their windows cover. An empty table gives an
    empty result.
    """
    if window < least:
        raise ValueError(f"a window has {least} words at least")
    keyed = documents.select(other_columns(documents), "doc_id", "text")
    joined = with_row_key(keyed).join(repeated_windows(documents.select("doc_id", "text"), window), ["k", "h"], "left")

    def run(batches):
        for pdf in batches:
            n_words, n_removed, kept, runs = [], [], [], []
            for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
                data = utf8(text)
                a, b = word_spans(data)
                gone = np.zeros(len(a), dtype=bool)
                if spans is not None:
                    s = _expand(spans)
                    gone = covered(len(a), s, s + window)
                n_words.append(len(a))
                n_removed.append(int(gone.sum()))
                words = data.split()
                kept.append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if spans is not None else words).decode("utf-8"))
                at, size = equal_runs(gone)
                runs.append([{"start": int(x), "end": int(x + y)} for x, y in zip(at, size, strict=True) if gone[x]])
            yield pd.DataFrame({"row": pdf["row"], "text": pdf["text"], "n_words": n_words, "n_removed": n_removed, "kept_text": kept, "removed": runs})

    row = documents.select(other_columns(documents)).schema["row"].dataType.simpleString()
    return joined.select("row", "text", "spans").mapInPandas(
        run, f"row {row}, text string, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")


def passage_digest(documents: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``remove_repeated_windows``, one row each."""
    out = remove_repeated_windows(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), window).drop("text")
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
