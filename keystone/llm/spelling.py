"""Spelling variants: words one edit apart, found with a relational trie frontier.

The words form two tries, over their letters in reading order and in reverse; a
node is the hash of the letters before it. The trie is a distributed edge table:
(node, stretch of letters, node reached), where a stretch is the greatest power of
two that the rest of a word holds, or none at its end. The frontier is a table of (word, position,
node, edits) states that is joined with the edge table level by level.

A frontier starts with the states in the second half of a word that have made no
edit yet: their node is the word's own prefix. The edit is made with the first
join, by going on without a letter (deletion) or over edges of any letter
(replacement); after it the rest of the word must follow edges letter by letter,
the longest stretch first, so that a word of n letters takes at most 1 + log2(n)
levels. The reversed trie finds the edits in the first half. An insertion is the
other word's deletion. A state that reaches the end of another word with its own
rest used up makes the two neighbours. Hashes only choose what is compared: each
pair is verified with its letters.

Below half a word the tries are narrow, so states don't fan out over the letters
that follow short prefixes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystone.llm.common import discard, key_as_text, mix, powers, scratch_table

#: Fixed values of the contract: letters, and the lower case of A-Z alone.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words that a task counts before it hands partial counts on.
COUNTED = 200_000
#: Letters of the words that are hashed together.
BLOCK = 1 << 20
_STEP, _END, _ANY, _NODE, _BACK = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F


def add_words(held: Counter, text: str, doc_id: str, divisor: int) -> None:
    """Count the words of a text; of runs whose checksum with the id is a multiple of ``divisor``, one letter goes."""
    runs = LETTERS.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    held.update(runs)
    if divisor:
        seed = zlib.crc32(f"{doc_id}:".encode())
        times = runs if len(runs) < 10_000 else Counter(runs)
        for run in set(runs):
            h = zlib.crc32(run.encode("utf-8"), seed)
            if not h % divisor:
                n, at = times.count(run) if times is runs else times[run], h % len(run)
                held[run] -= n
                held[run[:at] + run[at + 1:]] += n


def word_counts(documents: DataFrame, divisor: int = 0, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words with ``least_letters`` code points and ``least_count`` occurrences in all documents."""
    def run(batches):
        held: Counter = Counter()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if isinstance(text, str):
                    add_words(held, text, doc_id if isinstance(doc_id, str) else "", divisor)
                if len(held) >= COUNTED:
                    yield from counted(held)
                    held = Counter()
        yield from counted(held)

    def counted(held):
        keep = [(w, n) for w, n in held.items() if n and len(w) >= least_letters]
        yield pd.DataFrame(keep, columns=["word", "n"])

    return key_as_text(documents).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= least_count)


def _wrapped(x: int) -> np.uint64:
    return np.uint64(x % (1 << 64))


class _Tries:
    """Hashes of the nodes and stretches of words of one length, in reading order or in reverse."""

    def __init__(self, letters: np.ndarray, backward: bool):
        self.length = letters.shape[1]
        self.p, self.q = powers(self.length + 1)
        self.seed = _BACK if backward else 0
        symbols = mix(letters.astype(np.uint64) + np.uint64(977))
        if backward:
            symbols = symbols[:, ::-1]
        self.sums = np.zeros((len(letters), self.length + 1), dtype=np.uint64)
        np.cumsum(symbols * self.p[: self.length], axis=1, out=self.sums[:, 1:])

    def node(self, depth: int) -> np.ndarray:
        return mix(self.sums[:, depth] + _wrapped(_NODE * (depth + 1) + self.seed))

    def stretch(self, at: int, size: int, free: bool = False) -> np.ndarray:
        """Letters [at, at + size), whether the word ends there, and whether a letter of any kind comes before."""
        kind = _STEP * (size + 1) + self.seed + _END * (at + size == self.length) + _ANY * free
        return mix((self.sums[:, at + size] - self.sums[:, at]) * self.q[at] + _wrapped(kind))


def _sizes(rest: int) -> list[int]:
    """Lengths of the stretches of a rest, the longest first; a rest of no letters is the word's end."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] or [0]


def _by_length(batches):
    """(word ids, letters as a matrix, backward) of words of equal length, about BLOCK letters at a time."""
    def blocks():
        words = pd.Series(held, dtype=object).to_numpy()
        sizes = np.array([len(w) for w in held], dtype=np.int64)
        for length in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == length)
            letters = np.frombuffer("".join(words[rows]).encode("utf-32-le"), dtype="<u4").reshape(len(rows), length)
            for backward in (False, True):
                yield np.array(wids, dtype=np.int64)[rows], letters, backward

    wids, held, size = [], [], 0
    for batch in batches:
        for wid, word in zip(batch.column("wid").to_pylist(), batch.column("word").to_pylist(), strict=True):
            wids.append(wid)
            held.append(word)
            size += len(word)
            if size >= BLOCK:
                yield from blocks()
                wids, held, size = [], [], 0
    yield from blocks()


class _Rows:
    """Columns of equal length, gathered piece by piece into record batches; ``rest`` is a matrix or absent."""

    def __init__(self, names: list[str], lists: bool):
        self.names, self.lists, self.parts, self.size = names, lists, [], 0

    def add(self, *columns, rest: list = ()):
        flat = np.stack(rest, axis=1) if rest else np.zeros((len(columns[0]), 0), dtype=np.int64)
        self.parts.append((*columns, flat))
        self.size += len(columns[0])
        if self.size >= 100_000 or len(self.parts) >= 4096:
            yield self.flushed()

    def flushed(self) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate([p[i] for p in self.parts] or [np.zeros(0, np.int64)])) for i in range(len(self.names))]
        names = list(self.names)
        if self.lists:
            counts = np.concatenate([np.full(len(p[0]), p[-1].shape[1]) for p in self.parts] or [np.zeros(0, np.int64)])
            values = np.concatenate([p[-1].ravel() for p in self.parts] or [np.zeros(0, np.int64)])
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values)))
            names.append("rest")
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, names)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _reached(t: _Tries, wid: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The node at a depth and -1, or 0 and the word that ends there."""
    if at == t.length:
        return np.zeros(len(wid), np.int64), wid
    return _signed(t.node(at)), np.full(len(wid), -1)


def _later(t: _Tries, at: int) -> list[np.ndarray]:
    """The stretches of the rest from ``at`` on, without the first."""
    sizes = _sizes(t.length - at)
    starts = (at + np.cumsum([0, *sizes[:-1]])).tolist()
    return [_signed(t.stretch(a, s)) for a, s in zip(starts[1:], sizes[1:], strict=True)]


def _second_half(t: _Tries, backward: bool) -> range:
    """Depths at which a word is edited in a trie; its first half is the reversed trie's second half."""
    return range(t.length - t.length // 2 if backward else t.length // 2, t.length)


def _edges(batches):
    """Edges (node, stretch, reached, ends) that follow the letters: from each depth the first stretch of the rest."""
    out = _Rows(["node", "stretch", "reached", "ends"], False)
    for wid, letters, backward in _by_length(batches):
        t = _Tries(letters, backward)
        for depth in range(t.length // 2, t.length + 1):
            size = _sizes(t.length - depth)[0]
            yield from out.add(_signed(t.node(depth)), _signed(t.stretch(depth, size)), *_reached(t, wid, depth + size))
    yield out.flushed()


def _replaced(batches):
    """(wid, node, stretch, via, reached, ends, rest): over any letter, to ``via``, and the first stretch after it.

    A row is both a state that is about to replace that letter and the edge that
    other words' states take.
    """
    out = _Rows(["wid", "node", "stretch", "via", "reached", "ends"], True)
    for wid, letters, backward in _by_length(batches):
        t = _Tries(letters, backward)
        for depth in _second_half(t, backward):
            size = _sizes(t.length - depth - 1)[0]
            yield from out.add(wid, _signed(t.node(depth)), _signed(t.stretch(depth + 1, size, True)), _signed(t.node(depth + 1)),
                               *_reached(t, wid, depth + 1 + size), rest=_later(t, depth + 1))
    yield out.flushed()


def _deleted(batches):
    """(wid, node, stretch, rest): states that go on without a letter, the last one of a run of equal letters."""
    out = _Rows(["wid", "node", "stretch"], True)
    for wid, letters, backward in _by_length(batches):
        t = _Tries(letters, backward)
        read = letters[:, ::-1] if backward else letters
        for depth in _second_half(t, backward):
            rows = np.flatnonzero(read[:, depth] != read[:, depth + 1]) if depth + 1 < t.length else np.arange(len(wid))
            size = _sizes(t.length - depth - 1)[0]
            yield from out.add(wid[rows], _signed(t.node(depth))[rows], _signed(t.stretch(depth + 1, size))[rows],
                               rest=[x[rows] for x in _later(t, depth + 1)])
    yield out.flushed()


def neighbours(words: DataFrame) -> DataFrame:
    """``words`` (wid long, word), distinct, to (a, b): ids of the words one edit apart, each pair once, a < b."""
    key = ["node", "stretch"]
    edges = words.mapInArrow(_edges, "node long, stretch long, reached long, ends long")
    edges = scratch_table(edges.repartition(*key).distinct(), "spelling-edges")
    # most prefixes and rests are those of one word: only where letters differ between them is there a state to follow
    group = Window.partitionBy(*key)
    replaced = words.mapInArrow(_replaced, "wid long, node long, stretch long, via long, reached long, ends long, rest array<long>") \
        .withColumn("differ", F.min("via").over(group) < F.max("via").over(group)).where("differ").drop("differ")
    replaced = scratch_table(replaced, "spelling-replaced")
    others = replaced.select(*key, F.col("via").alias("other"), F.col("reached").alias("to"), F.col("ends").alias("word")).distinct()
    edited = replaced.select("wid", *key, "via", "rest").join(others.hint("merge"), key).where("via <> other").select(
        "wid", F.col("to").alias("reached"), F.col("word").alias("ends"), "rest")
    deleted = words.mapInArrow(_deleted, "wid long, node long, stretch long, rest array<long>")
    level = scratch_table(edited.unionByName(deleted.join(edges.hint("merge"), key).select("wid", "reached", "ends", "rest")), "spelling-level")
    found, tables = [], [edges, replaced, level]
    while True:
        found.append(level.where("size(rest) = 0 and ends >= 0 and wid <> ends")
                     .select(F.least("wid", "ends").alias("a"), F.greatest("wid", "ends").alias("b")))
        going = level.where("size(rest) > 0 and ends < 0")
        if going.isEmpty():
            break
        states = going.select("wid", F.col("reached").alias("node"), F.col("rest")[0].alias("stretch"), F.expr("slice(rest, 2, size(rest))").alias("rest"))
        level = scratch_table(states.join(edges.hint("merge"), key).select("wid", "reached", "ends", "rest"), "spelling-level")
        tables.append(level)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    pairs = pairs.distinct()
    for side in "ab":
        pairs = pairs.join(words.select(F.col("wid").alias(side), F.col("word").alias(f"word_{side}")).hint("merge"), side)
    out = scratch_table(pairs.where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b"), "spelling-pairs")
    for table in tables:
        discard(table)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(wid, form id or null) to (wid, root): each round follows twice as many forms as the one before."""
    at = scratch_table(forms.select("wid", F.coalesce("form", "wid").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        after = scratch_table(at.join(step, "root").select("wid", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "spelling-roots")
        discard(at)
        at = after.select("wid", "root")
        at.scratch_path = after.scratch_path
        if after.where("moved").isEmpty():
            return at


def spelling_variants(documents: DataFrame, divisor: int = 0, least_letters: int = 5, least_count: int = 3, factor: int = 2) -> DataFrame:
    """``documents`` (doc_id, text) to (word, form, root, n, n_near, form_n), one row for each distinct word.

    Words are maximal runs of letters, A-Z in lower case, of at least
    ``least_letters`` code points and ``least_count`` occurrences overall. With a
    ``divisor``, runs whose checksum with the doc_id is a multiple of it lose one
    letter first. ``n_near`` counts the words that differ by exactly one inserted,
    deleted or replaced code point; ``form`` is the one of largest n (ties: smallest in
    code-point order) if its n is at least ``factor`` times the word's, else null;
    ``root`` is the last word that forms lead to (``factor`` over 1 excludes loops).
    Null and empty texts have no words; a null doc_id counts as an empty one; repeated
    rows are counted each; other columns are ignored; no words give an empty result.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    words = scratch_table(word_counts(documents, divisor, least_letters, least_count)
                          .withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
    pairs = neighbours(words.select("wid", "word"))
    near = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("wid").alias("b"), F.col("n").alias("n_b"), F.col("word").alias("word_b"))
    best = near.join(other, "b").groupBy(F.col("a").alias("wid")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("word_b").alias("word"), F.col("b").alias("wid"))).alias("best"))
    takes = -F.col("best.n") >= F.col("n") * factor
    judged = scratch_table(words.join(best, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.wid")).alias("form"),
        F.when(takes, F.col("best.word")).alias("form_word"), F.when(takes, -F.col("best.n")).alias("form_n")), "spelling-forms")
    roots = _roots(judged.select("wid", "form"))
    named = roots.join(words.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root").select("wid", "root_word")
    return judged.join(named, "wid").select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
