"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. Per language, each piece has a
probability learned from the training texts; the probability of a word is the
sum over all its segmentations into pieces, by a forward pass over the word's
characters. Pieces never cross words, so a text's log-probability is the sum
over its words, and each distinct word of a batch is scored once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import mix, powers, window_hashes

#: Letters, and the numbers that ``\\w`` takes for words without being letters or decimal digits, such as fractions.
RUN = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Words of more symbols, the mark included, go through the forward pass one at a time and rescaled.
BATCHED = 24
MAX_WORDS = 400_000
#: Of the bounds of ``fit``; the second in log-probability a letter.
FIT_SPREADS, LEAST_SPREAD = 8.0, 1.0


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, in lower case."""
    runs = RUN.findall(text.lower())
    if "".join(runs).isalpha():
        return runs
    return [w for r in runs for w in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]


class Pieces:
    """The pieces of a SentencePiece model that can be part of a word, with their hashes in order."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.index: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            body = p[1:] if p.startswith(MARK) else p
            if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i) and (p == MARK or body.isalpha()):
                self.index[p.lower()] = self.index.get(p.lower(), len(self.index))
        self.longest = max(map(len, self.index))
        hashes = np.array([int(window_hashes(symbols([p])[0], len(p))[0]) for p in self.index], dtype=np.uint64)
        self.of_hash = np.argsort(hashes)
        self.hashes = hashes[self.of_hash]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 without one."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.of_hash[at], -1)


def symbols(words: list[str]) -> np.ndarray:
    """Characters of words of one length as rows of 64-bit symbols."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1)
    return mix(code.astype(np.uint64) + np.uint64(1))


_loaded: dict[str, Pieces] = {}


def load_pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Scorer:
    """Forward algorithm over the log-probabilities of languages (one row each, last column: a letter without a piece).

    Every word goes through it whole, short ones of one length together. Scores of words met before are kept,
    up to ``MAX_WORDS``; then the memory starts afresh.
    """

    def __init__(self, pieces: Pieces, log_p: np.ndarray):
        self.pieces, self.p = pieces, np.ascontiguousarray(np.exp(log_p.T))
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, self.p.shape[1]))

    def word(self, word: str) -> np.ndarray:
        """Log of the summed probability of all segmentations, per language."""
        return self.of_words([word])[0]

    def of_words(self, words: list[str]) -> np.ndarray:
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w) + 1].append(i)
        out = np.zeros((len(words), self.p.shape[1]))
        for length, places in by_length.items():
            for a in range(0, len(places), 20_000):
                at = places[a:a + 20_000]
                marked = [MARK + words[i] for i in at]
                out[at] = self._forward(marked) if length <= BATCHED else [self._forward_long(w) for w in marked]
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        s = symbols(words)
        n, size = s.shape
        p, q = powers(size + 1)
        c = np.zeros((n, size + 1), dtype=np.uint64)
        np.cumsum(s * p[:size], axis=1, out=c[:, 1:])
        alpha = [np.ones((n, self.p.shape[1]))]
        for end in range(1, size + 1):
            total = np.zeros_like(alpha[0])
            for start in range(max(0, end - self.pieces.longest), end):
                piece = self.pieces.find(mix((c[:, end] - c[:, start]) * q[start]))
                if start == end - 1:
                    total += alpha[start] * self.p[piece]
                elif len(hit := np.flatnonzero(piece >= 0)):
                    total[hit] += alpha[start][hit] * self.p[piece[hit]]
            alpha.append(total)
        return np.log(np.maximum(alpha[-1], 1e-300))

    def _forward_long(self, word: str, chunk: int = 4096) -> np.ndarray:
        """The pass over one word of any length: only the last columns that a piece can reach are kept, and rescaled."""
        s = symbols([word])[0]
        p, q = powers(len(s) + 1)
        c = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(s * p[:len(s)])])
        last = np.zeros((self.pieces.longest, self.p.shape[1]))  # newest first
        last[0] = 1
        log_scale = np.zeros(self.p.shape[1])
        for a in range(1, len(s) + 1, chunk):
            ends = np.arange(a, min(a + chunk, len(s) + 1))
            weights = np.zeros((len(ends), *last.shape))
            for size in range(1, len(last) + 1):
                start = np.maximum(ends - size, 0)
                piece = self.pieces.find(mix((c[ends] - c[start]) * q[start]))
                use = (ends >= size) & ((piece >= 0) | (size == 1))  # one letter without a piece has a probability too
                weights[use, size - 1] = self.p[piece[use]]
            for i, weight in enumerate(weights):
                total = (last * weight).sum(axis=0)
                last[1:] = last[:-1]
                last[0] = total
                if i % 8 == 7:
                    top = last.max(axis=0)
                    last /= top
                    log_scale += np.log(top)
        return log_scale + np.log(last[0])

    def texts(self, words: list[list[str]]) -> list[np.ndarray]:
        """Summed scores of the words of each text."""
        get = self.place.get
        places = [list(map(get, ws)) for ws in words]
        new = list({w for ws, at in zip(words, places, strict=True) if None in at for w, i in zip(ws, at, strict=True) if i is None})
        if new:
            if len(self.place) + len(new) > MAX_WORDS:
                self.place.clear()
                self.scores = self.scores[:0]
                new = list({w for ws in words for w in ws})
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.scores = np.concatenate([self.scores, self.of_words(new)])
            places = [list(map(get, ws)) for ws in words]
        return [self.scores[at].sum(axis=0) for at in places]


def crc_fold(doc_id, folds: int = 5):
    """crc32 of the id as text modulo ``folds``, as a column."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def learn(training: DataFrame, vocabulary: str | None = None, smoothing: float = 0.5):
    """Piece probabilities per language from (text, lang): (languages, log-probabilities).

    Counts are expected over the whole table: each text's words are cut greedily into
    longest pieces, counted per language. The result has one number for each
    language and piece, so its size is bounded by the vocabulary.
    """
    path = vocabulary or default_vocabulary()

    def count(batches):
        pieces = load_pieces(path)
        cut: dict[str, list[int]] = {}
        total: dict[str, Counter] = defaultdict(Counter)
        for pdf in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                words[lang].update(words_of(text))
            for lang, ws in words.items():
                into = total[lang]
                for w, n in ws.items():
                    if (ids := cut.get(w)) is None:
                        ids = _longest(pieces, w)
                        if len(cut) < MAX_WORDS:
                            cut[w] = ids
                    for i in ids:
                        into[i] += n
        rows = [(lang, i, n) for lang, c in total.items() for i, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "piece", "n"])

    counts = training.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang")) \
        .mapInPandas(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    pieces = load_pieces(path)
    size = len(pieces.index) + 1
    languages = sorted(counts["lang"].unique())
    log_p = np.zeros((len(languages), size))
    for k, lang in enumerate(languages):
        c = np.full(size, smoothing)
        own = counts[counts["lang"] == lang]
        np.add.at(c, own["piece"].to_numpy(), own["n"].to_numpy())  # -1 is the last: letters without a piece
        log_p[k] = np.log(c / c.sum())
    return languages, log_p


def fit_bounds(found: DataFrame) -> DataFrame:
    """(lang_pred, least_fit) learned from the predictions of the training folds, one row a language.

    The bound lies below the median by ``FIT_SPREADS`` times the way to the 5th
    percentile, so that up to 5 % of junk doesn't move it, and by ``LEAST_SPREAD`` at least.
    """
    low, middle = (F.percentile_approx("fit", q, 10_000) for q in (0.05, 0.5))
    return found.where(~F.col("held_out") & (F.col("lang_pred") != "und")).groupBy("lang_pred").agg(
        (middle - F.greatest(F.lit(LEAST_SPREAD), FIT_SPREADS * (middle - low))).alias("least_fit"))


def _longest(pieces: Pieces, word: str) -> list[int]:
    out, word, a = [], MARK + word, 0
    while a < len(word):
        for end in range(min(len(word), a + pieces.longest), a, -1):
            if (i := pieces.index.get(word[a:end])) is not None:
                break
        else:
            i = -1
        out.append(i)
        a = end
    return out


def identify(documents: DataFrame, languages: list[str], log_p: np.ndarray, vocabulary: str | None = None,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` (doc_id, text) to (doc_id, lang_pred, score, fit), then the long columns ``carry``.

    ``score`` is the posterior of the best language under equal priors, 0 to 1. ``fit``
    is the mean log-probability a letter in that language (null without letters).
    Null texts and texts without a letter are ``und`` with score 0, and all are
    if nothing was learned. Ties go to the language first in the alphabet.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        scorer = Scorer(load_pieces(path), log_p) if languages else None
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), 500):
                words = [words_of(t) if scorer and isinstance(t, str) else [] for t in pdf["text"].iloc[at:at + 500]]
                for ws, total in zip(words, scorer.texts(words) if scorer else words, strict=True):
                    if not ws:
                        out.append(("und", 0.0, None))
                        continue
                    best = int(np.argmax(total))
                    score = 1.0 / math.fsum(np.exp(np.maximum(total - total[best], -700.0)))
                    out.append((languages[best], min(1.0, score), float(total[best] / sum(map(len, ws)))))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "fit"]).assign(**{c: pdf[c].to_numpy() for c in ("doc_id", *carry)})

    schema = "lang_pred string, score double, fit double, doc_id string" + "".join(f", {c} long" for c in carry)
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *carry).mapInPandas(run, schema) \
        .withColumn("doc_id", F.col("doc_id").cast("long"))


def language_predictions(documents: DataFrame, folds: int = 5, vocabulary: str | None = None,
                         carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from all folds but 0 and predict every document: (doc_id, held_out, lang_pred, score, fit).

    The fold is crc32(doc_id as text) modulo ``folds``; a null id counts as the
    empty text. lang, source and doc_id are never inputs of a prediction.
    """
    fold = crc_fold("doc_id", folds)
    training = documents.where(F.coalesce(fold, F.lit(0)) != 0)
    languages, log_p = learn(training, vocabulary)
    found = identify(documents, languages, log_p, vocabulary, carry)
    return found.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == 0, F.lit(True)).alias("held_out"),
                        "lang_pred", "score", "fit", *carry)
