"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as part boundaries beside the ranks of adjacent parts. The least
rank is found by a scan, its inner boundary deleted, and the two neighbouring
ranks refreshed, until no adjacent pair has a rank. The scan suits short words;
words of over ``SCAN_MAX`` parts keep the ranks in a heap instead, with the same
merges in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import key_as_text
from keystone.llm.tokens import PRE_TOKENS, byte_letters, default_vocabulary, encoder, plain_words

SCAN_MAX = 96
NO_RANK = 1 << 60
#: Words, and pre-tokens, that a Python worker keeps rendered.
MAX_WORDS = 250_000
#: The pre-token pattern of the vocabulary file, for characters of any script.
ANY_SCRIPT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class RankArrayBPE:
    """Encoder and decoder over the vocabulary, merges and normaliser of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.letters = byte_letters()
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.pieces: dict[str, tuple[str, str]] = {}
        self.words: dict[str, tuple[str, str]] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """Merge parts of a word (single letters, the last with the end mark)."""
        return self._scan(parts) if len(parts) <= SCAN_MAX else self._heap(parts)

    def _scan(self, parts: list[str]) -> list[str]:
        get = self.rank.get
        # boundary i is where part i begins in the word; ranks[i] belongs to parts i and i + 1
        text = "".join(parts)
        bounds, at = [], 0
        for p in parts:
            bounds.append(at)
            at += len(p)
        bounds.append(at)
        ranks = [get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            here = text[bounds[i]:bounds[i + 1]]
            if i < len(ranks):
                ranks[i] = get((here, text[bounds[i + 1]:bounds[i + 2]]), NO_RANK)
            if i:
                ranks[i - 1] = get((text[bounds[i - 1]:bounds[i]], here), NO_RANK)
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def _heap(self, parts: list[str]) -> list[str]:
        parts, n = list(parts), len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # a part of the pair has been merged since
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def piece(self, pre_token: str) -> list[int]:
        """Ids of one normalised pre-token."""
        parts = [self.letters[b] for b in pre_token.encode("utf-8")]
        parts[-1] += self.suffix
        return [self.vocab[p] for p in self.merge(parts)]

    def encode(self, text: str) -> list[int]:
        ids = []
        for k, segment in enumerate(self.cut_special.split(text)):
            if k % 2:
                ids.append(self.special[segment])
            elif segment:
                for p in ANY_SCRIPT.findall(self.normalise(segment)):
                    ids += self.piece(p)
        return ids

    def decode(self, ids) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def _rendered(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)

    def rendered_word(self, word: str) -> tuple[str, str]:
        out = []
        for p in PRE_TOKENS.findall(word):
            if (r := self.pieces.get(p)) is None:
                r = self._rendered(self.piece(p))
                if len(self.pieces) < MAX_WORDS:
                    self.pieces[p] = r
            out.append(r)
        r = " ".join([x[0] for x in out]), " ".join([x[1] for x in out])
        if len(self.words) < MAX_WORDS:
            self.words[word] = r
        return r

    def rendered(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by one space, decoded text) of a whole text."""
        words = plain_words(text)
        if words is None:
            return self._rendered(self.encode(text))
        get, make = self.words.get, self.rendered_word
        both = [get(w) or make(w) for w in words]
        return " ".join([x[0] for x in both if x[0]]), " ".join([x[1] for x in both if x[0]])


def bpe_round_trip(documents: DataFrame, vocabulary: str | None = None, keep_texts: bool = False) -> DataFrame:
    """``documents`` (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256), one row each.

    Null and empty texts have no tokens (hashes of the empty string). Texts that
    hold a special token's string get its id. With ``keep_texts`` the ids (as
    decimals joined by one space) and the decoded text follow as columns. Other
    columns are ignored; repeated rows give repeated results.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = encoder(RankArrayBPE, path)
        for pdf in batches:
            n, ids_hash, text_hash, kept = [], [], [], []
            for text in pdf["text"]:
                ids, decoded = bpe.rendered(text) if isinstance(text, str) else ("", "")
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep_texts:
                    kept.append((ids, decoded))
            out = {"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash}
            if keep_texts:
                out |= {"ids": [k[0] for k in kept], "decoded": [k[1] for k in kept]}
            yield pd.DataFrame(out)

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep_texts
    return key_as_text(documents).mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
