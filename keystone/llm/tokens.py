"""Whole texts to token ids, word by word.

The tokenizer of ``word_bpe_49k.json`` normalises (NFC, white space, lower case),
cuts the text into pre-tokens that never hold white space, and runs BPE inside
each. The ids of a text are thus the ids of its white-space words one after
another, and words repeat: each Python worker keeps the ids of the words it has
met. Texts with characters above U+00FF or with a special token's string go the
long way, as one call for the whole text.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_BLANK = " \t\n\v\f\r\x85\xa0"
_ASCII_BLANK = _BLANK[:6]
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANK}{_LETTERS}{_DIGITS}]+")
MAX_WORDS = 500_000
MAX_PIECES = 250_000
#: Characters up to which a word is remembered; longer ones are encoded each time.
MAX_LENGTH = 64
#: Characters of the texts that are encoded together.
BATCH_CHARS = 4 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plain_text(text: str) -> str | None:
    """Lower-case text on the short way, its white space that of ASCII, else None.

    Up to U+00FF, NFC changes nothing and lower case is one character to one.
    """
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        text = text.replace("\x85", " ").replace("\xa0", " ")
    if SPECIAL[0] in text or SPECIAL[1] in text:
        return None
    return text.lower()


def plain_words(text: str) -> list[str] | None:
    """Lower-case white-space words of a text on the short way, else None."""
    plain = plain_text(text)
    if plain is None:
        return None
    if any(c in plain for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes them for white space, the tokenizer doesn't
        return [w for w in re.split(f"[{_ASCII_BLANK}]+", plain) if w]
    return plain.split()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take U+0100 onwards in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def batches_of(texts: list[str]):
    """(from, to) of consecutive texts: up to ``BATCH_CHARS`` characters together, or one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > BATCH_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class LibraryEncoder:
    """Ids as little-endian uint16 bytes, made by the tokenizers library.

    The words of a batch are cut and numbered by Arrow, and each distinct one is looked up
    once. The library's model sees each pre-token it hasn't met in this process once. Words of
    letters are pre-tokens themselves; ``pieces`` holds other ones.
    Both memories stop growing at a fixed number of words of bounded length; beyond it
    words are encoded again in each batch.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encode_piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        plain = [plain_text(t) for t in texts]
        words = pc.ascii_split_whitespace(pa.array([p or "" for p in plain], pa.large_string()))
        numbered = words.values.dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.words.get, distinct))
        new = {w: i for i, (w, known) in enumerate(zip(distinct, ids, strict=True)) if known is None}
        new.pop("", None)                      # beside white space at either end of a text
        for w, raw in self._new_words(list(new)).items():
            ids[new[w]] = raw
        of_words = pa.array([raw or b"" for raw in ids], pa.large_binary()).take(numbered.indices)
        _, ends, raw = of_words.buffers()
        cuts = np.frombuffer(ends, np.int64)[words.offsets.to_numpy()].tolist() if len(of_words) else [0] * (len(texts) + 1)
        raw = memoryview(raw or b"")
        return [bytes(raw[a:b]) if p is not None else
                np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes()
                for t, p, a, b in zip(texts, plain, cuts, cuts[1:], strict=False)]

    def _new_words(self, new: list[str]) -> dict[str, bytes]:
        known, kept, encode = self.words.get, self.pieces.get, self._encode_piece
        out, made = {}, {}
        for w in new:
            if w.isalpha():                     # up to U+00FF the letters of PRE_TOKENS
                out[w] = encode(w)
        for w in new:
            if w in out:
                continue
            of = []
            for p in PRE_TOKENS.findall(w):
                raw = out.get(p) or known(p) or kept(p) or made.get(p)
                if raw is None:
                    raw = made[p] = encode(p)
                of.append(raw)
            out[w] = b"".join(of)
        for store, more, most in ((self.pieces, made, MAX_PIECES), (self.words, out, MAX_WORDS)):
            if (room := most - len(store)) > 0:
                store.update(islice(((w, ids) for w, ids in more.items() if len(w) <= MAX_LENGTH), room))
        return out


_encoders: dict = {}


def encoder(kind, path: str):
    """One encoder of a kind for each process and vocabulary file."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
