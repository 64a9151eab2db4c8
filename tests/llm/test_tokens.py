"""op2, op4 and op9 against the tokenizers library."""
import hashlib
import zlib

import numpy as np
import pytest

from keystone.llm.bpe import RankArrayBPE, bpe_round_trip
from keystone.llm.packing import pack_documents, sum_of_squares_pack
from keystone.llm.token_files import FrequencyTable, decode_block, encode_block, token_file_index
from keystone.llm.tokens import LibraryEncoder, batches_of, default_vocabulary

ODD = [None, "", " \n\t ", "a\x1cb", "<|endoftext|>x<|startoftext|> y", "naïve ﬁ Ω日本語 ①½ don't I'LL 'sabc .'s ''s x'RE",
       "É́ é İSTANBUL ΑΣ", "z" * 3000, "\xa0a\x85b　c", "ab" * 200 + "!?" * 300, "a­b", "1234 12a ²³¼ª",
       "long " * 9000, "same same", "same same", "\U0001f600 ok yes"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_vocabulary())


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_round_trip_equals_the_library(llm, docs_of, corpus, library):
    for docs in (docs_of(ODD), corpus):
        got = {r["doc_id"]: r for r in bpe_round_trip(docs).collect()}
        for r in docs.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            out = got[r["doc_id"]]
            assert out["n_tokens"] == len(ids)
            assert out["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert out["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_words_are_looked_up_once_for_all_texts_encoded_together(library):
    class Counted(dict):
        looked_up = 0

        def get(self, *key):
            Counted.looked_up += 1
            return super().get(*key)

    texts = ["the storm", "Storm of the sea"] * 1000
    assert list(batches_of(texts)) == [(0, 2000)] and list(batches_of([])) == []
    enc = LibraryEncoder(default_vocabulary())
    enc.words = Counted()
    one, two = (library.encode(t, add_special_tokens=False).ids for t in texts[:2])
    assert [np.frombuffer(r, "<u2").tolist() for r in enc.encode_batch(texts)] == [one, two] * 1000
    assert Counted.looked_up == 4


def test_batches_are_bounded_and_hold_every_text():
    texts = ["", "a" * 3_000_000, "b" * 2_000_000, "", "c" * 9_000_000, "d"]
    assert list(batches_of(texts)) == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_any_characters_are_encoded_as_by_the_library(library):
    rng = np.random.default_rng(3)
    letters = ["a", "B", "é", "É", "ß", "µ", "²", "1", "'s", "'LL", "'", "-", "\x1c", "\x1f", "\x85", "\xa0", " ", "  ", "\n", "\x0b", "\0", "\x7f", "\xad",
               "×", "the", "中", "İ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters[:25 if i % 2 else None], rng.integers(0, 25))) for i in range(1500)] + [t or "" for t in ODD]
    enc = LibraryEncoder(default_vocabulary())
    for _ in range(2):                  # the second time from memory
        got = [np.frombuffer(r, "<u2").tolist() for r in enc.encode_batch(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.encode_batch([]) == [] and enc.encode_batch(["", " "]) == [b"", b""]


def test_scan_and_heap_merge_alike():
    bpe = RankArrayBPE(default_vocabulary())
    rng = np.random.default_rng(1)
    for _ in range(200):
        w = "".join(rng.choice(list("abcdeinthr!"), rng.integers(1, 60)))
        parts = [*w[:-1], w[-1] + bpe.suffix]
        assert bpe._scan(parts) == bpe._heap(parts)


def test_files_hold_all_ids_in_order(llm, docs_of, corpus, library):
    rows = [(i // 2 if i > 12 else 40 - i, t, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None)]
    for docs in (docs_of(rows), corpus, corpus.limit(0)):
        want, start = [], 0
        tokens = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
        for doc, ids in sorted(tokens, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]))):
            want.append((doc, start, len(ids), crc(ids)))
            start += len(ids)
        got = [tuple(r) for r in token_file_index(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
        assert sorted(got, key=lambda x: x[1]) == want


def test_block_format():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.zipf(1.3, 150_000) % 49408, np.arange(49408)]).astype(np.uint16)
    rng.shuffle(ids)
    table = FrequencyTable.from_counts(np.bincount(ids, minlength=65536))
    for n in (1, 5, 1023, 1024, 1025, len(ids)):
        assert (decode_block(encode_block(ids[:n], table), table) == ids[:n]).all()
    raw = encode_block(ids, table)
    assert (decode_block(raw, table, 1, 1) == ids[65536:131072]).all()  # from a checkpoint on, by itself
    for at in (9, 40, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            decode_block(bytes(bad), table)
    lone = FrequencyTable.from_counts(np.bincount([7] * 9, minlength=65536))
    assert (decode_block(encode_block(np.full(5000, 7, np.uint16), lone), lone) == 7).all()


def check_packing(rows, tokens, capacity=4096):
    seen = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids = tokens[r["doc_id"]]
        assert r["start"] == r["piece"] * capacity and r["length"] == min(capacity, len(ids) - r["start"])
        assert r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {d: len(t) for d, t in tokens.items()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(llm, docs_of, corpus, library):
    for docs in (docs_of(ODD), corpus, corpus.limit(0)):
        tokens = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
        n = check_packing(pack_documents(docs).collect(), tokens)
        assert n <= -(-sum(map(len, tokens.values())) // 4096) * 1.05 + 1


def test_sum_of_squares_is_the_least_change():
    """Each placement against trying every open gap."""
    rng, cap = np.random.default_rng(3), 40
    lengths = rng.integers(1, cap + 1, 400)
    bins, offsets = sum_of_squares_pack(lengths, cap)
    gaps = {}
    for size, b, o in zip(lengths, bins, offsets, strict=True):
        def cost(gap, new, size=size):
            g = dict(gaps)
            if not new:
                g.pop(next(k for k, v in g.items() if v == gap))
            counts = np.bincount([v for v in g.values() if v] + ([gap - size] if gap > size else []), minlength=cap + 1)
            return int((counts ** 2).sum())
        options = {(v, False) for v in gaps.values() if v >= size} | {(cap, True)}
        chosen = (cap, True) if b not in gaps else (gaps[b], False)
        assert o == cap - chosen[0]
        if size < cap:
            assert cost(*chosen) == min(cost(*x) for x in options)
        gaps[b] = chosen[0] - size
