"""op6: the forward pass against all segmentations, and held-out accuracy."""
import math
import zlib

import numpy as np

from keystone.llm.language_id import Scorer, default_vocabulary, identify, language_predictions, load_pieces


def all_segmentations(pieces, p, word):
    if not word:
        return 1.0
    out = 0.0
    for end in range(1, len(word) + 1):
        i = pieces.index.get(word[:end], -1 if end == 1 else None)
        if i is not None:
            out += p[i] * all_segmentations(pieces, p, word[end:])
    return out


def test_forward_sums_all_segmentations():
    pieces = load_pieces(default_vocabulary())
    p = np.random.default_rng(0).random((2, len(pieces.index) + 1)) / 50
    scorer = Scorer(pieces, np.log(p))
    for w in ("the", "straße", "information", "ŋa", "x", "aaaaaaaaaaaaaaa"):
        want = [math.log(all_segmentations(pieces, row, "▁" + w)) for row in p]
        assert np.allclose(scorer.word(w), want)
    assert np.isfinite(scorer.word("q" * 5000)).all()


def test_long_words_are_not_cut():
    pieces = load_pieces(default_vocabulary())
    p = np.random.default_rng(1).random((2, len(pieces.index) + 1)) / 50
    scorer = Scorer(pieces, np.log(p))
    words = ["donaudampfschifffahrtsgesellschaft", "the" * 40, "日本語" * 20, "q" * 23, "information" * 2 + "s", "information" * 2 + "es", "ation" * 1000]
    for w, got in zip(words, scorer.of_words(words), strict=True):
        marked = "▁" + w
        for row, score in zip(p, got, strict=True):
            alpha = [0.0]
            for end in range(1, len(marked) + 1):
                found = ((a, pieces.index.get(marked[a:end], -1 if a == end - 1 else None)) for a in range(max(0, end - pieces.longest), end))
                logs = [alpha[a] + math.log(row[i]) for a, i in found if i is not None]
                alpha.append(max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs)))
            assert math.isclose(score, alpha[-1], rel_tol=1e-9), w


def test_held_out_accuracy(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language_predictions(docs).collect()}
    right = []
    for r in docs.collect():
        p = got[r["doc_id"]]
        assert p["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= p["score"] <= 1 and p["lang_pred"] in {"en", "de", "fr", "es", "und"}
        if p["held_out"] and p["lang_pred"] != "und":
            right.append(p["lang_pred"] == r["lang"])
    assert len(right) > 100 and np.mean(right) > 0.95


def test_odd_texts(docs_of, corpus):
    texts = [None, "", "12 34 !", "réux ouè éelle " * 20000, "same", "same", "x" * 50000, "日本語"]
    docs = docs_of([(i, t, None, None) for i, t in enumerate(texts)])
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_predictions(docs.unionByName(corpus.selectExpr(
        "doc_id + 1000 doc_id", "text", "lang", "source", "n_chars", "1L start", "'u' uid"))).where("doc_id < 1000").collect())
    assert [x[1:] for x in got[:3]] == [("und", 0.0)] * 3 and got[3][1] == "fr" and got[4][1:] == got[5][1:] and len(got) == 8
    assert language_predictions(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(docs, [], np.zeros((0, 1))).collect()} == {"und"}


def test_numbers_are_no_letters():
    from keystone.llm.language_id import words_of
    assert words_of("½ ² Ⅷ ① 12 _ ٣") == [] and words_of("a½b Ünder_x 一二 ª") == ["a", "b", "ünder", "x", "一二", "ª"]


def test_words_take_no_longer_than_a_plain_pattern():
    import re
    import time

    from keystone.llm.language_id import words_of

    text = "Straße und Brücke 12 cafés, don't x_y " * 4000
    took = {}
    for name, fn in (("plain", lambda t: re.findall(r"[^\W\d_]+", t.lower())), ("words", words_of)):
        starts = time.perf_counter()
        for _ in range(3):
            fn(text)
        took[name] = time.perf_counter() - starts
    assert took["words"] < 5 * took["plain"]
    assert words_of("Ⅷab½ c½½d é² ٣x") == ["ab", "c", "d", "é", "x"]
