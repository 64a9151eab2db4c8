"""op13 against all words that share a mask."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from keystone.llm.spelling import neighbours, spelling_variants

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near_of(words):
    masks, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[w[:i], w[i + 1:]].add(w)
            if (less := w[:i] + w[i + 1:]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(rows, divisor, letters=5, count=3):
    n = Counter()
    for doc_id, text in rows:
        for w in LETTERS.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if divisor and h % divisor == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= count}
    near, form = near_of(n), {}
    for w, c in n.items():
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 2 * c:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def result(df, **kw):
    rows = [tuple(r) for r in spelling_variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_table(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert result(corpus, divisor=97) == brute(rows, 97)


def test_odd_texts(docs_of):
    long = "qu" * 700
    rows = [(1, "Hello hello HELLO hallo hallo hallo hall hall hall"), (2, None), (3, ""), (4, "123 ... \t"), (None, "hello hellos hellos hellos"),
            (5, "École école École ÉCOLE écoles ecole ecole ecole ×÷abcde İabcde"), (5, "repeat repeat repeat reapeat " * 3), (5, "repeat repeat repeat reapeat " * 3),
            (6, "aaaaa aaaaaa aaaaaaa " * 9 + "aaaab baaaa " * 4), (7, f"{long} {long}x x{long} {long[:400]}z{long[401:]} " * 3), (8, "abcdeabcde " * 40_000),
            (9, "abcde abcdf abcdg " * 8), (10, "abcdf abcdg " * 20)]
    docs = docs_of([(i, t, "en", "s") for i, t in rows]).repartition(3)
    for divisor in (0, 2, 97):
        assert result(docs, divisor=divisor) == brute(rows, divisor), divisor
    assert result(docs, divisor=3, least_letters=1, least_count=1) == brute(rows, 3, 1, 1)
    assert result(docs.limit(0)) == set()
    with pytest.raises(ValueError):
        spelling_variants(docs, factor=1)


def test_neighbours_of_random_words(llm):
    """Short words over few letters, where nearly all are near, and long ones with edits at every place."""
    rng = np.random.default_rng(8)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(1, 8)))) for _ in range(900)}
    base = "".join(rng.choice(list("abcdefgh"), 41))
    words |= {base[:i] + "z" + base[i + 1:] for i in range(41)} | {base[:i] + base[i + 1:] for i in range(41)} | {base[:i] + "y" + base[i:] for i in range(42)} | {base}
    listed = sorted(words)
    df = llm.createDataFrame(list(enumerate(listed)), "wid long, word string").repartition(4)
    got = [tuple(r) for r in neighbours(df).collect()]
    near = near_of(words)
    assert len(got) == len(set(got))
    assert {(listed[a], listed[b]) for a, b in got} == {(a, b) for a in words for b in near[a] if a < b}
