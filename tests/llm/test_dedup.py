"""op5, op7 and op10 against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import keystone.llm.jaccard_join as join
from keystone.llm.jaccard_join import jaccard_components, one_of_each_group
from keystone.llm.substring_dedup import level_lengths, passage_digest, remove_repeated_windows
from keystone.llm.suffix_array import common_prefixes, suffix_array
from keystone.llm.suffix_dedup import repeated_in_shard, string_digest
import keystone.llm.suffix_dedup as strings

WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def shingles(text, w):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + w]) for i in range(max(1, len(words) - w + 1))} if words else set()


def brute_components(rows, w, percent):
    sets = [shingles(t, w) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies(rng):
    texts = [None, "", " \t ", "one", "One", "one two", "a b c", "A B C", "É B C", "é B C"]
    base = [prose(rng, rng.choice([9, 10, 12, 30, 64, 200, 700])) for _ in range(25)]
    for b in base:
        texts += [edited(rng, b, rng.randrange(0, 1 + max(1, len(b.split()) // 30))) for _ in range(rng.randrange(1, 5))]
    big = prose(rng, 150)
    texts += [edited(rng, big, rng.randrange(0, 6)) for _ in range(60)]  # a long list of changed copies
    boiler = prose(rng, 60, 5000)
    texts += [boiler + " " + prose(rng, rng.choice([2, 4, 8, 40]), 9000) for _ in range(40)]  # frequent words in most of it
    step = prose(rng, 120, 9000).split()
    texts += [" ".join(step[i:i + 100]) for i in range(0, 20)]  # a chain: neighbours link, ends don't
    return texts + texts[:12]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (1, 60)])
def test_join_finds_every_link(docs_of, words, percent):
    texts = near_copies(random.Random(words))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs = docs_of([(i, t, None, None) for i, t in rows])
    got = sorted(tuple(r) for r in jaccard_components(docs, words, percent).collect())
    assert got == brute_components(rows, words, percent)


def test_join_over_the_given_table_and_lists_without_pivots(docs_of, corpus, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    want = brute_components(rows, 3, 90)
    assert sorted(tuple(r) for r in jaccard_components(corpus, 3, 90).collect()) == want
    monkeypatch.setattr(join, "PIVOTS", ())
    texts = near_copies(random.Random(9))
    got = jaccard_components(docs_of(texts), 5, 80).collect()
    assert sorted(tuple(r) for r in got) == brute_components(list(enumerate(texts)), 5, 80)
    assert jaccard_components(corpus.limit(0)).count() == 0


@pytest.mark.parametrize("counters", [64, 1 << 12])
def test_join_is_the_same_for_any_order_of_tokens(docs_of, monkeypatch, counters):
    # few counters: the order is nearly that of hashes; prefixes of a pair then often end at different places
    monkeypatch.setattr(join, "COUNTERS", counters)
    rng = random.Random(counters)
    rows = []
    for size in (20, 60, 200):
        origin = prose(rng, size, 9000)
        for share in (0, 0.01, 0.02, 0.04, 0.06, 0.09):  # around what the threshold allows
            rows += [edited(rng, origin, int(size * share)) for _ in range(7)]
    rows = list(enumerate(rows))
    got = sorted(tuple(r) for r in jaccard_components(docs_of([(i, t, None, None) for i, t in rows]), 3, 90).collect())
    assert got == brute_components(rows, 3, 90)


def test_sketch_counts_every_shingle(docs_of):
    rows = [(i, "a b c d", None, None) for i in range(300)] + [(300, "e f g", None, None), (301, None, None, None), (302, "x", None, None)]
    got = np.frombuffer(join.token_classes(docs_of(rows).repartition(7), 3), dtype=np.uint8)
    want = np.zeros(join.COUNTERS, dtype=np.uint8)
    for text, n in (("a b c", 300), ("b c d", 300), ("e f g", 1)):
        want[int(join.shingle_set(text, 3)[0] % np.uint64(join.COUNTERS))] = n.bit_length()
    assert (got == want).all() and not any(join.token_classes(docs_of(rows).limit(0), 3))


def test_one_document_of_each_group_stays(docs_of):
    texts = near_copies(random.Random(4))
    docs = docs_of([(i, t, None, None) for i, t in enumerate(texts)] + [(3, texts[3], None, None)])
    want = {c for _, n, c in brute_components(list(enumerate(texts)), 5, 80)}
    out = one_of_each_group(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def brute_windows(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(rng):
    shared = [prose(rng, n, 9000) for n in (34, 35, 36, 50, 120)]
    texts = [None, "", "  ", "short", "ab " * 200, "\x1c " * 90, "é😀 " * 40 + "end", "z" * 3000, "same words " * 5]
    for i in range(60):
        parts = [prose(rng, rng.randrange(3, 60), 9000)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(1, 30), 9000)]
        texts.append(rng.choice([" ", "\n", "\t  "]).join(parts))
    texts += [shared[-1] + " tail", prose(rng, 4000, 9000) + " " + shared[2], texts[20], texts[20], shared[0] + "\n" + shared[0]]
    return texts


def test_repeated_windows(docs_of, corpus):
    texts = passages(random.Random(1))
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(20, texts[20], None, None), (None, texts[-1], None, None)]
    for docs in (docs_of(rows), corpus):
        base = docs.collect()
        want = brute_windows([r["text"] for r in base], 35)
        got = Counter(tuple(r) for r in passage_digest(docs).collect())
        assert got == Counter((r["doc_id"], *w) for r, w in zip(base, want, strict=True))
    out = remove_repeated_windows(docs_of(rows), 20).collect()
    assert sorted(r["n_removed"] for r in out) == sorted(w[1] for w in brute_windows([r[1] for r in rows], 20))
    assert passage_digest(corpus.limit(0)).count() == 0
    assert level_lengths(35) == [9, 18, 35]


def brute_strings(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeated_strings(docs_of, corpus, monkeypatch):
    rng = random.Random(2)
    texts = passages(rng) + ["é" * 150, "x" + "é" * 150, "q" * 199, "q" * 200, "ab" * 101]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(20, texts[20], None, None), (None, texts[-1], None, None)]
    for split in (strings.SHARD_CONTEXTS, 1):  # then every representative is split over shards
        monkeypatch.setattr(strings, "SHARD_CONTEXTS", split)
        monkeypatch.setattr(strings, "SHARD_BYTES", 2_000 if split == 1 else 50_000)
        for docs in (docs_of(rows), corpus):
            base = docs.collect()
            want = brute_strings([r["text"] for r in base], 200)
            got = Counter(tuple(r) for r in string_digest(docs).collect())
            assert got == Counter((r["doc_id"], *w) for r, w in zip(base, want, strict=True))
    assert string_digest(corpus.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n, letters, depth in ((1, 2, 10), (50, 2, 200), (3000, 2, 40), (9000, 3, 300), (6000, 1, 64)):
        text = rng.integers(1, letters + 1, n).astype(np.int16)
        text[rng.integers(0, n, n // 100)] = 0
        order = suffix_array(text)
        suffix = [tuple(text[i:]) for i in order]
        assert sorted(order) == list(range(n)) and suffix == sorted(suffix)
        before, common = common_prefixes(text, order, depth)
        for a, b in zip(order, order[1:]):
            k = 0
            while k < depth and max(a, b) + k < n and text[a + k] == text[b + k] != 0:
                k += 1
            assert before[b] == a and common[b] == k
    assert [m.tolist() for m in repeated_in_shard([b"a" * 70, b"b" * 64, b"xb" + b"b" * 64], 64)] == [[True] * 7, [True], [False, True, True]]


def test_null_and_repeated_ids_are_no_key(docs_of):
    """Thousands of documents without an id, and rows alike in all but their source."""
    import time

    from keystone.llm.jaccard_join import jaccard_components, one_of_each_group
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(None, text(i), "en", "s") for i in range(2000)]
    rows += [(5, text(50_000 + i // 2) + (" tail" if i % 2 else ""), "en", "s") for i in range(40)] + [(6, text(70_000), "en", "s")] * 300 + [(7, text(70_000) + " end", "en", "s")]
    began = time.time()
    got = [tuple(r) for r in jaccard_components(docs_of(rows), words=3, percent=90).select("doc_id", "n_shingles", "component_id").collect()]
    assert len(got) == len(rows) and time.time() - began < 240
    assert {r[2] for r in got if r[0] in (6, 7)} == {6} and {r[2] for r in got if r[0] == 5} == {5}
    kept = one_of_each_group(docs_of(rows), words=3, percent=90)
    assert kept.where("doc_id = 5").count() == 20 and kept.where("doc_id in (6, 7)").count() == 1


def test_tokens_are_counted_in_little_memory():
    """Counters once and few tokens at a time; a second set of counters and millions of held tokens came to 200 MB a worker."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from keystone.llm import jaccard_join as J

    texts = [" ".join(f"w{(i * j) % 9973}" for j in range(1, 4000)) for i in range(1, 200)] + [None, "", "a b"]
    tracemalloc.start()
    (out,) = J._token_counts(3)(iter([pd.DataFrame({"text": texts})]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.concatenate([np.frombuffer(J.zlib.decompress(c), dtype=np.int64) for c in out["counts"]])
    want = np.zeros(J.COUNTERS, dtype=np.int64)
    for t in texts[:-3]:
        w = J.window_hashes(J.word_hashes(t.encode()), 3)
        want += np.bincount((w % np.uint64(J.COUNTERS)).astype(np.int64), minlength=J.COUNTERS)
    assert (got == want).all() and got.sum() == 199 * 3997
    assert peak < J.COUNTERS * 8 * 1.6
