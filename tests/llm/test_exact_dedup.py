"""op12 against grouping of the normalised texts."""
import hashlib
import re

from keystone.llm.exact_dedup import exact_duplicates

BLANK = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    """One row per document; of rows that repeat an id, which one is kept is left open."""
    groups: dict = {}
    for doc_id, text in rows:
        groups.setdefault(BLANK.sub("", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for bare, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        left = 1
        for m in members:
            kept = bool(left and m == keep)
            left -= kept
            out.append((m[0], keep[0], len(members), kept, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [(1, "a b\tc"), (2, "abc"), (3, " a\nb\x0bc\x0c\r "), (4, "abd"), (5, None), (6, ""), (7, " \t\n"), (None, "a b\tc  "), (9, "a b\tc  "),
       (10, "a bc"), (11, "a bc"), (12, "é😀" * 300), (13, "é 😀" * 300), (13, "é 😀" * 300), (14, "x" * 300 + "y"), (15, "x" * 300 + "z"),
       (16, "w " * 50_000), (17, "ww" * 25_000), (None, "nobody"), (None, "no body"), (18, "\x1ca"), (19, "a")]


def result(df):
    return sorted(map(tuple, exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_equals_grouping(docs_of, corpus):
    docs = docs_of([(i, t, "en", "s") for i, t in ODD])
    assert result(docs) == brute(ODD)
    assert result(corpus) == brute([(r["doc_id"], r["text"]) for r in corpus.collect()])
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_a_group_of_most_rows(docs_of):
    """A hot text, hot lengths and hot heads."""
    rows = [(i, "same " * 3 + " " * (i % 7)) for i in range(1500)] + [(2000 + i, f"same{i:04d}") for i in range(900)]
    rows += [(5000 + i, "h" * 300 + f"{i % 90:04d}") for i in range(600)]
    got = result(docs_of([(i, t, "en", "s") for i, t in rows]).repartition(5))
    assert got == brute(rows)
    assert sum(r[3] for r in got) == 1 + 900 + 90


def test_no_python_on_the_executors(docs_of):
    plan = exact_duplicates(docs_of([(i, t, "en", "s") for i, t in ODD]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
