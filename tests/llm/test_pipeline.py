"""The pipeline against brute force over a small corpus with planted cases."""
import random
import re
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from keystone.llm.tokens import default_vocabulary
from test_dedup import brute_components, brute_windows, edited
from test_secrets import brute
from test_tokens import check_packing


@pytest.fixture(scope="module")
def planted(llm, tmp_path_factory):
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(0)
    texts = [r["text"] for r in docs.where("lang = 'en'").collect()]
    long = [t for t in texts if len(t.split()) > 100]
    backwards = lambda t: " ".join(t.split()[:150][::-1])
    passage = " ".join(long[0].split()[:60])
    more = [None, "", "123 !!", long[1], edited(rng, long[1], 2), "password=" + "h" * 9 + " " + backwards(long[2]), f"{passage} {backwards(long[3])}", f"{backwards(long[4])} {passage}",
            "deadbeef" * 4 + " " + backwards(long[5]), "the of and " * 400]
    add = llm.createDataFrame([(10_000 + i, t, "en", "own", len(t or "")) for i, t in enumerate(more)], docs.schema)
    path = str(tmp_path_factory.mktemp("sf"))
    docs.unionByName(add).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_each_stage_takes_effect(llm, planted):
    before = llm.read.parquet(f"{planted}/documents.parquet")
    stages = {}
    docs = before
    for name, stage in P.STAGES[:-1]:
        out = stage(llm, docs, planted)
        assert out.columns == before.columns and out.dtypes == before.dtypes
        docs = llm.createDataFrame(out.collect(), before.schema)
        stages[name] = {r["doc_id"]: r for r in docs.collect()}
    given = {r["doc_id"]: r for r in before.collect()}
    letters = {d for d, r in given.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert set(stages["language_id"]) <= letters and len(stages["language_id"]) >= 0.98 * len(letters)

    rows = [(d, r["text"]) for d, r in stages["language_id"].items()]
    assert set(stages["ngram_jaccard_join"]) == {c for _, _, c in brute_components(rows, 5, 80)}

    rows = list(stages["ngram_jaccard_join"].values())
    for r, (_, n_removed, _) in zip(rows, brute_windows([r["text"] for r in rows], 35), strict=True):
        after = stages["substring_dedup"][r["doc_id"]]
        assert after["text"] == r["text"] if not n_removed else len(after["text"].split()) == len(r["text"].split()) - n_removed
        assert after["n_chars"] == (len(after["text"]) if n_removed else r["n_chars"])
    assert len(stages["substring_dedup"][10_006]["text"]) < len(given[10_006]["text"])

    for d, r in stages["secret_scan"].items():
        text = stages["substring_dedup"][d]["text"]
        if spans := brute(text):
            assert P.MASK in r["text"] and not brute(r["text"]) and r["n_chars"] == len(r["text"])
            keep = np.ones(len(text), dtype=bool)
            for a, _, b in spans:
                keep[a:b] = False
            if r["text"].count(P.MASK) == (np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum():
                assert r["text"].replace(P.MASK, "") == "".join(c for c, k in zip(text, keep, strict=True) if k)
    assert "hhhhhhhhh" not in stages["secret_scan"][10_005]["text"] and "deadbeef" not in stages["secret_scan"][10_008]["text"]

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(default_vocabulary())
    tokens = {d: tok.encode(r["text"] or "", add_special_tokens=False).ids + [1] for d, r in stages["secret_scan"].items()}
    check_packing(P.sequence_packing(llm, docs, planted).collect(), tokens)


def test_examples_of_one_source_stay_and_values_of_two_documents_go(docs_of):
    hot, two = "Hot9" + "xYz4" * 6, "Two9" + "xYz4" * 6
    docs = docs_of([(i, f"k {hot}", None, "a") for i in range(P.MOST_COPIES + 1)] + [(5000 + i, f"k {two}", None, s) for i, s in enumerate("ab")])
    out = {r["doc_id"]: r["text"] for r in P.secret_scan(None, docs.drop("start", "uid"), "").collect()}
    assert {t for d, t in out.items() if d < 5000} == {f"k {hot}"} and [out[5000], out[5001]] == [f"k {P.MASK}"] * 2


def test_unlearned_languages_and_random_letters_go(llm):
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(3)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60)),
            "Ez egy magyar nyelvű szöveg, amelyet a modell soha nem tanult meg, és ezért nem szabad elfogadnia, mert nem ismeri.",
            "Това е текст на български език, който моделът никога не е учил, и затова трябва да бъде отхвърлен."]
    clean = [" ".join(r["text"].split()[:8]) for r in docs.where("length(text) > 400").orderBy("doc_id").limit(30).collect()]
    held_out = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 5 == 0]  # not learned from
    ids = dict(zip(held_out, junk + clean, strict=False))
    add = [(i, t, "en", "own", len(t)) for i, t in ids.items()]
    out = P.language_id(llm, docs.unionByName(llm.createDataFrame(add, docs.schema)), "")
    kept = {r["doc_id"] for r in out.where("doc_id >= 10000").collect()}
    assert not kept & set(held_out[:3]) and len(kept) >= 29


def test_run_and_empty_table(llm, planted, tmp_path):
    assert P.run(llm, planted).columns[0] == "doc_id"
    llm.read.parquet(f"{planted}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(llm, str(tmp_path)).count() == 0
