"""op3 against Python's re."""
import hashlib
import re

from keystone.llm.secrets import find_secrets

BASE = [("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{(*[b[0] for b in BASE], 'live')[k]}:{a}:{b}" for a, k, b in spans)


ODD = [None, "", "password=abc password='hunter22' PASSWD : \"x.y-z=9\"", "api_key=apikey:secret=token=abcdef", "token=ab,token=abcdefg",
       "AKIAAKIA" + "B" * 14 + " AKIA" + "1" * 15 + " xAKIA" + "2" * 16, "é😀 " + "a0" * 12 + " " + "f" * 23, "deadbeef" * 400,
       "toKen=abcdefgh ſecret=abcdefgh", "key Zq9" + "xYz4" * 6 + " end", "secret=" + "a1b2c3d4" * 4, "password = " + "A" * 60000,
       "password=\n abcdef", "same Zq9" + "xYz5" * 6, "same Zq9" + "xYz5" * 6, "secret:'" + "=" * 9, "😀" * 3 + "api-key=abcdefg apikey=  \"abcdefg"]


def test_base_spans_equal_re(docs_of, corpus):
    for docs in (docs_of(ODD), corpus):
        texts = docs.collect()
        got = find_secrets(docs).collect()
        assert len(got) == len(texts)
        by = {r["doc_id"]: r for r in got}
        for t in texts:
            r, want = by[t["doc_id"]], brute(t["text"])
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
            assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
            spans = [(s["start"], s["kind"], s["end"]) for s in r["all_spans"]]
            assert [s for s in spans if s[1] < 3] == want and spans == sorted(spans) and listed(spans) == r["spans"]
            assert all((t["text"])[s["start"]:s["end"]] == s["value"] for s in r["all_spans"])


def test_ownership_frequency(docs_of):
    one, many = "Zq9" + "xYz4" * 6, "Example7" + "keyA" * 5
    docs = docs_of([(1, f"k {one}", None, "a"), (2, f"again {one}", None, "a"), (3, many, None, "a"), (4, many, None, "b"),
                    (5, many, None, None), (6, f"token={one}", None, "a"), (7, "", None, None), (7, "", None, None)])
    got = {r["doc_id"]: r for r in find_secrets(docs).collect()}
    assert got[1]["spans"] == f"live:2:{2 + len(one)}" and got[1]["n_live"] == 1 and got[2]["n_live"] == 1
    assert [(got[i]["n_live"], got[i]["n_example"]) for i in (3, 4, 5)] == [(0, 1)] * 3
    assert got[6]["spans"].startswith("assign:0:") and got[6]["n_live"] == 0
    assert find_secrets(docs).count() == 8 and find_secrets(docs.limit(0)).count() == 0


def test_documents_and_owners_decide(docs_of):
    hot, two, wide = "Hot9" + "xYz4" * 6, "Two9" + "xYz4" * 6, "Wide9" + "xYz4" * 6
    docs = docs_of([(i, f"k {hot} {hot}", None, "a") for i in range(6)] + [(0, f"k {hot} {hot}", None, "a")]
                   + [(10 + i, f"k {two}", None, s) for i, s in enumerate("ab")] + [(20 + i, f"k {wide}", None, s) for i, s in enumerate("abb")])
    by_owner, both = find_secrets(docs).collect(), find_secrets(docs, least_documents=3, max_documents=5).collect()
    copies = {r["doc_id"]: [(c["n_documents"], c["n_owners"]) for c in r["copies"]] for r in both}
    assert len(both) == 12 and copies[0] == [(6, 1)] * 2 and copies[10] == [(2, 2)] and copies[20] == [(3, 2)]
    found = {r["doc_id"]: (r["n_live"], r["n_example"]) for r in both}
    assert found == {i: (0, 2) for i in range(6)} | {10: (1, 0), 11: (1, 0)} | {20 + i: (0, 1) for i in range(3)}
    # six documents are not over six, however many occurrences they hold
    assert {r["n_live"] for r in find_secrets(docs, max_documents=6).where("doc_id < 6").collect()} == {2}
    assert {r["doc_id"]: r["n_live"] for r in by_owner} == {i: 2 for i in range(6)} | {i: 0 for i in (10, 11, 20, 21, 22)}


def test_no_python_on_the_executors(docs_of):
    plan = find_secrets(docs_of(ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_registered_query_counts_documents_and_owners(llm, docs_of, tmp_path):
    """A value in many documents of one source is an example, one in a document of each of two sources isn't."""
    import duckdb

    from keystone.llm.oracles import oracle_sql
    from keystone.llm.queries import queries
    hot, two, wide = "Hot9" + "xYz4" * 6, "Two9" + "xYz4" * 6, "Wide9" + "xYz4" * 6
    rows = [(i, f"k {hot}", None, "a") for i in range(1001)] + [(2000 + i, f"k {two}", None, s) for i, s in enumerate("ab")]
    rows += [(3000 + i, f"k {wide} {wide}", None, s) for i, s in enumerate("abb")] + [(4000, f"k {two}x token={wide}", None, None)]
    docs_of(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries()["op3_secret_scan"](llm, str(tmp_path)).collect()}
    assert {got[i]["n_live"] for i in range(1001)} == {0} and [got[2000 + i]["n_live"] for i in range(2)] == [1, 1]
    assert [got[3000 + i]["n_example"] for i in range(3)] == [2] * 3 and got[4000]["n_live"] == 1
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(oracle_sql()["op3_secret_scan"])
    names = want.columns
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in names) for r in got.values())
