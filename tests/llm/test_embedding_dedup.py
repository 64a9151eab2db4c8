"""op1 against all pairs."""
import numpy as np

from keystone.llm.components import connected_components
from keystone.llm.embedding_dedup import near_duplicate_vectors, usable

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, component int"


def brute(rows, cosine=0.98):
    """n_links and component of each row, by position."""
    n = len(rows)
    ok = [usable(r[1]) and r[2] is not None for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if o else None for r, o in zip(rows, ok, strict=True)]
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
             and float(unit[i] @ unit[j]) >= cosine] for i in range(n)]
    comp = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = min(rows[j][0] for j in seen)
    return sorted((r[0], len(near[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows))


def test_all_pairs_and_odd_vectors(llm):
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        for _ in range(12):
            c = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                v = c / np.linalg.norm(c) + rng.standard_normal(16) * 0.015
                rows.append([len(rows), (v * rng.uniform(0.1, 50)).tolist(), label])
    rows += [[900, [0.0] * 16, 1], [901, None, 1], [902, [], 1], [903, [1.0] * 15 + [None], 1], [904, [1.0] * 15 + [float("nan")], 1],
             [905, [float("inf")] * 16, 1], [906, rows[0][1], None], [907, rows[0][1], 0], [908, rows[0][1], 0], [908, rows[0][1], 0],
             [910, [1.0, 2.0], 1], [911, [2.0, 4.0], 1], [912, [1e-300, 2e-300], 1], [913, [1e300, 2e300], 1]]
    df = llm.createDataFrame([(*r, "u", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in near_duplicate_vectors(df, block_rows=4).collect())
    rows[-2][1], rows[-1][1] = [1.0, 2.0], [1.0, 2.0]  # the same directions
    assert got == brute(rows)


def test_given_table_and_empty_table(llm):
    df = llm.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert sorted(tuple(r) for r in near_duplicate_vectors(df).collect()) == brute(rows)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(llm):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)] + [(7, 7), (2000, 2001)] * 3
    df = llm.createDataFrame(links, "a long, b long").repartition(7)
    got = dict(map(tuple, connected_components(df).collect()))
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def dense(background, planted, n=4000, dim=64, cosine=0.985):
    """Unit vectors around one centre with planted pairs: the first ``planted`` rows have a partner at the end each."""
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    aside = rng.standard_normal((n, dim))
    aside -= np.outer(aside @ centre, centre)
    x = np.sqrt(background) * centre + np.sqrt(1 - background) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    turn = rng.standard_normal((planted, dim))
    turn -= (turn * x[:planted]).sum(axis=1, keepdims=True) * x[:planted]
    near = cosine * x[:planted] + np.sqrt(1 - cosine**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    return np.concatenate([x, near])


def test_every_planted_pair_of_a_dense_label(llm):
    for label, background in enumerate((0.0, 0.9, 0.95)):
        x = dense(background, 500)
        df = llm.createDataFrame([(i, v, label) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df).collect()}
        near = x @ x.T >= 0.98
        want = connected_components(llm.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)], "a long, b long"))
        least = {i: i for i in range(len(x))} | dict(map(tuple, want.collect()))
        found = sum(got[i][1] == got[4000 + i][1] for i in range(500))
        assert found == 500, (background, found)
        assert got == {i: (int(near[i].sum()) - 1, least[i]) for i in range(len(x))}


def test_small_table_over_many_partitions(llm):
    rows = [(i, v, 1) for i, v in enumerate(dense(0.95, 60, n=240).tolist())]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    given = llm.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "64"):
            llm.conf.set("spark.sql.shuffle.partitions", partitions)
            assert sorted(tuple(r) for r in near_duplicate_vectors(df).collect()) == brute(rows), partitions
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", given)
