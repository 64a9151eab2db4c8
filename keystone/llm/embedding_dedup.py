"""Embedding near-duplicates by comparing all vectors of a label, block against block.

The distinct vectors of a label are dealt into blocks by a hash; each pair of
blocks is one matrix product in double precision, on whichever executor. A pair
of blocks gives the number of links of each vector, which is summed, and a
spanning forest of its links, which are united into components. Nothing limits
which vectors are compared, so links and components are exact; the work grows
with the square of the distinct vectors of a label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import scratch_table
from keystone.llm.components import connected_components


def usable(vec) -> bool:
    """Not null, without null or non-finite components, not zero, not empty."""
    if vec is None or len(vec) == 0:
        return False
    a = np.asarray(vec, dtype=object)
    if any(x is None for x in a):
        return False
    a = a.astype(np.float64)
    return bool(np.isfinite(a).all() and (a != 0).any())


def _unit(rows) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clean(batches):
    for pdf in batches:
        keep = pdf[[usable(v) for v in pdf["embedding"]]]
        # scaled by the largest component, so that squares neither overflow nor vanish
        vec = [(a := np.asarray(v, dtype=np.float64)) / np.abs(a).max() for v in keep["embedding"]]
        yield pd.DataFrame({"uid": keep["uid"], "label": keep["label"], "vec": [v.tobytes() for v in vec],
                            "dim": [len(v) for v in vec]})


def _forest(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows and columns of hits that connect whatever all hits connect; each row and column is visited once."""
    by_column = np.ascontiguousarray(hit.T)
    rows, columns = hit.any(axis=1), by_column.any(axis=1)  # those not reached yet
    a, b = [], []
    for start in np.flatnonzero(rows).tolist():
        queue = [start] if rows[start] else []
        rows[start] = False
        while queue:
            r = queue.pop()
            reached = np.flatnonzero(hit[r] & columns).tolist()
            columns[reached] = False
            for c in reached:
                more = np.flatnonzero(by_column[c] & rows).tolist()
                rows[more] = False
                a += [r, *more]
                b += [c] * (1 + len(more))
                queue += more
    return a, b


def _compared(cosine: float):
    """Block i with block j: (a, null, links of a in the other block, copies counted) and (a, b, 0) for links that connect them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["mine"] == i], pdf[pdf["mine"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "linked": []})
        hit = _unit(left["vec"]) @ _unit(right["vec"]).T >= cosine
        if i == j:
            np.fill_diagonal(hit, False)
        x, y = left["uid"].to_numpy(), right["uid"].to_numpy()
        out = []
        for uid, hits, size in ((x, hit, right["size"]), (y, hit.T, left["size"]))[:1 if i == j else 2]:
            linked = (hits * size.to_numpy()).sum(axis=1)
            out.append(pd.DataFrame({"a": uid, "b": pd.NA, "linked": linked})[linked > 0])
        a, b = _forest(hit)
        out.append(pd.DataFrame({"a": x[a], "b": y[b], "linked": 0}))
        return pd.concat([p.astype({"a": "int64", "b": "Int64", "linked": "int64"}) for p in out])
    return run


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = 0.98, block_rows: int = 2048) -> DataFrame:
    """``embeddings`` (vec_id, embedding, label) to (vec_id, n_links, component_id, kept), one row each.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    vectors without a label, link with nothing: n_links 0 and their own vec_id as
    component. Vectors of different length never link. Repeated rows link with
    each other (cosine 1); rows that repeat a vec_id are separate vectors with the
    same id. Other columns are ignored. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    base = scratch_table(embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
                         .withColumn("uid", F.monotonically_increasing_id()), "vec-rows")
    clean = base.where("label is not null and embedding is not null").mapInPandas(
        _clean, "uid long, label string, vec binary, dim int")
    # Exact copies collapse to their least row first; a copy links with all others of its set.
    classes = scratch_table(clean.groupBy("label", "dim", "vec").agg(F.min("uid").alias("rep"), F.count("*").alias("size")),
                            "vec-classes")
    copies = clean.join(classes, ["label", "dim", "vec"]).select("uid", "rep", "size")
    vectors = classes.select(F.col("rep").alias("uid"), "label", "dim", "vec", "size")

    sizes = vectors.groupBy("label", "dim").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    parts = vectors.join(sizes, ["label", "dim"]).withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    # each block meets itself and each other block of its label once
    pairs = parts.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("label", "dim", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j"), "mine", "uid", "vec", "size")
    found = scratch_table(pairs.groupBy("label", "dim", "i", "j").applyInPandas(_compared(cosine), "a long, b long, linked long"), "vec-links")
    comps = scratch_table(connected_components(found.where("b is not null").select("a", "b")), "vec-components")
    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("linked").alias("linked"))

    root = comps.select(F.col("node").alias("rep"), "component")
    per_copy = copies.join(root, "rep", "left").join(linked, "rep", "left").select(
        "uid", F.coalesce("component", "rep").alias("component"),
        (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    per_row = base.select("uid", "vec_id").join(per_copy, "uid", "left").select(
        "uid", "vec_id", F.coalesce("component", "uid").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    per_row = scratch_table(per_row, "vec-result")
    ids = per_row.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return per_row.join(ids, "component").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id",
                                                 (F.col("vec_id") == F.col("component_id")).alias("kept"))
