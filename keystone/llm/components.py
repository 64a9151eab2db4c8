"""Connected components by contraction, without collecting links anywhere.

Links are first reduced inside each partition to a spanning star per locally
connected set. Then, in rounds, every vertex hooks onto the least vertex (by a
hash) among itself and its neighbours and links are rewritten to those. The
expected number of vertices falls by a constant factor a round, chains included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import discard, scratch_table


def local_stars(batches):
    """Links (a, b) of a partition to links (vertex, least vertex of its local set)."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(v, r) for v in list(parent) if (r := find(v)) != v]
    if out:
        arr = np.array(out, dtype=np.int64)
        yield pd.DataFrame({"a": arr[:, 0], "b": arr[:, 1]})


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node long, component long = least node).

    Nodes are those that some link names; links to itself and repeated links
    are ignored; no links give an empty result. The first round hooks by the ids
    themselves, which are already stars to the least one; later rounds by a hash, which
    no order of ids can slow down.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = scratch_table(links.mapInPandas(local_stars, "a long, b long").distinct(), "cc-links")
    nodes, hooks = edges, []
    while not edges.isEmpty():
        rank = (lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))) if hooks else \
            (lambda c: F.struct(F.col(c).alias("h"), F.col(c).alias("v")))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch_table(both.groupBy("a").agg(F.min(rank("b")).alias("m"))
                             .select(F.col("a").alias("v"), F.least(rank("a"), "m")["v"].alias("p")), "cc-hooks")
        hooks.append(hook)
        ha, hb = (hook.select(F.col("v").alias(c), F.col("p").alias("p" + c)) for c in "ab")
        rest = scratch_table(edges.join(ha, "a").join(hb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
                             .where("a <> b").mapInPandas(local_stars, "a long, b long").distinct(), "cc-links")
        if edges is not nodes:
            discard(edges)
        edges = rest
    labels = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cur", F.col("node"))
    for hook in hooks:
        labels = labels.join(hook, labels["cur"] == hook["v"], "left").select("node", F.coalesce("p", "cur").alias("cur"))
    labels = scratch_table(labels, "cc-labels")
    for table in ([nodes] if edges is nodes else [nodes, edges]) + hooks:
        discard(table)
    least = labels.groupBy("cur").agg(F.min("node").alias("component"))
    return labels.join(least, "cur").select("node", "component")
