"""M8 for many rows: the random forest of ``pyspark.ml`` grown from counts of binned rows.

The same learner as ``RandomForestClassifier`` for two classes: bins between weighted
quantiles, Poisson(1) bootstrap counts for each tree, a random subset of features for
each node, Gini gain of the class weights, least rows of a leaf, leaves of one prediction
merged, importances by weighted gain. It differs in how the work is laid out:

* A training row is a byte for each feature (its bin and class). Blocks of rows are stored
  once; every pass reads them, and only them.
* A level is one pass of all trees: a task sends, for each open node, the rows of its
  blocks by feature, bin and class; they are summed and split by (tree, nodes). A task
  holds its blocks and the counts of one tree, however many rows or trees there are.
* Bootstrap counts are drawn anew in each pass, from a seed of (block, tree).

Counts are whole numbers and rows are dealt by their ids, so that the forest does not depend on
the order of sums or on the partitions that rows came from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from keystone.session import materialize

#: Bins of a feature, and values of a partition and class that they are chosen from.
BINS, GRID = 32, 1000
#: Rows of a block at most (its bytes stay in a core's cache), and open nodes of one message.
BLOCK_ROWS, NODES = 65_536, 128
#: A leaf: no row's byte is above it, so that rows stay where they are.
LEAF = 255
#: A random 16-bit number's Poisson(1) count.
POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]),
                          (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)

#: Types of a tree's arrays, as they are stored.
KINDS = {"feature": "<i2", "cut": "|u1", "child": "<i8", "gain": "<f8", "rows": "<i8"}


@dataclass
class Tree:
    """Nodes by level: a row at node ``i`` goes on to ``child[i]``, or the next one if its
    feature's byte is above ``cut[i]`` (``LEAF``: it stays)."""
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    gain: np.ndarray
    rows: np.ndarray                  # by class, with their bootstrap counts

    @staticmethod
    def leaves(rows: np.ndarray, first: int = 0) -> Tree:
        n = len(rows)
        return Tree(np.zeros(n, np.int16), np.full(n, LEAF, np.uint8), np.arange(first, first + n), np.zeros(n), rows)

    def grown(self, more: Tree) -> Tree:
        return Tree(*(np.concatenate(x) for x in zip(vars(self).values(), vars(more).values())))

    @property
    def path(self) -> tuple[np.ndarray, ...]:
        """What rows need to find their nodes."""
        return self.feature, self.cut, self.child.astype(np.int32)

    @property
    def depth(self) -> int:
        level = np.zeros(len(self.cut), int)
        for i in np.flatnonzero(self.cut != LEAF):            # parents stand before their children
            level[self.child[i]:self.child[i] + 2] = level[i] + 1
        return int(level.max())


@dataclass
class Forest:
    """A trained forest; ``cuts``: for each feature, the upper ends of its bins but the last."""
    trees: list[Tree]
    cuts: list[np.ndarray]
    weights: tuple[float, float]

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:
        """Weighted gain by feature, a share of each tree's, then of all."""
        total = np.zeros(len(self.cuts))
        for t in self.trees:
            inner = t.cut != LEAF
            one = np.bincount(t.feature[inner], t.gain[inner] * (t.rows[inner] @ np.array(self.weights)), minlength=len(total))
            total += one / one.sum() if one.sum() > 0 else 0.0
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def score(self, df: DataFrame, feats: list[str]) -> DataFrame:
        """``df`` with score and prediction: the mean of the trees' shares of class 1; a tie is class 0."""
        schema = StructType([*df.schema.fields]).add("score", DoubleType()).add("prediction", LongType())
        trees = [(t.path, t.depth, _share(t.rows, self.weights)[1]) for t in self.trees if t.rows[0].any()]
        cuts, out = self.cuts, df.columns

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, votes = np.arange(b.num_rows), np.zeros(b.num_rows)
                x = _bytes([b.column(f) for f in map(out.index, feats)], cuts, np.zeros(b.num_rows, np.uint8))
                for path, depth, share in trees:
                    votes += share.take(_nodes(path, x, rows, b.num_rows, depth))
                votes /= max(len(trees), 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(votes), pa.array((votes > 0.5).astype(np.int64))], [*out, "score", "prediction"])

        return df.mapInArrow(scored, schema)

    def save(self, path: str) -> None:
        """A row for each tree, and the bins and weights, as Parquet tables below ``path``."""
        spark = SparkSession.active()
        trees = [(i, *(bytearray(getattr(t, c).astype(kind).tobytes()) for c, kind in KINDS.items())) for i, t in enumerate(self.trees)]
        bins = [(f, i, float(v)) for f, cuts in enumerate(self.cuts) for i, v in enumerate(cuts)]
        bins += [(-1, k, float(w)) for k, w in enumerate(self.weights)] + [(-2, 0, float(len(self.cuts)))]
        spark.createDataFrame(trees, ", ".join(["tree long", *(f"{c} binary" for c in KINDS)])).coalesce(1).write.parquet(f"{path}/trees")
        spark.createDataFrame(bins, "feature long, pos long, value double").coalesce(1).write.parquet(f"{path}/bins")

    @staticmethod
    def load(path: str) -> Forest:
        spark = SparkSession.active()
        trees = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r.tree)      # the model itself
        bins: dict[int, list] = {}
        for r in sorted(spark.read.parquet(f"{path}/bins").collect()):
            bins.setdefault(r.feature, []).append(r.value)
        nodes = [{c: np.frombuffer(bytes(r[c]), kind) for c, kind in KINDS.items()} for r in trees]
        return Forest([Tree(**{**t, "rows": t["rows"].reshape(-1, 2)}) for t in nodes],
                      [np.array(bins.get(f, [])) for f in range(int(bins[-2][0]))], tuple(bins[-1]))


def fit(train: DataFrame, label: str, feats: list[str], id_cols: list[str], weights: dict, num_trees: int,
        max_depth: int, min_leaf: int, partitions: int, seed: int) -> Forest:
    """A forest for classes 0 and 1 of ``label``; the dealt rows are read twice, their blocks once for each level."""
    w, seed = (weights.get(0, 0.0), weights.get(1, 0.0)), seed % (1 << 32)
    rows = materialize(dealt(train, label, feats, id_cols, partitions), "train-x")
    cuts = bin_ends(rows, label, feats, w)
    blocks = materialize(_blocks(rows, feats, cuts), "train-blocks")
    trees, subset = [Tree.leaves(np.zeros((1, 2), np.int64)) for _ in range(num_trees)], math.ceil(math.sqrt(len(feats)))
    opened = [np.zeros(1, int) for _ in trees]                        # of each tree, the nodes to split
    for level in range(max_depth):
        rng = np.random.default_rng([seed, level])
        tried = [np.sort(rng.random((len(o), len(feats))).argsort(axis=1)[:, :subset], axis=1).astype(np.int16) for o in opened]
        best = _best_splits(blocks, trees, opened, tried, level, w, min_leaf, seed)
        for t, found in best.items():
            if level == 0:
                trees[t].rows[0] = found["rows"][0]
            trees[t], opened[t] = _split(trees[t], opened[t], tried[t], found, last=level + 1 == max_depth)
        opened = [o if t in best else o[:0] for t, o in enumerate(opened)]
        if not any(map(len, opened)):
            break
    return Forest([_pruned(t, w) for t in trees], cuts, w)


def dealt(train: DataFrame, label: str, feats: list[str], id_cols: list[str], partitions: int) -> DataFrame:
    """Features and label, dealt by a hash of the ids and in their order."""
    return train.repartition(partitions, *id_cols).sortWithinPartitions(*id_cols, *feats, label).select(*feats, label)


def bin_ends(rows: DataFrame, label: str, feats: list[str], w: tuple[float, float]) -> list[np.ndarray]:
    """Of each feature, up to 31 values between those of equal shares of the weight: half way
    between all values, if they are few.

    A partition tells 1001 quantiles of each class, made from all of its rows, with the weight they
    stand for; a feature's are put together in the order of partitions."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        columns = [np.concatenate(c) for c in zip(*own)]
        for f, x in enumerate(columns[:-1]):
            values, mass = [], []
            for k in (0, 1):
                x_k = np.sort(x[columns[-1] == k])
                some = x_k if len(x_k) <= GRID else x_k[np.linspace(0, len(x_k) - 1, GRID + 1).round().astype(int)]
                values.append(some)
                mass.append(np.full(len(some), w[k] * len(x_k) / max(len(some), 1)))
            yield pa.RecordBatch.from_pydict({"f": pa.array([f], pa.int32()), "part": pa.array([part], pa.int32()),
                                              "v": pa.array([np.concatenate(values).tobytes()], pa.binary()), "m": pa.array([np.concatenate(mass).tobytes()], pa.binary())})

    def together(key, told):
        told = told.sort_values("part")
        values, of = np.unique(np.frombuffer(b"".join(told["v"])), return_inverse=True)
        return told[["f"]].head(1).assign(ends=ends_between(values, np.bincount(of, np.frombuffer(b"".join(told["m"])))).tobytes())

    found = rows.mapInArrow(told, "f int, part int, v binary, m binary").groupBy("f").applyInPandas(together, "f int, ends binary").collect()
    ends = {r.f: np.frombuffer(bytes(r.ends)) for r in found}
    return [ends.get(f, np.array([])) for f in range(len(feats))]


def ends_between(values: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Half way between all values, or where shares of the mass come nearest to 1/32, 2/32, ..."""
    between = (values[:-1] + values[1:]) / 2
    if len(between) < BINS:
        return between
    step = mass.sum() / BINS
    passed, wanted, some = mass[0], step, []
    for i, more in enumerate(mass[1:].tolist()):
        before, passed = passed, passed + more
        if abs(before - wanted) < abs(passed - wanted):
            some.append(between[i])
            wanted += step
    return np.array(some[:BINS - 1])


def _bytes(columns: list[pa.Array], cuts: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Row by row of each feature, one after the other: twice its bin, and its class."""
    return np.concatenate([np.searchsorted(c, x.to_numpy(zero_copy_only=False)).astype(np.uint8) * 2 + classes for x, c in zip(columns, cuts)])


def _blocks(rows: DataFrame, feats: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """(block, n, x): the rows that ``dealt`` has made, in bytes."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        parts = [_bytes(b.columns[:-1], cuts, b.column(len(feats)).to_numpy().astype(np.uint8)).reshape(len(feats), -1) for b in batches]
        if parts:
            x = np.concatenate(parts, axis=1)
            for k, own in enumerate(np.array_split(x, max(1, -(-x.shape[1] // BLOCK_ROWS)), axis=1)):
                yield pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + k]), "n": pa.array([own.shape[1]]), "x": pa.array([own.tobytes()], pa.binary())})

    return rows.mapInArrow(block, "block long, n long, x binary")


def _nodes(path: tuple[np.ndarray, ...], x: np.ndarray, rows: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The node at which each of the rows is after ``depth`` steps."""
    feature, cut, child = path
    offset, child = feature.astype(np.intp) * n, child.astype(np.intp)
    at = np.zeros(len(rows), np.intp)
    for _ in range(depth):
        place = offset.take(at)
        place += rows
        right = x.take(place) > cut.take(at)
        at = child.take(at)
        at += right
    return at


def _best_splits(blocks: DataFrame, trees: list[Tree], opened: list[np.ndarray], tried: list[np.ndarray], level: int,
                 w: tuple[float, float], min_leaf: int, seed: int) -> dict[int, dict[str, np.ndarray]]:
    """For each tree with open nodes, their best splits in order (``place``: the feature's place among those tried)."""
    paths = [t.path for t in trees]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b, n, np.frombuffer(x, np.uint8)) for batch in batches for b, n, x in zip(*(c.to_pylist() for c in batch.columns))]
        for t, path in enumerate(paths if own else []):
            if not len(opened[t]):
                continue
            slot_of = np.full(len(path[0]), -1, np.intp)
            slot_of[opened[t]] = np.arange(len(opened[t]))
            size = len(opened[t]) * 2 * BINS
            sums = np.zeros((tried[t].shape[1], size))
            for block, n, x in own:
                times = POISSON.take(np.random.Generator(np.random.SFC64([seed, t, block & 0xFFFFFFFF, block >> 32])).integers(0, 1 << 16, n, np.uint16))
                rows = np.flatnonzero(times > 0)
                slot = slot_of.take(_nodes(path, x, rows, n, level))
                if (slot < 0).any():
                    rows, slot = rows[slot >= 0], slot[slot >= 0]
                times = times.take(rows).astype(np.float64)
                base = slot * (2 * BINS)
                for j, feature in enumerate(tried[t].T):
                    place = (feature.astype(np.intp) * n).take(slot)
                    place += rows
                    sums[j] += np.bincount(x.take(place) + base, times, size)
            counts = sums.astype(np.int32).reshape(len(sums), -1, 2 * BINS)
            cells = [np.ascontiguousarray(counts[:, k:k + NODES]).tobytes() for k in range(0, counts.shape[1], NODES)]
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t] * len(cells), pa.int32()), "part": pa.array(range(len(cells)), pa.int32()),
                                              "cells": pa.array(cells, pa.binary())})

    m = tried[0].shape[1]

    def best(key, rows):
        counts = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in rows["cells"])
        place, cut, gain, left, all_ = best_of(counts.reshape(m, -1, BINS, 2), w, min_leaf)
        return rows[["tree", "part"]].head(1).assign(place=place.tobytes(), cut=cut.tobytes(), gain=gain.tobytes(), left=left.tobytes(), rows=all_.tobytes())

    found = blocks.mapInArrow(count, "tree int, part int, cells binary").groupBy("tree", "part").applyInPandas(
        best, "tree int, part int, place binary, cut binary, gain binary, left binary, rows binary").collect()        # a few numbers a node
    kinds = {"place": np.int64, "cut": np.int64, "gain": np.float64, "left": np.int64, "rows": np.int64}
    out: dict[int, dict[str, np.ndarray]] = {}
    for t in {r["tree"] for r in found}:
        parts = sorted((r for r in found if r["tree"] == t), key=lambda r: r["part"])
        out[t] = {k: np.concatenate([np.frombuffer(r[k], kind) for r in parts]) for k, kind in kinds.items()}
        out[t] |= {k: out[t][k].reshape(-1, 2) for k in ("left", "rows")}
    return out


def best_of(counts: np.ndarray, w: tuple[float, float], min_leaf: int) -> tuple[np.ndarray, ...]:
    """Of counts by (feature tried, node, bin, class): each node's best feature and bin, its gain
    (none above 0: no split), and rows by class left of it and in all."""
    m, nodes = counts.shape[:2]
    left = counts.cumsum(axis=2)[:, :, :-1]
    all_ = counts[0].sum(axis=1)
    right = all_[None, :, None] - left

    def weighed(rows):
        by_class = rows * np.array(w)
        total = by_class.sum(axis=-1)
        share = by_class / np.where(total > 0, total, 1.0)[..., None]
        return total, 1.0 - (share ** 2).sum(axis=-1)

    (total, impurity), (l_total, l_impurity), (r_total, r_impurity) = weighed(all_), weighed(left), weighed(right)
    whole = np.where(total > 0, total, 1.0)[None, :, None]
    gain = impurity[None, :, None] - l_total / whole * l_impurity - r_total / whole * r_impurity
    gain = np.where((left.sum(axis=-1) >= min_leaf) & (right.sum(axis=-1) >= min_leaf), gain, -1.0)
    by_node = gain.transpose(1, 0, 2).reshape(nodes, -1)
    top = by_node.argmax(axis=1)
    place, cut = top // (BINS - 1), top % (BINS - 1)
    every = np.arange(nodes)
    return place, cut, by_node[every, top], left[place, every, cut], all_


def _split(t: Tree, opened: np.ndarray, tried: np.ndarray, found: dict[str, np.ndarray], last: bool) -> tuple[Tree, np.ndarray]:
    """The tree with the children of its open nodes, and those to split next: of both classes, above the last level."""
    good = np.flatnonzero(found["gain"] > 0)
    nodes, size = opened[good], len(t.cut)
    t.feature[nodes] = tried[good, found["place"][good]]
    t.cut[nodes] = 2 * found["cut"][good] + 1                 # a byte is twice its bin, and the class
    t.child[nodes] = size + 2 * np.arange(len(good))
    t.gain[nodes] = found["gain"][good]
    left = found["left"][good]
    rows = np.stack([left, found["rows"][good] - left], axis=1).reshape(-1, 2)
    next_ = size + np.flatnonzero((rows > 0).all(axis=1))
    return t.grown(Tree.leaves(rows, size)), next_[:0] if last else next_


def _share(rows: np.ndarray, w: tuple[float, float]) -> np.ndarray:
    """Shares of the two classes at each node."""
    by_class = (rows * np.array(w)).T
    total = by_class.sum(axis=0)
    return by_class / np.where(total > 0, total, 1.0)


def _pruned(t: Tree, w: tuple[float, float]) -> Tree:
    """Two leaves of one prediction become their parent's; nodes that are left keep their order."""
    share = _share(t.rows, w)
    says = share[1] > share[0]
    cut = t.cut.copy()
    for i in np.flatnonzero(cut != LEAF)[::-1]:               # children stand behind their parents
        a = t.child[i]
        if cut[a] == LEAF and cut[a + 1] == LEAF and says[a] == says[a + 1]:
            cut[i] = LEAF
    kept = np.zeros(len(cut), bool)
    kept[0] = True
    for i in np.flatnonzero(cut != LEAF):
        if kept[i]:
            kept[t.child[i]:t.child[i] + 2] = True
    number = kept.cumsum() - 1
    child = np.where(cut == LEAF, np.arange(len(cut)), t.child)
    inner = cut != LEAF
    return Tree(np.where(inner, t.feature, 0).astype(np.int16)[kept], cut[kept], number[child][kept], np.where(inner, t.gain, 0.0)[kept], t.rows[kept])
