"""Random forests of class shares, grown on a stored binned matrix (``binning``).

Every tree takes each row as often as a Poisson draw by (row key, tree) says, and every node
looks at ``ceil(sqrt(features))`` features drawn by its path, so the forest does not depend on
how rows are dealt to tasks.  Splits are weighted-Gini; a node without a gain is a leaf.

Rows never meet in one task: while a node has more than ``ROWS_PER_NODE`` rows its histograms
are summed by Spark, one job a level for all trees; smaller nodes' rows go to a group each
(tree, node), and a task grows the rest of the tree below it.

The nodes stay a table, one row for the top of a tree and one a group.  The driver and the tasks
hold ``NODES_AT_ONCE`` nodes at a time (at least a tree): a forest that has more scores in several passes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators.binning import bins_of, filled
from txnwatch.session import give_back, ship_package, work_dir

ROWS_PER_NODE = 100_000
ROWS_PER_TASK = 500_000        # rows (counted once a tree) of the groups of a task
NODES_AT_ONCE = 2_000_000
HISTOGRAMS = 1024              # nodes whose histograms are summed in one job
NODE = np.dtype([("feature", "i2"), ("bin", "u1"), ("left", "i4"), ("n0", "u4"), ("n1", "u4")])   # right is left + 1
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800)])
_TABLE = "tree int, slot int, nodes binary"


@dataclass(frozen=True)
class ForestSpec:
    trees: int = 100
    max_depth: int = 30
    seed: int = 42


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def root_of(spec: ForestSpec, tree: int) -> np.uint64:
    return _mix(_mix(np.array([spec.seed], np.uint64)) + np.uint64(tree))[0]


def draws(keys: np.ndarray, spec: ForestSpec, tree: int) -> np.ndarray:
    """How often a tree takes each row."""
    u = (_mix(keys.view(np.uint64) ^ root_of(spec, tree)) >> np.uint64(11)).astype(float) / 2.0 ** 53
    return np.searchsorted(_POISSON, u, side="right").astype(np.uint8)


def subsets(paths: np.ndarray, n: int) -> np.ndarray:
    """The features that each node looks at (nodes x subset)."""
    with np.errstate(over="ignore"):
        h = _mix(paths[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.argsort(h, axis=1, kind="stable")[:, :int(np.ceil(np.sqrt(n)))]


def below(paths: np.ndarray) -> np.ndarray:
    """Paths of the (left, right) children, node by node."""
    with np.errstate(over="ignore"):
        return _mix(np.stack([paths * np.uint64(2), paths * np.uint64(2) + np.uint64(1)], axis=1)).ravel()


def _best(node: np.ndarray, bins: np.ndarray, n0: np.ndarray, n1: np.ndarray, weights: tuple) -> tuple:
    """(nodes, gain, bin, rows of each class to the left) of the best cut; entries are sorted by (node, bin)."""
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[first, len(node)])

    def sides(a):
        c = np.cumsum(a)
        left = c - np.repeat(c[first] - a[first], size)
        return left, np.repeat(np.add.reduceat(a, first), size) - left

    def value(a, b):
        a, b = a * weights[0], b * weights[1]
        return np.divide(a * a + b * b, a + b, out=np.zeros(len(a)), where=a + b > 0)

    (l0, r0), (l1, r1) = sides(n0), sides(n1)
    gain = value(l0, l1) + value(r0, r1) - value(l0 + r0, l1 + r1)
    gain[first + size - 1] = -np.inf                               # nothing to the right
    top = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == np.repeat(top, size))
    at = at[np.unique(node[at], return_index=True)[1]]
    scale = (l0 + r0)[at] * weights[0] + (l1 + r1)[at] * weights[1]
    return node[first], np.where(top > 1e-12 * scale, top, 0.0), bins[at], l0[at], l1[at]


def grow(bins: np.ndarray, label: np.ndarray, count: np.ndarray, path: np.uint64, depth: int, spec: ForestSpec, weights: tuple) -> np.ndarray:
    """The nodes below one node, itself first, level by level; ``bins`` is features x rows."""
    n0, n1 = np.where(label == 1, 0.0, count), np.where(label == 1, count, 0.0)
    rows, node, paths, out, done = np.arange(len(label)), np.zeros(len(label), np.int64), np.array([path], np.uint64), [], 0
    while True:
        m = len(paths)
        level = np.zeros(m, NODE)
        level["feature"], level["left"] = -1, -1
        level["n0"], level["n1"] = np.bincount(node, n0[rows], m), np.bincount(node, n1[rows], m)
        out.append(level)
        mixed = (level["n0"] > 0) & (level["n1"] > 0) & (depth < spec.max_depth)
        rows, node = rows[mixed[node]], node[mixed[node]]
        if not len(rows):
            break
        looked, gains, a0, a1 = subsets(paths, len(bins)), np.zeros(m), n0[rows], n1[rows]
        for j in range(looked.shape[1]):
            at = node * 256 + bins[looked[node, j], rows]
            if m * 256 <= 4 * len(rows):
                s0, s1 = np.bincount(at, a0, m * 256), np.bincount(at, a1, m * 256)
                keys = np.flatnonzero(s0 + s1)
                s0, s1 = s0[keys], s1[keys]
            else:
                order = np.argsort(at, kind="stable")
                keys = at[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, s0, s1 = keys[first], np.add.reduceat(a0[order], first), np.add.reduceat(a1[order], first)
            which, gain, cut, _, _ = _best(keys >> 8, keys & 255, s0, s1, weights)
            better = gain > gains[which]
            which = which[better]
            gains[which], level["bin"][which], level["feature"][which] = gain[better], cut[better], looked[which, j]
        split = np.flatnonzero(level["feature"] >= 0)
        level["left"][split] = done + m + 2 * np.arange(len(split))
        goes = level["feature"][node] >= 0
        rows, node = rows[goes], node[goes]
        place = np.zeros(m, np.int64)
        place[split] = 2 * np.arange(len(split))
        node = place[node] + (bins[level["feature"][node], rows] > level["bin"][node])
        paths, done, depth = below(paths[split]), done + m, depth + 1
        if not len(split):
            break
    return np.concatenate(out)


def reached(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The last node of every row (``bins`` is features x rows)."""
    at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    feature, cut, left = nodes["feature"].astype(np.int64), nodes["bin"], nodes["left"].astype(np.int64)
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at[rows] = left[at[rows]] + (bins[f, rows] > cut[at[rows]])
    return at


def _rows(b: pa.RecordBatch, n: int) -> tuple:
    """(keys, labels, bins as features x rows) of a batch of the matrix."""
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, n)
    return b.column("key").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False), np.ascontiguousarray(bins.T)


class _Top:
    """The top of one tree: nodes with many rows, whose open ends get a slot."""

    def __init__(self, path: np.uint64):
        self.nodes, self.paths, self.depth = [(-1, 0, -1, 0, 0)], [path], [0]

    def array(self) -> np.ndarray:
        return np.array(self.nodes, NODE)

    def split(self, k: int, feature: int, cut: int, l0: int, l1: int, n0: int, n1: int) -> tuple:
        left = len(self.nodes)
        self.nodes[k] = (feature, cut, left, n0, n1)
        self.nodes += [(-1, 0, -1, l0, l1), (-1, 0, -1, n0 - l0, n1 - l1)]
        self.paths += list(below(np.array([self.paths[k]], np.uint64)))
        self.depth += [self.depth[k] + 1] * 2
        return left, left + 1


def _histograms(matrix: DataFrame, tops: list, chunk: list, n: int, spec: ForestSpec, weights: tuple) -> list:
    """The best split of every (tree, node) of ``chunk``, rows summed by Spark."""
    looked = subsets(np.array([tops[t].paths[k] for t, k in chunk], np.uint64), n)
    trees: dict = {}
    for i, (t, k) in enumerate(chunk):
        trees.setdefault(t, (tops[t].array(), {}))[1][k] = i
    shared = matrix.sparkSession.sparkContext.broadcast((trees, looked))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, looked = shared.value
        hist = np.zeros((len(looked), looked.shape[1], 2, 256), np.int64)
        for b in batches:
            keys, label, bins = _rows(b, n)
            for t, (nodes, wanted) in trees.items():
                count, at = draws(keys, spec, t), reached(nodes, bins)
                slot = np.full(len(nodes), -1, np.int64)
                slot[list(wanted)] = list(wanted.values())
                order = np.argsort(slot[at], kind="stable")
                own = slot[at][order]
                for i in wanted.values():
                    rows = order[np.searchsorted(own, i):np.searchsorted(own, i, side="right")]
                    for j, f in enumerate(looked[i]):
                        hist[i, j] += np.bincount(label[rows].astype(np.int64) * 256 + bins[f, rows], count[rows], 512).reshape(2, 256).astype(np.int64)
        held = np.flatnonzero(hist.any(axis=(1, 2, 3)))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([hist[i].tobytes() for i in held], pa.binary())], ["i", "hist"])

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = sum(np.frombuffer(h, np.int64) for h in pdf["hist"]).reshape(-1, 2, 256)
        i, best = int(pdf["i"].iloc[0]), (0.0, -1, 0, 0, 0)
        n0, n1 = hist[0].sum(axis=1)
        for j, (s0, s1) in enumerate(hist):
            bins = np.flatnonzero(s0 + s1)
            _, gain, cut, l0, l1 = _best(np.zeros(len(bins), np.int64), bins, s0[bins].astype(float), s1[bins].astype(float), weights)
            if gain[0] > best[0]:
                best = (gain[0], int(shared.value[1][i, j]), int(cut[0]), int(l0[0]), int(l1[0]))
        return pd.DataFrame([(i, *best[1:], int(n0), int(n1))], columns=["i", "f", "b", "l0", "l1", "n0", "n1"])

    parts = matrix.mapInArrow(summed, "i int, hist binary").groupBy("i")
    return parts.applyInPandas(chosen, "i int, f int, b int, l0 long, l1 long, n0 long, n1 long").collect()


def _grow_tops(matrix: DataFrame, total: int, n: int, spec: ForestSpec, weights: tuple, rows_per_node: int) -> list:
    """Tops of all trees, each open end with a slot (its ``left`` is -2 - slot)."""
    tops = [_Top(root_of(spec, t)) for t in range(spec.trees)]
    many, few = [(t, 0) for t in range(spec.trees)], []
    if total <= rows_per_node:
        many, few = few, many
    while many:
        found = []
        for k in range(0, len(many), HISTOGRAMS):
            chunk = many[k:k + HISTOGRAMS]
            found += [(*chunk[r["i"]], r) for r in _histograms(matrix, tops, chunk, n, spec, weights)]
        many = []
        for t, k, r in sorted(found, key=lambda x: x[:2]):
            top = tops[t]
            if r["f"] < 0:
                top.nodes[k] = (-1, 0, -1, r["n0"], r["n1"])
                continue
            for c in top.split(k, r["f"], r["b"], r["l0"], r["l1"], r["n0"], r["n1"]):
                n0, n1 = top.nodes[c][3:]
                if n0 > 0 and n1 > 0 and top.depth[c] < spec.max_depth:
                    (many if n0 + n1 > rows_per_node else few).append((t, c))
    for slot, (t, k) in enumerate(few):
        tops[t].nodes[k] = (-1, 0, -2 - slot, *tops[t].nodes[k][3:])
    return tops


def fit_forest(matrix: DataFrame, features: list[str], cuts: list[np.ndarray], spec: ForestSpec, counts: tuple,
               weights: tuple = (1.0, 1.0), rows_per_node: int | None = None) -> Forest:
    """Fit on a stored ``binning.binned_matrix``; ``counts`` are its (negatives, positives)."""
    spark, n = matrix.sparkSession, len(features)
    ship_package(spark)
    tops = _grow_tops(matrix, sum(counts), n, spec, weights, rows_per_node or ROWS_PER_NODE)
    ends = {-2 - left: (t, k) for t, top in enumerate(tops) for k, (_, _, left, _, _) in enumerate(top.nodes) if left < -1}
    shared = spark.sparkContext.broadcast(([top.array() for top in tops], {s: (tops[t].paths[k], tops[t].depth[k]) for s, (t, k) in ends.items()}))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, label, bins = _rows(b, n)
            rows = np.vstack([bins, label.astype(np.uint8)[None]])
            for t, nodes in enumerate(shared.value[0]):
                count = draws(keys, spec, t)
                slot = -2 - nodes["left"][reached(nodes, bins)].astype(np.int64)
                slot[(count == 0) | (slot < 0)] = -1
                own = np.unique(slot[slot >= 0])
                held = [np.vstack([rows, count[None]])[:, slot == s].T.tobytes() for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t), pa.int32()), pa.array(own, pa.int32()), pa.array(held, pa.binary())], ["tree", "slot", "rows"])
        give_back()

    def grown(table: pa.Table) -> pa.Table:
        tree, slot = table["tree"][0].as_py(), table["slot"][0].as_py()
        rows = np.frombuffer(b"".join(sorted(table["rows"].to_pylist())), np.uint8).reshape(-1, n + 2).T
        path, depth = shared.value[1][slot]
        nodes = grow(np.ascontiguousarray(rows[:n]), rows[n], rows[n + 1].astype(float), path, depth, spec, weights)
        return pa.table({"tree": pa.array([tree], pa.int32()), "slot": pa.array([slot], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary())})

    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(len(ends), max(cores, -(-sum(counts) * spec.trees // ROWS_PER_TASK))))
    path = work_dir(spark, "forest")
    groups = matrix.select("key", "label", "bins").mapInArrow(dealt, "tree int, slot int, rows binary").repartition(tasks, "tree", "slot")
    groups.groupBy("tree", "slot").applyInArrow(grown, _TABLE).write.parquet(path)
    spark.createDataFrame([(t, -1, bytearray(top.array().tobytes())) for t, top in enumerate(tops)], _TABLE).write.mode("append").parquet(path)
    return Forest(list(features), cuts, spec, weights, path)


@dataclass
class Forest:
    """A fitted forest: its nodes are the table at ``path``."""

    features: list
    cuts: list
    spec: ForestSpec
    weights: tuple
    path: str
    unit: str = "probability"

    def passes(self, spark: SparkSession) -> Iterator[list]:
        """Node arrays of all trees, some trees at a time."""
        table = spark.read.parquet(self.path)
        sizes = table.groupBy("tree").agg((F.sum(F.length("nodes")) / NODE.itemsize).alias("n")).orderBy("tree").collect()
        chunk, held = [], 0
        for r in sizes:
            if chunk and held + r["n"] > NODES_AT_ONCE:
                yield self._trees(table, chunk)
                chunk, held = [], 0
            chunk.append(r["tree"])
            held += r["n"]
        if chunk:
            yield self._trees(table, chunk)

    @staticmethod
    def _trees(table: DataFrame, trees: list) -> list:
        parts: dict = {}
        for r in table.where(F.col("tree").isin(trees)).toLocalIterator():
            parts.setdefault(r["tree"], {})[r["slot"]] = np.frombuffer(bytes(r["nodes"]), NODE)
        return [_joined(parts[t]) for t in trees]

    def shares(self, nodes: np.ndarray) -> np.ndarray:
        """Weighted share of class 1 in every node."""
        return _shares(nodes, self.weights)

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """``df`` with the mean share of class 1 in the leaves of its rows."""
        spark, kept = df.sparkSession, len(df.columns)
        ship_package(spark)
        schema = df.withColumn(name, F.lit(0.0)).schema
        out, own = df.withColumn(name, F.lit(0.0)), (self.cuts, self.spec.trees)
        for k, trees in enumerate(self.passes(spark)):
            if k:                                        # the sums so far, before the next trees are sent
                path = work_dir(spark, "scores")
                out.write.parquet(path)
                out = spark.read.schema(schema).parquet(path)
            bc = spark.sparkContext.broadcast((*own, self.weights, trees))
            rows = out.select("*", *[filled(f).alias(f"_x{i}") for i, f in enumerate(self.features)])
            out = rows.mapInArrow(_adder(bc, kept, schema.names), schema)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"features": self.features, "cuts": [c.tolist() for c in self.cuts], "spec": asdict(self.spec), "weights": self.weights}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(path + "/meta")
        spark.read.parquet(self.path).write.mode("overwrite").parquet(path + "/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        meta = json.loads(spark.read.parquet(path + "/meta").first()["meta"])
        return Forest(meta["features"], [np.array(c) for c in meta["cuts"]], ForestSpec(**meta["spec"]), tuple(meta["weights"]), path + "/trees")


def _shares(nodes: np.ndarray, weights: tuple) -> np.ndarray:
    a, b = nodes["n0"] * float(weights[0]), nodes["n1"] * float(weights[1])
    return np.divide(b, a + b, out=np.zeros(len(nodes)), where=a + b > 0)


def _adder(bc, kept: int, names: list):
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, n_trees, weights, trees = bc.value
        for b in batches:
            x = np.stack([b.column(kept + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(cuts))], axis=1)
            bins, total = bins_of(x, cuts), b.column(kept).to_numpy(zero_copy_only=False).copy()
            for nodes in trees:
                total += _shares(nodes[reached(nodes, bins)], weights) / n_trees
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(kept)), pa.array(total)], names)
        give_back()
    return added


def _joined(parts: dict) -> np.ndarray:
    """One tree's nodes: the top, and below its open ends the groups' nodes."""
    top, out = parts[-1].copy(), []
    done = len(top)
    for k in np.flatnonzero(top["left"] < -1):
        part = parts.get(-2 - int(top["left"][k]), np.array([(-1, 0, -1, 0, 0)], NODE)).copy()     # no row was drawn: an empty leaf
        inner = part["left"] >= 0
        part["left"][inner] += done - 1                  # its first node takes the open end's place
        top[k] = part[0]
        out.append(part[1:])
        done += len(part) - 1
    return np.concatenate([top, *out])
