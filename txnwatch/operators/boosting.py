"""Second-order boosted trees and single trees grown on gradient histograms.

The rows of a stored binned matrix (``binning``) are dealt to barrier tasks of at most
``ROWS_PER_TASK`` rows (an exchange costs about a second, as much as a pass over so many
rows, so smaller tasks would only wait).  Each keeps its rows' bins and margins, sums gradients, hessians and rows per (node, feature,
bin), and the tasks add up their sums with ``allGather``; from the same sums every task
finds the same splits.  A fit is one Spark job however many trees it grows, and a lost
executor makes Spark repeat that stage.  (Spark runs barrier stages, so fits of more than
one task, without dynamic allocation only.)

Gradients are rounded to multiples of 2^-20 of the largest weight, so their sums are
exact and the trees do not depend on the number of tasks or the order of the rows.

A tree grows in waves.  A wave takes the open nodes that may be split next, sends their
rows to both children, sums the histograms of the smaller children and subtracts them
from the parents' for the larger ones.  With ``max_leaves`` splits are taken best gain
first; a wave then looks at as many open nodes as splits are left, so the tree is that of
one split at a time in far fewer exchanges.  Without it every split within ``max_depth``
is taken.

Gain of a split is ``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)``, a leaf's value
``-rate * G/(H+l)``.  With the ``mean`` objective (gradient ``-w y``, hessian ``w``) one tree is
the weighted-Gini tree whose leaves are shares of class 1.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators.binning import bins_of, filled
from txnwatch.session import give_back, ship_package

ROWS_PER_TASK = 2_000_000  # a byte a feature: a task holds no more than an ordinary partition
MAX_TASKS = 32             # every task gets every other's sums: more would gather more than they save
FINE = 1 << 20            # steps of a gradient
TOGETHER = 64             # nodes whose histograms are summed in one exchange
ROWS_AT_ONCE = 1 << 17    # rows that are worked on at a time
HELD = 128                # open nodes whose histograms are kept; the children of others are both summed from their rows


@dataclass(frozen=True)
class BoostSpec:
    rounds: int = 150
    rate: float = 0.3
    max_depth: int | None = 6
    max_leaves: int | None = None
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    min_gain: float = 1e-6
    objective: str = "logistic"      # or "mean": one tree of class shares


@dataclass
class BoostedTrees:
    """Nodes of all trees: tree, node (0 is a root), feature (-1: leaf), bin, threshold, left, right, value, cover
    (weight of its rows in the explained unit), gain."""

    features: list
    cuts: list
    base: float
    spec: BoostSpec
    nodes: pd.DataFrame
    weights: tuple = (1.0, 1.0)
    _trees: list = field(default=None, repr=False)

    @property
    def unit(self) -> str:
        return "log_odds" if self.spec.objective == "logistic" else "probability"

    def trees(self) -> list:
        """(feature, bin, left, right, value, depth) arrays of every tree; a leaf points at itself."""
        if self._trees is None:
            self._trees = []
            for _, t in self.nodes.groupby("tree", sort=True):
                t = t.sort_values("node")
                leaf, own = (t["feature"] < 0).to_numpy(), np.arange(len(t))
                left, right = np.where(leaf, own, t["left"]), np.where(leaf, own, t["right"])
                depth = np.zeros(len(t), int)
                for k in own[~leaf]:                       # children come after their parents
                    depth[[left[k], right[k]]] = depth[k] + 1
                self._trees.append((np.maximum(t["feature"].to_numpy(), 0), t["bin"].to_numpy(), left, right, t["value"].to_numpy(), int(depth.max(initial=0))))
        return self._trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values of raw rows (rows x features)."""
        bins, out, rows = bins_of(x, self.cuts), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, left, right, value, depth in self.trees():
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = np.where(bins[feature[at], rows] <= cut[at], left[at], right[at])
            out += value[at]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        m = self.margins(x)
        return 1 / (1 + np.exp(-m)) if self.spec.objective == "logistic" else m

    def importance(self) -> pd.DataFrame:
        """Total gain and number of splits of every feature, largest gain first."""
        splits = self.nodes[self.nodes["feature"] >= 0].groupby("feature")["gain"].agg(["sum", "count"])
        rows = [(f, float(splits["sum"].get(i, 0.0)), int(splits["count"].get(i, 0))) for i, f in enumerate(self.features)]
        return pd.DataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), columns=["feature", "gain", "splits"])

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """``df`` with the probability of class 1."""
        ship_package(df.sparkSession)
        kept = len(df.columns)
        rows = df.select("*", *[filled(f).alias(f"_x{i}") for i, f in enumerate(self.features)])
        schema = df.withColumn(name, F.lit(0.0)).schema
        model = df.sparkSession.sparkContext.broadcast(self)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            for b in batches:
                x = np.stack([b.column(kept + i).to_numpy(zero_copy_only=False) for i in range(len(own.features))], axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(kept)), pa.array(own.probabilities(x))], schema.names)

        return rows.mapInArrow(scored, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"features": self.features, "cuts": [c.tolist() for c in self.cuts], "base": self.base, "spec": asdict(self.spec), "weights": self.weights}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(path + "/meta")
        spark.createDataFrame(self.nodes).write.mode("overwrite").parquet(path + "/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        meta = json.loads(spark.read.parquet(path + "/meta").first()["meta"])
        nodes = spark.read.parquet(path + "/nodes").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        return BoostedTrees(meta["features"], [np.array(c) for c in meta["cuts"]], meta["base"], BoostSpec(**meta["spec"]), nodes, tuple(meta["weights"]))


class _Node:
    """A node whose histogram is known: sums, best split, and the children once they are looked at."""

    __slots__ = ("depth", "hist", "sums", "gain", "feature", "bin", "left_rows", "children")

    def __init__(self, depth: int, hist: np.ndarray, best: tuple):
        self.depth, self.hist, self.children = depth, hist, None
        self.sums = hist[:, 0].sum(axis=1)
        self.gain, self.feature, self.bin, self.left_rows = best


class Grower:
    """Grows trees over the rows of one task; ``exchange`` adds up arrays over all tasks."""

    def __init__(self, bins: np.ndarray, n_bins: int, spec: BoostSpec, exchange=lambda a: a):
        self.bins, self.n_bins, self.spec, self.exchange, self.held = bins, n_bins, spec, exchange, 0

    def parts(self) -> Iterator[slice]:
        for k in range(0, self.bins.shape[1], ROWS_AT_ONCE):
            yield slice(k, k + ROWS_AT_ONCE)

    def _histograms(self, slot_of: np.ndarray, where: np.ndarray, n: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums ([gradient, hessian, rows], node slot, feature, bin) of the rows whose node has a slot."""
        out = np.zeros((3, n, len(self.bins), self.n_bins))
        for part in self.parts():
            own = slot_of[where[part]]
            rows = np.flatnonzero(own >= 0)
            if not len(rows):
                continue
            at = own[rows].astype(np.int64) * self.n_bins
            sums = g[part][rows], h[part][rows], None
            for f, bins in enumerate(self.bins):
                index = at + bins[part][rows]
                for k, weights in enumerate(sums):           # whole numbers: exact in any order
                    out[k, :, f] += np.bincount(index, weights, n * self.n_bins).reshape(n, self.n_bins)
        return self.exchange(out)

    def _best(self, hist: np.ndarray, scale: float) -> list[tuple]:
        """(gain, feature, bin, rows to the left) of every node's best split; gain is -inf without one."""
        return [x for k in range(0, hist.shape[1], 8) for x in self._best_of(hist[:, k:k + 8], scale)]

    def _best_of(self, hist: np.ndarray, scale: float) -> list[tuple]:
        spec, (g, h, n) = self.spec, np.cumsum(hist, axis=3)
        gt, ht, nt = (x[:, :1, -1:] for x in (g, h, n))

        def value(g, h):
            weight = h / scale + spec.l2
            return np.divide((g / scale) ** 2, weight, out=np.zeros(weight.shape), where=weight > 0)

        gain = value(g, h) + value(gt - g, ht - h) - value(gt, ht)
        fits = (np.minimum(n, nt - n) >= max(1, spec.min_rows)) & (np.minimum(h, ht - h) >= spec.min_hessian * scale)
        gain = np.where(fits & (gain > spec.min_gain), gain, -np.inf).reshape(len(n), -1)
        place = gain.argmax(axis=1)
        out = []
        for k, p in enumerate(place.tolist()):
            f, b = divmod(p, self.n_bins)
            out.append((float(gain[k, p]), f, b, float(n[k, f, b])))
        return out

    def grow(self, g: np.ndarray, h: np.ndarray, scale: float) -> tuple[list, np.ndarray, np.ndarray]:
        """The tree's nodes in order of their split (feature, bin, left, right, sums, gain), the node of every row as
        far as nodes were looked at, and the leaf of each of those nodes."""
        spec = self.spec
        where = np.zeros(self.bins.shape[1], np.int32)       # node of every row, as far as nodes are looked at
        root = self._histograms(np.zeros(1, np.int32), where, 1, g, h)
        nodes, self.held = [_Node(0, root[:, 0], self._best(root, scale)[0])], 1
        while True:
            taken, open_ = self._take(nodes)
            if not open_:
                break
            for k in range(0, len(open_), TOGETHER):
                self._look_below(nodes, open_[k:k + TOGETHER], where, g, h, scale)
        return self._tree(nodes, taken), where, self._leaves(nodes, taken)

    def _splittable(self, node: _Node) -> bool:
        return node.gain > -np.inf and (self.spec.max_depth is None or node.depth < self.spec.max_depth)

    def _take(self, nodes: list) -> tuple[list, list]:
        """The splits taken so far, best gain first, and the open nodes to look below next (none: the tree is done)."""
        left = np.inf if self.spec.max_leaves is None else self.spec.max_leaves - 1
        heap, taken, blocked = [(-nodes[0].gain, 0)] if self._splittable(nodes[0]) else [], [], []
        while heap and len(taken) < left:
            gain, k = heapq.heappop(heap)
            if nodes[k].children is None:
                blocked.append(k)
                if self.spec.max_leaves is None:
                    continue
                # the order is known up to here: the best of what is open may come next
                more = [k] + [i for _, i in heap if nodes[i].children is None]
                more.sort(key=lambda i: (-nodes[i].gain, i))
                return taken, more[:int(left - len(taken))]
            taken.append(k)
            for c in nodes[k].children:
                if self._splittable(nodes[c]):
                    heapq.heappush(heap, (-nodes[c].gain, c))
        return taken, blocked

    def _look_below(self, nodes, parents, where, g, h, scale) -> None:
        """Give every parent its two children."""
        slot_of = np.full(len(nodes), -1, np.int32)
        slot_of[parents] = np.arange(len(parents))
        feature, cut = (np.array([getattr(nodes[p], x) for p in parents]) for x in ("feature", "bin"))
        small_left = np.array([2 * nodes[p].left_rows <= nodes[p].sums[2] for p in parents])
        lost = np.array([nodes[p].hist is None for p in parents])
        first = len(nodes)
        for part in self.parts():
            own = slot_of[where[part]]
            rows = np.flatnonzero(own >= 0)
            own = own[rows]
            where[part][rows] = first + 2 * own + (self.bins[:, part][feature[own], rows] > cut[own])
        # rows are found by their node: no slot is kept for each
        small, large = np.full((2, first + 2 * len(parents)), -1, np.int32)
        slots = np.arange(len(parents))
        small[first + 2 * slots + ~small_left] = slots
        large[(first + 2 * slots + small_left)[lost]] = slots[lost]
        hist = self._histograms(small, where, len(parents), g, h)
        other = np.empty_like(hist)
        if lost.any():
            other[:, lost] = self._histograms(large, where, len(parents), g, h)[:, lost]
        for i in np.flatnonzero(~lost):
            other[:, i] = nodes[parents[i]].hist - hist[:, i]
        best = self._best(hist, scale) + self._best(other, scale)
        for i, p in enumerate(parents):
            pair = [(hist[:, i], best[i]), (other[:, i], best[len(parents) + i])]
            for one, split in pair if small_left[i] else pair[::-1]:
                nodes.append(node := _Node(nodes[p].depth + 1, one, split))
                keep = self.held < HELD and self._splittable(node)
                node.hist, self.held = one.copy() if keep else None, self.held + keep
            nodes[p].children = (first + 2 * i, first + 2 * i + 1)
            nodes[p].hist, self.held = None, self.held - (not lost[i])

    @staticmethod
    def _tree(nodes, taken) -> list:
        """Nodes renumbered: the root, then the children of each split in the order taken."""
        number, order = {0: 0}, [0]
        for k in taken:
            for c in nodes[k].children:
                number[c] = len(order)
                order.append(c)
        split = set(taken)
        return [(nodes[k].feature, nodes[k].bin, *(number[c] for c in nodes[k].children), nodes[k].sums, nodes[k].gain) if k in split
                else (-1, 0, -1, -1, nodes[k].sums, 0.0) for k in order]

    @staticmethod
    def _leaves(nodes, taken) -> np.ndarray:
        """Every node's leaf in the numbers of ``_tree``; children that were looked at but not taken count as their parent."""
        number, n = {0: 0}, 1
        for k in taken:
            for c in nodes[k].children:
                number[c] = n
                n += 1
        leaf = np.zeros(len(nodes), np.int32)
        for k, node in enumerate(nodes):                      # parents come first
            leaf[k] = number.get(k, leaf[k])
            for c in node.children or ():
                leaf[c] = leaf[k]
        return leaf


def gathered(batches: Iterator[pa.RecordBatch], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins as features x rows, labels) of (label, bins) batches; no batch is held longer than it is read."""
    data, labels = bytearray(), bytearray()
    for b in batches:
        data += b"".join(b.column(1).to_pylist())
        labels += b.column(0).to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n_features).T), np.frombuffer(labels, np.int32)


def boost(bins: np.ndarray, label: np.ndarray, n_bins: int, spec: BoostSpec, weights: tuple, exchange=lambda a: a) -> Iterator[list]:
    """The trees' nodes, round by round: (feature, bin, left, right, value, cover, gain) lists.

    A row keeps its bins, label and margin and, while a tree grows, its node and two whole numbers of at most
    ``FINE``; all else is worked out for ``ROWS_AT_ONCE`` rows."""
    scale = FINE / max(weights)
    margin = np.full(bins.shape[1], base_of(exchange(np.array([(label == 0).sum(), (label == 1).sum()], float)), spec, weights))
    grower, (g, h) = Grower(bins, n_bins, spec, exchange), np.empty((2, bins.shape[1]), np.int32)
    for _ in range(spec.rounds):
        for part in grower.parts():
            y = label[part]
            w = np.where(y == 1, weights[1], weights[0])
            if spec.objective == "logistic":
                p = 1 / (1 + np.exp(-margin[part]))
                a, b = w * (p - y), w * p * (1 - p)
            else:
                a, b = -w * y, w
            g[part], h[part] = np.rint(a * scale), np.rint(b * scale)
        nodes, where, leaf = grower.grow(g, h, scale)
        values = np.array([-spec.rate * s[0] / (s[1] + spec.l2 * scale) if s[1] + spec.l2 * scale > 0 else 0.0 for *_, s, _ in nodes])
        for part in grower.parts():
            margin[part] += values[leaf[where[part]]]
        yield [(f, b, left, right, float(v), float(s[1] / scale), float(gain))
               for (f, b, left, right, s, gain), v in zip(nodes, values)]


def base_of(counts: np.ndarray, spec: BoostSpec, weights: tuple) -> float:
    """Margin before the first tree: the log-odds of the weighted classes; 0 for shares or a missing class."""
    neg, pos = counts[0] * weights[0], counts[1] * weights[1]
    return float(np.log(pos / neg)) if spec.objective == "logistic" and neg > 0 and pos > 0 else 0.0


def _add_up(context):
    """Sums of arrays over all tasks of a barrier stage, in the order of the tasks."""
    def exchange(a: np.ndarray) -> np.ndarray:
        said = context.allGather(base64.b64encode(zlib.compress(a.tobytes(), 1)).decode())
        return sum(np.frombuffer(zlib.decompress(base64.b64decode(m)), a.dtype) for m in said).reshape(a.shape)
    return exchange


_FITTED = "base double, tree int, node int, feature int, bin int, left int, right int, value double, cover double, gain double"


def fit_boosted(matrix: DataFrame, features: list[str], cuts: list[np.ndarray], spec: BoostSpec, counts: tuple,
                weights: tuple = (1.0, 1.0), tasks: int | None = None) -> BoostedTrees:
    """Fit on a stored ``binning.binned_matrix``; ``counts`` are its (negatives, positives)."""
    spark = matrix.sparkSession
    ship_package(spark)
    n_bins, n_features = max([len(c) for c in cuts], default=0) + 1, len(features)
    slots = spark.sparkContext.defaultParallelism
    tasks = tasks or max(1, min(MAX_TASKS, slots // 2, -(-sum(counts) // ROWS_PER_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get() if tasks > 1 else None
        bins, label = gathered(batches, n_features)
        for k, nodes in enumerate(boost(bins, label, n_bins, spec, weights, _add_up(context) if context else lambda a: a)):
            if context is None or context.partitionId() == 0:
                cols = list(zip(*nodes))
                arrays = [np.full(len(nodes), 0.0), np.full(len(nodes), k, np.int32), np.arange(len(nodes), dtype=np.int32),
                          *(np.array(c, np.int32) for c in cols[:4]), *(np.array(c, float) for c in cols[4:])]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [x.split()[0] for x in _FITTED.split(", ")])
        del bins, label
        give_back()

    dealt = matrix.select("label", "bins", "key").repartition(tasks, "key").select("label", "bins")
    nodes = dealt.mapInArrow(run, _FITTED, barrier=tasks > 1).toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    threshold = [cuts[f][b] if f >= 0 else 0.0 for f, b in zip(nodes["feature"], nodes["bin"])]
    base = base_of(np.array(counts, float), spec, weights)
    return BoostedTrees(list(features), cuts, base, spec, nodes.drop(columns="base").assign(threshold=threshold), weights)
