"""Per-row attribution of model scores, global drivers and reason codes.

Trees (decision tree, forest, boosted): exact path-dependent tree Shapley
values (Lundberg et al., "Consistent individualized feature attribution for tree
ensembles").  For a leaf of value ``v`` with path features ``U``, ``z_j`` the share
of training weight that follows the path's splits on ``j`` and ``o_j`` = 1 when the
row satisfies them, the game's multilinear extension gives

    phi_i = v * (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (z_j (1 - t) + o_j t)

The integrand is a polynomial of degree ``|U| - 1``, so Gauss-Legendre points make
the integral an exact sum.  At each point the products of a path are carried down
the tree, level by level for a batch of rows, and the leaves' terms are summed up
again; the split into a node adds its subtree's sum to its feature's value.  One pass
down and up a tree costs nodes x points a row, shared prefixes are computed once, and
deep trees stay affordable.  It runs inside ``mapInPandas``, so the rows to explain
are spread over tasks; the tree arrays (bounded by the model's size, not the data)
are broadcast.

Units: boosted trees are explained in log-odds; a single tree, a forest and the logistic
pipeline in probability of class 1, the last by sampled coalitions over a background sample
(``explain_sampled``, for any scoring function).  ``linear_attributions`` is the closed form
``w_j (z_j - mean z_j)`` in log-odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from txnwatch.operators.binning import filled
from txnwatch.operators.boosting import BoostedTrees
from txnwatch.operators.forest import Forest
from txnwatch.session import give_back, ship_package, work_dir


@dataclass
class LevelTree:
    """One tree's nodes below the root, level by level; the two children of a split are
    neighbours (left, then right) and follow the order of the splits above them."""

    levels: list        # slices of the arrays below, top level first
    parent: np.ndarray  # place in the level above
    feat: np.ndarray    # the split that leads here: feature,
    thr: np.ndarray     # threshold,
    left: np.ndarray    # and whether this is its left side (x <= threshold)
    share: np.ndarray   # weight share of all splits on this feature down to here
    prev: np.ndarray    # node of the split on the same feature above, -1 if none
    value: np.ndarray   # leaf value in the explained unit
    leaf: np.ndarray
    base: float         # expected value of the tree
    features: int       # most features on one path


def _level_tree(nodes: dict) -> LevelTree:
    """``nodes``: id -> (left, right, feature, threshold, cover, value)."""
    root = 0 if 0 in nodes else min(nodes)
    rows, levels, most = [], [], 0
    above = [(root, -1, {})]                                # node, its row, {feature: row of its last split}
    base = nodes[root][5] if nodes[root][0] < 0 else 0.0
    while True:
        splits = [(k, x) for k, x in enumerate(above) if nodes[x[0]][0] >= 0]
        if not splits:
            break
        begin, below = len(rows), []
        for place, (nid, _, seen) in splits:
            left, right, feat, thr, cover, _ = nodes[nid]
            prev = seen.get(feat, -1)
            for child, is_left in ((left, True), (right, False)):
                share = max(nodes[child][4] / cover if cover > 0 else 0.0, 1e-12)
                is_leaf = nodes[child][0] < 0
                value = nodes[child][5] if is_leaf else 0.0
                if is_leaf and nodes[root][4] > 0:
                    base += value * nodes[child][4] / nodes[root][4]
                below.append((child, len(rows), {**seen, feat: len(rows)}))
                most = max(most, len(below[-1][2]))
                rows.append((place, feat, thr, is_left, share * (rows[prev][4] if prev >= 0 else 1.0), prev, value, is_leaf))
        levels.append(slice(begin, len(rows)))
        above = below
    cols = [np.array(c) for c in zip(*rows)] if rows else [np.zeros(0)] * 8
    return LevelTree(levels, cols[0].astype(int), cols[1].astype(int), cols[2], cols[3].astype(bool), cols[4],
                     cols[5].astype(int), cols[6], cols[7].astype(bool), float(base), most)


def tree_shap(X: np.ndarray, trees: list[LevelTree], n_features: int, max_cells: int = 4_000_000) -> np.ndarray:
    """Attributions (rows x features) of the summed trees for the rows of ``X``."""
    phi = np.zeros((len(X), n_features))
    for t in trees:
        points = max(1, -(-t.features // 2))
        step = max(1, max_cells // max(1, len(t.feat) * points))
        for s in range(0, len(X), step):
            phi[s:s + step] += _one_tree(X[s:s + step], t, n_features, points)
    return phi


def _one_tree(X: np.ndarray, t: LevelTree, n_features: int, points: int) -> np.ndarray:
    x, w = np.polynomial.legendre.leggauss(points)
    at, w = (x + 1) / 2, w / 2
    rows, phi = len(X), np.zeros((len(X), n_features))
    # A node's factor z (1 - t) + o t and its gain (o - z) / factor take two values, by o; with
    # the split on the same feature above (which holds wherever this one does) a step down has
    # three cases: neither holds, only the one above, both.
    # These are worked out for a level at a time: the rows of a chunk share them, and no array but the
    # products spans all nodes and points.
    def factors(z):
        return z * (1 - at), z + (1 - z) * at

    def of_level(level):
        z, prev, first = t.share[level, None], t.prev[level], (t.prev[level] < 0)[:, None]
        (off, on), (before_off, before_on) = factors(z), factors(t.share[prev, None])
        return z, off, on, before_off, before_on, t.share[prev, None], first

    def steps(level):
        _, off, on, before_off, before_on, _, first = of_level(level)
        above_on, above_off = np.where(first, 1.0, before_on), np.where(first, 1.0, before_off)
        return np.stack([off / above_off, off / above_on, on / above_on])

    def gains(level):
        z, off, on, _, before_on, before, first = of_level(level)
        gain_off, gain_on = np.broadcast_to(-1 / (1 - at), off.shape), (1 - z) / on
        gain_above = np.where(first, 0.0, (1 - before) / before_on)
        return w * np.stack([gain_off - np.where(first, 0.0, gain_off), gain_off - gain_above, gain_on - gain_above])

    holds = np.ones((rows, len(t.feat) + 1), np.int8)      # column -1 stands for "no such split above"
    products, down = [], np.ones((rows, 1, points))
    for level in t.levels:
        above = holds[:, t.prev[level]]
        holds[:, level] = ((X[:, t.feat[level]] <= t.thr[level]) == t.left[level]) & above.astype(bool)
        case = above + holds[:, level]
        down = down[:, t.parent[level]] * steps(level)[case, np.arange(case.shape[1])]
        products.append((case, down))
    up = None
    for level in reversed(t.levels):
        case, down = products.pop()
        total = down * t.value[level][None, :, None]
        if up is not None:
            total[:, np.flatnonzero(~t.leaf[level])] = up[:, 0::2] + up[:, 1::2]
        part = np.einsum("rnp,rnp->rn", total, gains(level)[case, np.arange(case.shape[1])])
        for f in np.unique(t.feat[level]):
            phi[:, f] += part[:, t.feat[level] == f].sum(axis=1)
        up = total
    return phi


@dataclass
class TreeExplainer:
    """Broadcastable tree arrays for one fitted tree model."""

    trees: list
    base: float
    n_features: int
    unit: str


def tree_explainer(spark: SparkSession, model, n_features: int) -> TreeExplainer:
    """Level arrays of histogram trees."""
    if isinstance(model, BoostedTrees):
        trees = []
        for _, own in model.nodes.groupby("tree", sort=True):
            columns = (own[c].tolist() for c in ("left", "right", "feature", "threshold", "cover", "value"))
            trees.append(_level_tree(dict(zip(own["node"].tolist(), zip(*columns)))))
        return TreeExplainer(trees, model.base + float(sum(t.base for t in trees)), n_features, model.unit)
    raise TypeError(f"not a tree model: {type(model).__name__}")


def _forest_tree(nodes: np.ndarray, model: Forest) -> LevelTree:
    """Level arrays of one tree of a forest, a level at a time."""
    n = len(model.features)
    cover = nodes["n0"] * float(model.weights[0]) + nodes["n1"] * float(model.weights[1])
    value, left = model.shares(nodes) / model.spec.trees, nodes["left"].astype(np.int64)
    thr, feature = np.zeros(len(nodes)), nodes["feature"].astype(np.int64)
    for f, cuts in enumerate(model.cuts):
        own = feature == f
        thr[own] = cuts[nodes["bin"][own]]
    above, seen, done, most = np.zeros(1, np.int64), np.full((1, n), -1, np.int64), 0, 0
    levels, cols, shares = [], [], np.zeros(0)
    base = float(value[0]) if left[0] < 0 else 0.0
    while True:
        place = np.flatnonzero(left[above] >= 0)
        if not len(place):
            break
        split, m = above[place], 2 * len(place)
        child = np.stack([left[split], left[split] + 1], axis=1).ravel()
        split, place = np.repeat(split, 2), np.repeat(place, 2)
        feat, own, seen = feature[split], np.arange(m), seen[place]
        prev = seen[own, feat]
        seen[own, feat] = done + own
        most = max(most, int((seen >= 0).sum(axis=1).max()))
        share = np.maximum(np.divide(cover[child], cover[split], out=np.zeros(m), where=cover[split] > 0), 1e-12)
        shares = np.concatenate([shares, share * np.where(prev >= 0, shares[prev] if done else 1.0, 1.0)])
        leaf = left[child] < 0
        if cover[0] > 0:
            base += float((value[child] * cover[child])[leaf].sum() / cover[0])
        cols.append((place, feat, thr[split], own % 2 == 0, prev, np.where(leaf, value[child], 0.0), leaf))
        levels.append(slice(done, done + m))
        above, done = child, done + m
    if not cols:
        cols = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]
    place, feat, thr, is_left, prev, value, leaf = (np.concatenate(c) for c in zip(*cols))
    return LevelTree(levels, place, feat, thr, is_left, shares, prev, value, leaf, base, most)


@dataclass
class ForestExplainer:
    """A forest's trees, read from its table some at a time."""

    spark: SparkSession
    model: Forest
    unit: str = "probability"

    @property
    def trees(self) -> list:
        """All trees; for small forests."""
        return [_forest_tree(nodes, self.model) for some in self.model.passes(self.spark) for nodes in some]


def explain_forest(rows: DataFrame, explainer: ForestExplainer, features: list[str], keep: list[str]) -> DataFrame:
    """``explain_trees`` for a forest: the tasks turn some trees at a time into level arrays, one
    after the other, and add up their attributions; between two passes the sums are stored."""
    spark, model, n = rows.sparkSession, explainer.model, len(features)
    ship_package(spark)
    xcols = [f"_x{i}" for i in range(n)]
    out = rows.select(*keep, *[filled(f).alias(x) for f, x in zip(features, xcols)],
                      F.array(*[F.lit(0.0)] * n).alias("phi"), F.lit(0.0).alias("base")).repartition(spark.sparkContext.defaultParallelism)
    schema = StructType([*out.schema.fields[:-2], StructField("phi", ArrayType(DoubleType())), StructField("base", DoubleType())])
    for k, some in enumerate(model.passes(spark)):
        if k:
            path = work_dir(spark, "attributions")
            out.write.parquet(path)
            out = spark.read.schema(schema).parquet(path)
        out = out.mapInPandas(_forest_adder(spark.sparkContext.broadcast((model, some)), xcols), schema)
    return out.select(*keep, "phi", "base")


def _forest_adder(bc, xcols: list):
    def added(batches):
        model, some = bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            x, phi, base = pdf[xcols].to_numpy(dtype=float), np.stack(pdf["phi"].to_list()), 0.0
            for nodes in some:
                tree = _forest_tree(nodes, model)
                phi, base = phi + tree_shap(x, [tree], len(xcols)), base + tree.base
            yield pdf.assign(phi=list(phi), base=pdf["base"] + base)
        give_back()
    return added


def explain_trees(rows: DataFrame, explainer: TreeExplainer, features: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``phi array<double>`` (one per feature) and ``base``.

    Runs as ``mapInPandas``: every task explains its own rows; the tree arrays
    travel once per executor as a broadcast variable.
    """
    spark = rows.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(explainer)
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("_x" + str(i)) for i, f in enumerate(features)]
    # spread the rows over the cores: after a top-k or a sample they sit in one partition
    src = rows.select(*keep, *cols).repartition(spark.sparkContext.defaultParallelism)
    keep_fields = [src.schema[k] for k in keep]
    out_schema = StructType(keep_fields + [StructField("phi", ArrayType(DoubleType())),
                                           StructField("base", DoubleType())])
    xcols = [f"_x{i}" for i in range(len(features))]

    def run(batches):
        ex = bc.value
        for pdf in batches:
            X = pdf[xcols].to_numpy(dtype=float)
            phi = tree_shap(X, ex.trees, ex.n_features)
            out = pdf[keep].copy()
            out["phi"] = list(phi)
            out["base"] = ex.base
            yield out

    return src.mapInPandas(run, out_schema)


def linear_attributions(rows: DataFrame, features: list[str], keep: list[str], weights, centre, scale, background,
                        intercept: float = 0.0) -> DataFrame:
    """Closed form for a linear model on standardised features ``z = (x - centre) / scale``:
    ``phi_j = w_j (z_j - background_j)``, ``base = intercept + sum_j w_j background_j``.
    A feature without spread (scale 0) has z = 0."""
    def z(j, f):
        return (filled(f) - F.lit(float(centre[j]))) / F.lit(float(scale[j])) if scale[j] > 0 else F.lit(0.0)

    phi = F.array(*[F.lit(float(weights[j])) * (z(j, f) - F.lit(float(background[j]))) for j, f in enumerate(features)])
    base = intercept + sum(float(w) * float(m) for w, m in zip(weights, background))
    return rows.select(*keep, phi.alias("phi"), F.lit(float(base)).alias("base"))


def logistic_coefficients(model: PipelineModel, n_features: int) -> tuple:
    """(weights, intercept) of the standardise + logistic pipeline on raw features."""
    scaler = next(s for s in model.stages if isinstance(s, StandardScalerModel))
    lr = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    scale = scaler.std.toArray()
    centre = scaler.mean.toArray() if scaler.getWithMean() else np.zeros(n_features)
    weights = np.divide(lr.coefficients.toArray(), scale, out=np.zeros(n_features), where=scale > 0)
    return weights, float(lr.intercept) - float(weights @ centre)


def explain_linear(rows: DataFrame, model: PipelineModel, background: DataFrame, features: list[str],
                   keep: list[str]) -> DataFrame:
    """``linear_attributions`` of the standardise + logistic pipeline, in log-odds, against the
    mean of ``background``."""
    weights, intercept = logistic_coefficients(model, len(features))
    bg = background.agg(*[F.avg(filled(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    means, n = [bg[f"m{i}"] or 0.0 for i in range(len(features))], len(features)
    return linear_attributions(rows, features, keep, weights, [0.0] * n, [1.0] * n, means, intercept)


PERMUTATIONS = 16       # pairs of an order and its reverse


def sampled_shapley(x: np.ndarray, predict, background: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapley values of one row for any ``predict`` (rows -> scores) and their standard errors.

    The value of a coalition is the mean score of the background rows with its features set to those
    of ``x``.  Every order of the features, and its reverse, sets them one after the other; a feature's
    value is its mean step.  The steps of an order add up, so base and values give the score exactly."""
    n, steps = len(x), []
    for order in orders:
        pair = np.zeros(n)
        for way in (order, order[::-1]):
            rows = np.repeat(background[None], n + 1, axis=0)
            for k, f in enumerate(way):
                rows[k + 1:, :, f] = x[f]
            value = predict(rows.reshape(-1, n)).reshape(n + 1, -1).mean(axis=1)
            pair[way] += np.diff(value) / 2
        steps.append(pair)
    steps = np.array(steps)
    error = steps.std(axis=0, ddof=1) / np.sqrt(len(steps)) if len(steps) > 1 else np.zeros(n)
    return steps.mean(axis=0), error


def explain_sampled(rows: DataFrame, predict, background: DataFrame, features: list[str], keep: list[str],
                    permutations: int = PERMUTATIONS, seed: int = 42) -> DataFrame:
    """``keep`` columns plus ``phi``, ``base`` and ``error`` (standard errors of phi) of any scoring function, in its
    own unit, against the rows of ``background`` (a bounded sample, sent to the tasks).  All rows share the
    same orders, so a repetition gives the same values."""
    spark = rows.sparkSession
    ship_package(spark)
    orders = np.array([np.random.default_rng(seed + k).permutation(len(features)) for k in range(permutations)])
    known = background.select(*[filled(f).alias(f"_x{i}") for i, f in enumerate(features)]).toPandas().to_numpy(float)
    bc = spark.sparkContext.broadcast((predict, known, orders))
    xcols = [f"_x{i}" for i in range(len(features))]
    src = rows.select(*keep, *[filled(f).alias(x) for f, x in zip(features, xcols)]).repartition(spark.sparkContext.defaultParallelism)
    doubles = ArrayType(DoubleType())
    out_schema = StructType([src.schema[k] for k in keep] + [StructField("phi", doubles), StructField("base", DoubleType()), StructField("error", doubles)])

    def run(batches):
        predict, known, orders = bc.value
        base = float(predict(known).mean()) if len(known) else 0.0
        for pdf in batches:
            both = [sampled_shapley(x, predict, known, orders) for x in pdf[xcols].to_numpy(dtype=float)]
            yield pdf[keep].assign(phi=[p for p, _ in both], base=base, error=[e for _, e in both])

    return src.mapInPandas(run, out_schema)


class LogisticScore:
    """Probabilities of a logistic model on raw features."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.intercept)))


def unit_of(model) -> str:
    """The unit in which ``explain`` explains a model."""
    return model.unit if isinstance(model, (BoostedTrees, Forest)) else "probability"


def _last(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def explainer_for(spark: SparkSession, model, features: list[str]):
    """Tree arrays of a tree model (built once, reused for every batch of rows); ``None`` for
    the logistic pipeline, which needs no preparation."""
    last = _last(model)
    if isinstance(last, Forest):
        return ForestExplainer(spark, last)
    return None if isinstance(last, LogisticRegressionModel) else tree_explainer(spark, last, len(features))


def explain(rows: DataFrame, model, features: list[str], keep: list[str],
            background: DataFrame | None = None, prepared=None) -> DataFrame:
    """Dispatch on the fitted model, or the pipeline's last stage."""
    last = _last(model)
    if isinstance(last, LogisticRegressionModel):
        predict = LogisticScore(*logistic_coefficients(model, len(features)))
        return explain_sampled(rows, predict, background if background is not None else rows, features, keep).drop("error")
    ex = prepared if prepared is not None else explainer_for(rows.sparkSession, last, features)
    if isinstance(ex, ForestExplainer):
        return explain_forest(rows, ex, features, keep)
    return explain_trees(rows, ex, features, keep)


def top_reasons(attr: DataFrame, features: list[str], k: int = 3, phi: str = "phi") -> DataFrame:
    """The ``k`` features that push the score up the most (signed values, ties by
    feature order): ``reason_1 .. reason_k`` and ``reason_i_shap``."""
    names = F.array(*[F.lit(f) for f in features])
    idx = F.sequence(F.lit(0), F.lit(len(features) - 1))
    zipped = F.arrays_zip(names.alias("name"), F.col(phi).alias("v"), idx.alias("i"))

    def cmp(x: Column, y: Column) -> Column:
        return (F.when(x["v"] > y["v"], -1).when(x["v"] < y["v"], 1)
                .when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0))

    top = F.slice(F.array_sort(zipped, cmp), 1, k)
    out = attr.withColumn("_top", top)
    for r in range(k):
        out = (out.withColumn(f"reason_{r + 1}", F.col("_top").getItem(r)["name"])
               .withColumn(f"reason_{r + 1}_shap", F.col("_top").getItem(r)["v"]))
    return out.drop("_top")


def mean_abs(attr: DataFrame, features: list[str], phi: str = "phi") -> DataFrame:
    """Global importance: mean |phi| per feature, largest first."""
    ex = attr.select(F.posexplode(phi).alias("i", "v"))
    names = F.array(*[F.lit(f) for f in features])
    return (ex.groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs_shap"))
            .select(F.get(names, F.col("i")).alias("feature"), "mean_abs_shap")
            .orderBy(F.desc("mean_abs_shap"), "feature"))


def case_breakdown(attr_row: DataFrame, features: list[str], phi: str = "phi") -> DataFrame:
    """One explained row as ``feature, contribution, base``, every feature, largest effect
    first: base and contributions add up to the score."""
    names = F.array(*[F.lit(f) for f in features])
    ex = attr_row.select("base", F.posexplode(phi).alias("i", "contribution"))
    return (ex.select(F.get(names, F.col("i")).alias("feature"), "contribution", "base")
            .orderBy(F.desc(F.abs("contribution")), "feature"))


def attribution_points(attr: DataFrame, rows: DataFrame, features: list[str], key: str, phi: str = "phi") -> DataFrame:
    """``key, feature, value, attribution``: one point per explained row and feature."""
    values = rows.select(key, F.array(*[filled(f) for f in features]).alias("_x"))
    names = F.array(*[F.lit(f) for f in features])
    both = attr.select(key, phi).join(values, key)
    points = both.select(key, F.explode(F.arrays_zip(names.alias("f"), F.col("_x").alias("v"), F.col(phi).alias("a"))).alias("p"))
    return points.select(key, F.col("p.f").alias("feature"), F.col("p.v").alias("value"), F.col("p.a").alias("attribution"))
