"""What each feature adds to the score of a tree ensemble: exact path-dependent Shapley values.

A row's contributions and the expected score add up to its score. The nodes come from the saved
model's own table. Every leaf holds its path as one interval and one cover share per feature; a row
meets a subset of the intervals, and the contributions of each subset follow from the leaf alone. So the
work per row and leaf is a few comparisons and a lookup, done over whole Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moralens.operators.models import fit_tasks
from moralens.staging import staging_root

#: Up to so many features on a path, the contributions of all subsets are kept.
TABLE_FEATURES = 10


@dataclass
class Leaf:
    """value: what the leaf adds to the score; per feature on its path: index, interval (low, high], cover share."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    table: np.ndarray | None = None

    @property
    def expected(self) -> float:
        return self.value * float(np.prod(self.share))


def subset_weights(share: np.ndarray, met: np.ndarray) -> np.ndarray:
    """(n, m) contributions per unit of leaf value, for n patterns of which of m intervals a row meets.

    Feature i's is (met_i - share_i) times the mean, over the orders of all features, of the product of
    ``met`` for those before it and ``share`` for those behind.
    """
    n, m = met.shape
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty((n, m))
    for i in range(m):
        # coefficients by how many features stand before i
        by_count = np.zeros((n, m))
        by_count[:, 0] = 1.0
        for j in range(m):
            if j != i:
                moved = by_count[:, :-1] * met[:, j, None]
                by_count *= share[j]
                by_count[:, 1:] += moved
        out[:, i] = (met[:, i] - share[i]) * (by_count @ weight)
    return out


def _patterns(codes: np.ndarray, m: int) -> np.ndarray:
    return ((codes[:, None] >> np.arange(m)) & 1).astype(float)


def leaf_contributions(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """(rows, features of the leaf's path)"""
    m = len(leaf.features)
    code = np.zeros(len(x), dtype=np.int64)
    for j, f in enumerate(leaf.features):
        code |= ((x[:, f] > leaf.low[j]) & (x[:, f] <= leaf.high[j])).astype(np.int64) << j
    if m <= TABLE_FEATURES:
        if leaf.table is None:
            leaf.table = leaf.value * subset_weights(leaf.share, _patterns(np.arange(1 << m), m))
        return leaf.table[code]
    seen, at = np.unique(code, return_inverse=True)
    return leaf.value * subset_weights(leaf.share, _patterns(seen, m))[at]


def leaves_of(nodes: dict[int, dict], scale: float, value) -> list[Leaf]:
    """Leaves of one tree from its rows by node id; leaves of no rows are left out."""
    found = []

    def walk(number: int, path: dict[int, tuple[float, float, float]]) -> None:
        node = nodes[number]
        if node["leftChild"] < 0:
            names = sorted(path)
            low, high, share = (np.array([path[f][k] for f in names], dtype=float) for k in range(3))
            found.append(Leaf(scale * value(node), np.array(names, dtype=np.int64), low, high, share))
            return
        split = node["split"]
        if split["numCategories"] >= 0:
            raise ValueError("contributions need numeric splits")
        feature, threshold = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(feature, (-inf, inf, 1.0))
        for child, bounds in (("leftChild", (low, min(high, threshold))), ("rightChild", (max(low, threshold), high))):
            part = nodes[node[child]]["rawCount"] / node["rawCount"]
            if part > 0:
                walk(node[child], path | {feature: (*bounds, share * part)})

    walk(0, {})
    return found


def ensemble_leaves(spark: SparkSession, fitted: PipelineModel) -> list[Leaf]:
    """All leaves of a boosted or forest classifier, the last stage of ``fitted``."""
    model = fitted.stages[-1]
    if isinstance(model, GBTClassificationModel):
        weights, value = list(model.treeWeights), lambda node: node["prediction"]
    elif isinstance(model, RandomForestClassificationModel):
        # a forest's probability is the mean over trees of the leaf's share of positives
        weights = [1.0 / model.getNumTrees] * model.getNumTrees
        value = lambda node: node["impurityStats"][1] / sum(node["impurityStats"])
    else:
        raise ValueError(f"no tree ensemble: {type(model).__name__}")
    path = f"{staging_root(spark).rstrip('/')}/moralens/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    # as many rows as the model has nodes: the model itself is of that size on the driver
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        node = r.asDict(recursive=True)
        trees.setdefault(node["treeID"], {})[node["id"]] = node
    return [leaf for t, w in enumerate(weights) for leaf in leaves_of(trees[t], w, value)]


def _scan(leaves: list[Leaf], size: int, expected: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, size))
            for k in range(size):
                x[:, k] = batch.column(1 + k).to_numpy(zero_copy_only=False)
            # thresholds are compared as the fit did, on doubles
            out = np.zeros((batch.num_rows, size))
            for leaf in leaves:
                if len(leaf.features):
                    out[:, leaf.features] += leaf_contributions(leaf, x)
            offsets = pa.array(np.arange(0, out.size + 1, size, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected + out.sum(axis=1)), lists], names=["id", "margin", "contributions"]
            )

    return scan


def tree_contributions(fitted: PipelineModel, df: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """``row_id``, margin and one contribution per feature (an array in the order of ``features``).

    ``features`` are the columns the model's assembler took. The margin is a boosted model's score before
    the logistic link, or a forest's probability; it equals the expected margin (``expected_margin``)
    plus all contributions. Rows with NULL in a feature have NaN where a path asks for it: they fail every
    comparison, so fill gaps first, as the fit demands.
    """
    leaves = ensemble_leaves(df.sparkSession, fitted)
    kind = df.schema[row_id].dataType.simpleString()
    shown = df.select(F.col(row_id).alias("id"), *[F.col(f"`{f}`").cast("double") for f in features])
    # every row meets every leaf: more than a few rows are worth a core of their own
    tasks = fit_tasks(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    if tasks > 1:
        shown = shown.repartition(tasks)
    scanned = shown.mapInArrow(
        _scan(leaves, len(features), expected_margin(leaves)), f"id {kind}, margin double, contributions array<double>"
    )
    return scanned.withColumnRenamed("id", row_id)


def expected_margin(leaves: list[Leaf]) -> float:
    return float(sum(leaf.expected for leaf in leaves))


def mean_contributions(contributions: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean and mean absolute contribution over the rows, the largest first."""
    tall = contributions.select(F.posexplode("contributions").alias("i", "c"))
    means = tall.groupBy("i").agg(F.avg("c").alias("mean_contribution"), F.avg(F.abs("c")).alias("mean_abs_contribution"))
    names = F.array(*[F.lit(f) for f in features])
    return means.select(F.get(names, F.col("i")).alias("feature"), "mean_contribution", "mean_abs_contribution").orderBy(
        F.desc("mean_abs_contribution"), "feature"
    )
