"""Isolation forest: trees built in parallel groups, rows scored in Arrow batches.

Fitting needs only ``trees * rows_per_tree`` rows, picked by the hash of their
key: the same rows whatever the partitioning. Trees are built one group per
task; a fitted forest is at most ``trees * 2 * rows_per_tree`` nodes, a few MB,
and is broadcast to the scoring tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Forest size and rows per tree.
TREES = 200
ROWS_PER_TREE = 256
EULER = 0.5772156649015329

TREE_SCHEMA = "tree_id int, n int, feature array<int>, cut array<double>, child array<int>, path array<double>"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def sample_for_trees(df: DataFrame, columns: list[str], keys: list[str], trees: int, rows: int, seed: int) -> DataFrame:
    """``rows`` rows per tree out of one hash-ordered pool.

    If the table is smaller than the pool, a row serves several trees.
    """
    h = F.xxhash64(*keys, F.lit(seed))
    pool = df.select(*columns, h.alias("_h"), *[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)])
    order = ["_h", *[f"_k{i}" for i in range(len(keys))]]
    pool = pool.orderBy(*order).limit(trees * rows)
    # The pool is bounded by the forest size, so ranking it in one task is fine.
    ranked = pool.withColumn("_i", F.row_number().over(W.orderBy(*order)) - 1)
    n = df.agg(F.count(F.lit(1))).scalar()
    copies = F.least(F.greatest(F.ceil(F.lit(trees * rows) / F.greatest(n, F.lit(1))), F.lit(1)), F.lit(trees)).cast("int")
    spread = ranked.withColumn("_c", F.explode(F.sequence(F.lit(0), copies - 1)))
    stride = F.greatest(F.floor(F.lit(trees) / copies), F.lit(1))
    spread = spread.withColumn("tree_id", ((F.col("_i") + F.col("_c") * stride) % trees).cast("int"))
    place = F.row_number().over(W.partitionBy("tree_id").orderBy("_c", "_i"))
    return spread.withColumn("_place", place).where(F.col("_place") <= rows).select("tree_id", "_i", *columns)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One tree as flat arrays; child[i] is the left child, child[i] + 1 the right."""
    feature, cut, child, path = [-1], [0.0], [-1], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, idx, depth = todo.pop()
        low, high = (x[idx].min(0), x[idx].max(0)) if len(idx) else (np.zeros(x.shape[1]),) * 2
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(idx) <= 1 or not len(usable):
            path[node] = depth + average_path(len(idx))
            continue
        f = int(rng.choice(usable))
        at = float(rng.uniform(low[f], high[f]))
        left = x[idx, f] <= at
        feature[node], cut[node], child[node] = f, at, len(feature)
        for side in (idx[left], idx[~left]):
            todo.append((len(feature), side, depth + 1))
            feature.append(-1), cut.append(0.0), child.append(-1), path.append(0.0)
    return {"feature": feature, "cut": cut, "child": child, "path": path}


@dataclass(frozen=True)
class Forest:
    columns: list[str]
    trees: list[tuple]  # (feature, cut, child, path) arrays per tree
    rows_per_tree: float

    def score(self, spark: SparkSession) -> Column:
        """Column with the score: -1 strange, near 0 ordinary (minus the anomaly score)."""
        shared = spark.sparkContext.broadcast((self.trees, average_path(self.rows_per_tree)))

        @F.pandas_udf("double")
        def raw(*cols: pd.Series) -> pd.Series:
            trees, norm = shared.value
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            rows = np.arange(len(x))
            depth = np.zeros(len(x))
            for feature, cut, child, path in trees:
                node = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    step = child[node] + (x[rows, np.maximum(f, 0)] > cut[node])
                    node = np.where(inner, step, node)
                depth += path[node]
            return pd.Series(-np.power(2.0, -depth / len(trees) / norm))

        return raw(*[F.col(c) for c in self.columns])


def fit_forest(train: DataFrame, columns: list[str], keys: list[str], trees: int = TREES,
               rows_per_tree: int = ROWS_PER_TREE, seed: int = 42) -> Forest:
    """Build the trees in parallel and bring the (bounded) forest to the driver."""
    sample = sample_for_trees(train, columns, keys, trees, rows_per_tree, seed)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        tree = int(pdf["tree_id"].iloc[0])
        x = pdf[columns].to_numpy(dtype=float)
        grown = _grow(x, np.random.default_rng([seed, tree]), math.ceil(math.log2(max(len(x), 2))))
        return pd.DataFrame([{"tree_id": tree, "n": len(x), **grown}])

    built = sample.groupBy("tree_id").applyInPandas(build, TREE_SCHEMA).orderBy("tree_id").collect()
    if not built:
        raise ValueError("no rows to fit a forest on")
    arrays = [(np.array(t["feature"]), np.array(t["cut"]), np.array(t["child"]), np.array(t["path"])) for t in built]
    return Forest(columns, arrays, float(np.mean([t["n"] for t in built])))
