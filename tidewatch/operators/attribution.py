"""Exact attribution of a forest's predictions to its columns.

A leaf is reached where each column on its path lies in an interval. With a set of
columns known, the forest's expectation takes for every leaf its value times, for each
column of its path, whether the row lies in the interval (known) or the share of training
rows that went that way (unknown). The Shapley value of a column over all sets is, leaf by
leaf, an integral over t of the other columns' ``t * inside + (1 - t) * share``: a
polynomial, which a few Gauss points integrate exactly. So contributions are exact, and
with the base they sum to the prediction.

A row enters only by which intervals of a leaf's path it lies in, so the integrals are worked
out once for every leaf and such pattern, and rows look theirs up; paths of more than
``LOOKED_UP`` columns are integrated row by row.

A forest's nodes are as many as its training allows (trees times two to the depth), a few
MB at most, and are broadcast; rows are worked on in Arrow batches.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_folder

NODES = "tree int, node int, feature int, cut double, left int, right int, cover double, value array<double>"
#: Numbers of one working matrix (leaves x rows x path).
CELLS = 1 << 21
#: Columns on a path up to which its patterns are tabled.
LOOKED_UP = 8


def forest_nodes(model: RandomForestClassificationModel) -> DataFrame:
    """A fitted forest as a table: a node sends a row left if its column is at most ``cut``; ``value`` is the share of each class."""
    spark = SparkSession.getActiveSession()
    folder = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.save(folder)
    n = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return n.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(F.col("leftChild") >= 0, F.col("split.featureIndex")).otherwise(-1).alias("feature"),
        F.when(F.col("leftChild") >= 0, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("cut"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), total.alias("cover"),
        F.transform("impurityStats", lambda x: x / total).alias("value"))


@dataclass(frozen=True)
class TreeLeaves:
    """A tree's leaves: columns of the path with interval ``(low, high]`` and share, padded with column 0 and share 1; and their values."""

    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    known: np.ndarray  # False where padded
    value: np.ndarray

    def inside(self, x: np.ndarray) -> np.ndarray:
        """Rows in the intervals (leaves x rows x path); NaN goes right, as in the tree."""
        v = x.T[self.column].transpose(0, 2, 1)
        low, high = self.low[:, None, :], self.high[:, None, :]
        return (~(v <= low) & ((v <= high) | np.isinf(high))) | ~self.known[:, None, :]

    def parts(self, inside: np.ndarray) -> np.ndarray:
        """What each column of a path adds to the prediction for each unit of the leaf's value (as ``inside``)."""
        points, weights = np.polynomial.legendre.leggauss((self.column.shape[1] + 1) // 2)
        share = self.share[:, None, :]
        total = np.zeros(inside.shape)
        for p, w in zip((points + 1) / 2, weights / 2):
            factor = p * inside + (1 - p) * share
            total += w * factor.prod(axis=2)[:, :, None] / factor
        return total * (inside - share)

    @cached_property
    def table(self) -> np.ndarray:
        """:meth:`parts` of all patterns (leaves times patterns x path); bit j tells whether the row lies in interval j."""
        leaves, depth = self.column.shape
        bits = (np.arange(1 << depth)[:, None] >> np.arange(depth)) & 1 > 0
        return self.parts(bits[None] | ~self.known[:, None, :]).reshape(leaves << depth, depth)

    @cached_property
    def bins(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each column its cuts, and the bits it sets in the leaves' patterns by how many cuts lie under a value."""
        out = []
        for f in np.unique(self.column[self.known]):
            leaf, j = np.nonzero(self.known & (self.column == f))
            low, high = self.low[leaf, j], self.high[leaf, j]
            cuts = np.unique(np.concatenate([low, high]))
            cuts = cuts[np.isfinite(cuts)]
            under = np.arange(len(cuts) + 1)[:, None]
            inside = (under > np.where(np.isinf(low), -1, np.searchsorted(cuts, low))) & (under <= np.where(np.isinf(high), len(cuts), np.searchsorted(cuts, high)))
            bits = np.zeros((len(cuts) + 1, len(self.column)), dtype=np.int64)
            bits[:, leaf] = inside << j
            out.append((int(f), cuts, bits))
        return out

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """Pattern of each row at each leaf (rows x leaves); NaN lies above all cuts."""
        depth = self.column.shape[1]
        out = np.tile(((~self.known) << np.arange(depth)).sum(axis=1), (len(x), 1))
        for f, cuts, bits in self.bins:
            out += bits[np.searchsorted(cuts, x[:, f])]
        return out


def tree_leaves(nodes: list) -> TreeLeaves:
    """The leaves of one tree's node rows; node 0 is the root."""
    by = {r["node"]: r for r in nodes}
    found: list[tuple[dict[int, tuple[float, float, float]], list[float]]] = []
    todo = [(by[0], {})]
    while todo:
        node, path = todo.pop()
        f = node["feature"]
        if f < 0:
            found.append((path, list(node["value"])))
            continue
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, ends in ((by[node["left"]], (low, min(high, node["cut"]))), (by[node["right"]], (max(low, node["cut"]), high))):
            if child["cover"] > 0:
                todo.append((child, path | {f: (*ends, share * child["cover"] / node["cover"])}))
    depth = max(1, max(len(p) for p, _ in found))
    column, low = np.zeros((len(found), depth), dtype=np.int64), np.full((len(found), depth), -np.inf)
    high, share, known = np.full((len(found), depth), np.inf), np.ones((len(found), depth)), np.zeros((len(found), depth), dtype=bool)
    for i, (path, _) in enumerate(found):
        for j, (f, ends) in enumerate(sorted(path.items())):
            column[i, j], known[i, j] = f, True
            low[i, j], high[i, j], share[i, j] = ends
    return TreeLeaves(column, low, high, share, known, np.array([v for _, v in found]))


def attributed(trees: list[TreeLeaves], x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, prediction, contributions) of each row for its target class, as means over the trees."""
    base, told, out = np.zeros(len(x)), np.zeros(len(x)), np.zeros(x.shape)
    for t in trees:
        leaves, depth = t.column.shape
        step = max(1, CELLS // (leaves * depth))
        alone = t.share.prod(axis=1)
        to = np.zeros((leaves * depth, x.shape[1]))
        to[np.arange(leaves * depth), t.column.ravel()] = t.known.ravel()
        for a in range(0, len(x), step):
            rows = slice(a, min(a + step, len(x)))
            value = t.value[:, target[rows]].T
            if depth <= LOOKED_UP:
                pattern = t.patterns(x[rows])
                reached = pattern == (1 << depth) - 1
                part = t.table[pattern + (np.arange(leaves) << depth)]
            else:
                inside = t.inside(x[rows])
                reached, part = inside.all(axis=2).T, t.parts(inside).transpose(1, 0, 2)
            base[rows] += value @ alone
            told[rows] += (reached * value).sum(axis=1)
            out[rows] += (part * value[:, :, None]).reshape(len(value), -1) @ to
    n = max(len(trees), 1)
    return base / n, told / n, out / n


def attribute(df: DataFrame, nodes: DataFrame, columns: list[str], target: str | Column) -> DataFrame:
    """Add ``base``, ``probability`` and ``contribution`` (one number per column) of each row's target class (an index).

    Rows of a null target have null. The nodes come to the driver: they are the model.
    """
    by: dict[int, list] = {}
    for r in nodes.collect():
        by.setdefault(r["tree"], []).append(r)
    shared = df.sparkSession.sparkContext.broadcast([tree_leaves(by[k]) for k in sorted(by)])

    @F.pandas_udf("base double, probability double, contribution array<double>")
    def told(target: pd.Series, *values: pd.Series) -> pd.DataFrame:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        known = target.notna().to_numpy()
        base, p, parts = attributed(shared.value, x[known], target[known].to_numpy(dtype=np.int64))
        rows = iter(parts.tolist())
        out = pd.DataFrame({"base": np.full(len(x), np.nan), "probability": np.full(len(x), np.nan)})
        out.loc[known, "base"], out.loc[known, "probability"] = base, p
        out["contribution"] = pd.Series([next(rows) if k else None for k in known], dtype=object)
        return out

    of = F.col(target) if isinstance(target, str) else target
    # a row costs far more than its bytes tell: small files are dealt to all tasks
    dealt = df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism))
    return dealt.withColumn("_a", told(of.cast("int"), *[F.col(c).cast("double") for c in columns])).select(*df.columns, "_a.*")


def explained(df: DataFrame, columns: list[str], names: list[str], target: str = "predicted", k: int = 3) -> DataFrame:
    """Attributed rows with ``contributions`` (largest first, by size) and a sentence that names the top ``k``."""
    parts = F.array(*[F.struct(F.abs(F.get("contribution", F.lit(i))).alias("size"), F.lit(c).alias("feature"),
                               F.get("contribution", F.lit(i)).alias("contribution")) for i, c in enumerate(columns)])
    out = df.withColumn("contributions", F.sort_array(parts, asc=False))
    reasons = F.transform(F.slice("contributions", 1, k), lambda p: F.concat(
        p["feature"], F.when(p["contribution"] > 0, " raises it by ").otherwise(" lowers it by "), F.format_number(p["size"], 3)))
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col(target).cast("int"))
    return out.withColumn("explanation", F.concat(F.lit("Classified as "), label, F.lit(" because: "), F.array_join(reasons, ", ")))
