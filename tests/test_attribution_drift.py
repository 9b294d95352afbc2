"""Attribution against all subsets, adaptive windows against all cut points, halving against the whole grid."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import attribution, classify, drift


def grown(rng, depth, features, node=0, out=None, cover=64.0):
    """A random tree as node rows, some leaves early."""
    out = [] if out is None else out
    me = {"tree": 0, "node": len(out), "feature": -1, "cut": None, "left": -1, "right": -1, "cover": cover, "value": None}
    out.append(me)
    if depth == 0 or cover < 2 or (depth < 3 and rng.random() < 0.2):
        p = rng.random()
        me["value"] = [p, 1 - p]
        return out
    me["feature"], me["cut"], me["value"] = rng.randrange(features), rng.choice([0.2, 0.4, 0.6, 0.8]), [0.5, 0.5]
    left = cover * rng.choice([0.25, 0.5, 0.75])
    me["left"] = len(out)
    grown(rng, depth - 1, features, 0, out, left)
    me["right"] = len(out)
    grown(rng, depth - 1, features, 0, out, cover - left)
    return out


def expectation(nodes, x, known, target, at=0):
    """A tree's mean over the unknown columns, by walking it."""
    n = nodes[at]
    if n["feature"] < 0:
        return n["value"][target]
    go = lambda c: expectation(nodes, x, known, target, c)
    if n["feature"] in known:
        return go(n["left"]) if x[n["feature"]] <= n["cut"] else go(n["right"])
    return sum(go(c) * nodes[c]["cover"] / n["cover"] for c in (n["left"], n["right"]))


@pytest.mark.parametrize("seed", range(6))
def test_contributions_are_shapley_values(seed):
    rng = random.Random(seed)
    features = 4
    trees = [grown(rng, 5, features) for _ in range(3)]
    x = np.array([[rng.random() for _ in range(features)] for _ in range(8)] + [[0.2, math.nan, 0.8, 0.4]])
    target = np.array([rng.randrange(2) for _ in x])
    base, told, parts = attribution.attributed([attribution.tree_leaves(t) for t in trees], x, target)
    for i, row in enumerate(x):
        mean = lambda known: sum(expectation(t, row, known, target[i]) for t in trees) / len(trees)
        assert base[i] == pytest.approx(mean(set()), abs=1e-12)
        assert told[i] == pytest.approx(mean(set(range(features))), abs=1e-12)
        for f in range(features):
            rest = [g for g in range(features) if g != f]
            want = sum(math.factorial(k) * math.factorial(features - 1 - k) / math.factorial(features) * (mean({*s, f}) - mean(set(s)))
                       for k in range(features) for s in itertools.combinations(rest, k))
            assert parts[i, f] == pytest.approx(want, abs=1e-12)
        assert base[i] + parts[i].sum() == pytest.approx(told[i], abs=1e-12)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(900, 4))
    y = (x[:, 0] > 0.5).astype(int) + ((x[:, 1] > 0.7) & (x[:, 0] > 0.5)).astype(int)
    rows = [(i, *map(float, r), int(c), ["train", "val"][int(i >= 600)]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, label int, part string").cache()


def test_a_fitted_forest_is_explained(spark, labelled):
    columns = ["a", "b", "c", "d"]
    model = classify.fit_classifier(labelled.where("part = 'train'"), columns, trees=7, depth=4)
    predicted = model.predict(labelled.where("part = 'val'"))
    nodes = attribution.forest_nodes(model.model)
    assert nodes.schema.simpleString() == spark.createDataFrame([], attribution.NODES).schema.simpleString()
    out = attribution.attribute(predicted.withColumn("base", F.lit(1)).drop("base"), nodes, columns, "predicted")
    rows = attribution.explained(out, columns, ["low", "high", "top"]).collect()
    assert len(rows) == 300
    for r in rows:
        assert r["probability"] == pytest.approx(r["probabilities"][r["predicted"]], abs=1e-9)
        assert r["base"] + sum(r["contribution"]) == pytest.approx(r["probability"], abs=1e-9)
        assert r["contributions"][0]["size"] == max(abs(v) for v in r["contribution"])
        assert r["explanation"].startswith("Classified as ")
    assert sum(r["contributions"][0]["feature"] in ("a", "b") for r in rows) > 280
    none = attribution.attribute(labelled.limit(3).withColumn("t", F.lit(None).cast("int")), nodes, columns, "t").collect()
    assert all(r["contribution"] is None for r in none)


def test_halving_finds_the_winner_of_the_whole_grid(spark, labelled):
    columns = ["a", "b", "c", "d"]
    grid = [{"depth": d, "min_rows": m, "subset": "0.8"} for d, m in ((1, 1), (1, 400), (4, 1), (2, 400))]
    train, val = labelled.where("part = 'train'"), labelled.where("part = 'val'")
    model, trials = classify.tune_by_halving(train, val, columns, grid=grid, trees=2, eta=2, rungs=3, bins=16)
    _, whole = classify.tune_by_halving(train, val, columns, grid=grid, trees=8, eta=1, rungs=1, bins=16)
    best = max(whole, key=lambda t: t["weighted_f1"])
    last = [t for t in trials if t["kept"]][-1]
    assert (last["depth"], last["min_rows"]) == (best["depth"], best["min_rows"]) == (4, 1)
    assert [t["rung"] for t in trials] == [0] * 4 + [1] * 2
    assert all(min(t["weighted_f1"] for t in trials if t["rung"] == r and t["kept"]) >= max([t["weighted_f1"] for t in trials if t["rung"] == r and not t["kept"]]) for r in (0, 1))
    # refitted on both parts, over the columns as they are
    hits = model.predict(labelled).where("predicted = label").count()
    assert hits > 850 and model.model.getNumTrees == trials[-1]["trees"]


def test_bins_are_ordered_and_cover_everything(spark, labelled):
    odd = labelled.select("a", "label").unionByName(spark.createDataFrame([(None, 0), (float("nan"), 0), (9.0, 0), (-9.0, 0)], "a double, label int"))
    train, other = classify.binned(labelled.select("a", "label"), [odd], ["a"], 8)
    assert {r["a"] for r in train.select("a").distinct().collect()} == {float(i) for i in range(8)}
    tail = [r["a"] for r in other.collect()][-4:]
    assert sorted(map(str, tail)) == sorted(["8.0", "8.0", "7.0", "0.0"])


def naive(buckets, delta):
    """The definition: drop the oldest bucket while any cut divides the rest."""
    window, out = [], []
    for n, s in buckets:
        window.append((n, s))
        dropped = False
        while len(window) > 1:
            cuts = []
            for i in range(1, len(window)):
                n0, s0 = sum(a for a, _ in window[:i]), sum(b for _, b in window[:i])
                n1, s1 = sum(a for a, _ in window[i:]), sum(b for _, b in window[i:])
                cuts.append(abs(s0 / n0 - s1 / n1) > drift.allowed(n0, n1, (s0 + s1) / (n0 + n1), delta))
            if not any(cuts):
                break
            window.pop(0)
            dropped = True
        n = sum(a for a, _ in window)
        out.append((n, sum(b for _, b in window) / n, dropped))
    return out


def noisy(rng, days, rates):
    return [(n, sum(rng.random() < rates[i * len(rates) // days] for _ in range(n))) for i in range(days) for n in [rng.randint(1, 80)]]


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_cut_where_the_definition_cuts(seed):
    rng = random.Random(seed)
    buckets = noisy(rng, 60, [0.9, 0.9, 0.4, 0.85])
    got = list(drift.folded(drift.AdaptiveWindow(0.01, per_size=1000), buckets))
    want = naive(buckets, 0.01)
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
    assert [b for _, b, _ in got] == pytest.approx([b for _, b, _ in want])
    assert any(c for _, _, c in got)


def test_compressed_windows_are_small_keep_their_sums_and_merge():
    rng = random.Random(9)
    steady, window = noisy(rng, 3000, [0.8]), drift.AdaptiveWindow(per_size=5)
    for n, s in steady:
        assert window.add(n, s) == 0
    assert window.rows == sum(n for n, _ in steady) and window.hits == sum(s for _, s in steady)
    assert len(window.cells) <= 5 * (window.rows.bit_length() + 1)
    later = drift.AdaptiveWindow(per_size=5)
    for n, s in noisy(rng, 200, [0.8]):
        later.add(n, s)
    both = window.rows + later.rows
    assert window.merge(later) == 0 and window.rows == both
    worse = drift.AdaptiveWindow(per_size=5)
    for n, s in noisy(rng, 200, [0.3]):
        worse.add(n, s)
    fresh = worse.rows
    assert window.merge(worse) > 0 and window.rows < both and window.rows >= fresh * 0.9
    assert drift.AdaptiveWindow().add(0, 0) == 0


def test_adaptive_windows_of_a_table(spark):
    rng = random.Random(3)
    rows = [(m, d, int(rng.random() < (0.9 if d < 15 or m == "a" else 0.4))) for m in "ab" for d in range(30) for _ in range(40)] + [("a", 3, None)]
    df = spark.createDataFrame(rows, "model string, d int, y int").selectExpr(
        "model", "timestampadd(DAY, d, TIMESTAMP_NTZ'2026-04-01 06:00:00') AS ts", "1 AS truth", "y AS predicted")
    out = drift.adaptive_windows(df, "truth", "predicted", ["model"], delta=0.001).orderBy("model", "bucket").collect()
    for m in "ab":
        mine = [r for r in out if r["model"] == m]
        assert [(r["window_n"], r["drift"]) for r in mine] == [(a, c) for a, _, c in naive([(r["n"], r["hits"]) for r in mine], 0.001)]
        assert sum(r["n"] for r in mine) == 1200
    assert not any(r["drift"] for r in out if r["model"] == "a") and any(r["drift"] for r in out if r["model"] == "b")
