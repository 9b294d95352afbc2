"""Attribution by tabled patterns."""

import numpy as np

from tidewatch.operators import attribution


def test_attribution_by_patterns_agrees_with_the_integrals(spark, monkeypatch):
    rnd = np.random.default_rng(5)

    def grow(node, depth, cover):
        if depth == 0:
            return [{"node": node, "feature": -1, "cut": None, "left": -1, "right": -1, "cover": cover, "value": list(rnd.dirichlet([1, 1, 1]))}]
        own = {"node": node, "feature": int(rnd.integers(4)), "cut": float(rnd.normal()), "left": 2 * node + 1, "right": 2 * node + 2, "cover": cover, "value": [1, 0, 0]}
        part = float(rnd.uniform(0.2, 0.8))
        return [own, *grow(2 * node + 1, depth - 1, cover * part), *grow(2 * node + 2, depth - 1, cover * (1 - part))]

    trees = [attribution.tree_leaves(grow(0, 6, 1000.0)) for _ in range(3)]
    x, target = rnd.normal(size=(500, 5)), rnd.integers(3, size=500)
    x[::7, 2] = np.nan
    x[:3, :4] = [[t.high[np.isfinite(t.high)][0]] * 4 for t in trees]  # on a cut
    quick = attribution.attributed(trees, x, target)
    assert all("table" in vars(t) for t in trees)
    monkeypatch.setattr(attribution, "LOOKED_UP", 0)
    for a, b in zip(quick, attribution.attributed(trees, x, target)):
        assert np.abs(a - b).max() < 1e-12
    assert np.abs(quick[0] + quick[2].sum(axis=1) - quick[1]).max() < 1e-12
