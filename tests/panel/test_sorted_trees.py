"""Trees over sorted rows: cuts between any two neighbouring values, however many names a section has."""

from __future__ import annotations

import numpy as np
import pytest

from panelwright.operators import tree_models
from panelwright.operators.sorted_trees import Sorted, boosted_said, forest_said
from panelwright.operators.trees import Boosting, RegressionTree

from .frames import month, series


def test_a_section_of_more_names_than_bins_is_cut_between_any_two_values(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x, y = rng.normal(size=(2 * n, 2)), rng.normal(size=2 * n)
    data = [(f"T{i % n:04d}", month(i // n), *map(float, x[i]), float(y[i])) for i in range(2 * n)]
    panel = spark.createDataFrame(data, "ticker string, date date, a double, b double, next_return double")
    one = tree_models.RandomForestConfig(n_estimators=1, max_depth=2, min_samples_leaf=5, bootstrap=False)
    got = series(tree_models.cross_sectional_random_forest(panel, ["a", "b"], config=one), "prediction")
    for k in range(2):
        part = slice(k * n, (k + 1) * n)
        want = RegressionTree(2, 5).fit(x[part], y[part]).predict(x[part])
        assert [got[f"T{i:04d}", month(k)] for i in range(n)] == pytest.approx(want.tolist())


@pytest.mark.parametrize(("depth", "least"), [(None, 1), (3, 1), (6, 7), (0, 1), (None, 40)])
def test_trees_of_one_call_are_those_of_their_rows_alone(depth, least):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(70, 3)) if seed % 2 else rng.integers(0, 9, (70, 3)).astype(float)
        x[:, 0] = rng.permutation(70)  # no two rows are equal in all features
        y = rng.normal(size=70)
        weights = [rng.poisson(1, 70).astype(float) for _ in range(4)] + [np.zeros(70), np.ones(70)]
        data = Sorted(x.T)
        trees, own = data.grow(y, weights, depth, least)
        for w, tree, said in zip(weights, trees, own, strict=True):
            if not w.any():
                assert np.isnan(tree.value[0]) and np.isnan(said).all()
                continue
            rows = np.repeat(np.arange(70), w.astype(int))
            want = RegressionTree(depth, least).fit(x[rows], y[rows]).predict(x)
            told = tree.said(data.x, np.arange(70))
            assert np.isnan(said[w == 0]).all() and said[w > 0] == pytest.approx(told[w > 0])
            assert said[w > 0] == pytest.approx(want[w > 0])  # equally good cuts differ in what they say of other rows


def test_boosting_over_sorted_rows_and_targets_that_are_not_known():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(90, 3)), rng.normal(size=90)
    known = rng.random(90) < 0.8
    data = Sorted(x.T)
    got = boosted_said(data, known, np.where(known, y, 0.0), 30, lambda _: np.ones(90), 0.1, 3, 1, None)
    assert got[known] == pytest.approx(Boosting(30, 3, 0.1, 1.0, 1.0).fit(x[known], y[known]).predict(x[known]), abs=1e-9) and np.isfinite(got).all()
    total, n = forest_said(data, known, np.where(known, y, 0.0), range(3), lambda _: np.ones(90), None, 1, None)
    assert n == 3 and total[known] / 3 == pytest.approx(y[known])
