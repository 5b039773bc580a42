from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import linear, ranking, rolling, tree_models
from panelwright.operators.trees import RegressionTree

from .frames import month, random_panel, rows, series

X1, X2 = [1, 2, 3, 4, 2, 4, 6, 8], [0.5, 1.5, 2, 3, 1, 1, 2, 2]


@pytest.fixture(scope="module")
def section(spark):
    """Four names in two months, the target linear in each month."""
    y = [1 + 2 * a - b for a, b in zip(X1[:4], X2[:4], strict=True)] + [0.5 + 1.5 * a + 0.5 * b for a, b in zip(X1[4:], X2[4:], strict=True)]
    by_ticker = lambda v: [v[m * 4 + t] for t in range(4) for m in range(2)]
    return rows(spark, {"x1": by_ticker(X1), "x2": by_ticker(X2), "next_return": by_ticker(y)}, tickers=list("ABCD"), months=2)


def test_cross_sections(section):
    y = series(section, "next_return")
    assert series(linear.cross_sectional_ols(section, ["x1", "x2"]), "prediction") == pytest.approx(y)
    ranks = series(linear.cross_sectional_ols(section, ["x1", "x2"], config=linear.CrossSectionalOLSConfig(prediction_type="rank")), "prediction")
    assert sorted(v for (_, d), v in ranks.items() if d == month(0)) == [0.25, 0.5, 0.75, 1.0]
    one = tree_models.RandomForestConfig(n_estimators=1, bootstrap=False)
    assert series(tree_models.cross_sectional_random_forest(section, ["x1", "x2"], config=one), "prediction") == pytest.approx(y)
    boosted = series(tree_models.cross_sectional_gradient_boosting(section, ["x1", "x2"], config=tree_models.GradientBoostingConfig(subsample=1.0, colsample_bytree=1.0)), "prediction")
    assert np.mean([abs(boosted[k] - y[k]) for k in y]) < 1e-3
    assert linear.cross_sectional_ols(section.limit(3), ["x1", "x2"]).count() == 0
    with pytest.raises(ValueError):
        linear.CrossSectionalModelConfig(prediction_type="x")


def test_rolling_and_expanding_ols(spark):
    panel = rows(spark, {"feature": range(1, 7), "next_return": [2 * i for i in range(1, 7)]}, tickers=["AAA"], months=6)
    got = series(rolling.rolling_oos_predictions(panel, ["feature"], window_config=linear.WindowConfig(3, 4)), "prediction")
    assert got == pytest.approx({("AAA", month(3)): 8, ("AAA", month(4)): 10, ("AAA", month(5)): 12})
    flat = rows(spark, {"feature": [1] * 4, "next_return": [1, 1, 3, 5]}, tickers=["AAA"], months=4)
    got = series(rolling.rolling_oos_predictions(flat, ["feature"], window_config=linear.WindowConfig(2, 2, expanding=True)), "prediction")
    assert got["AAA", month(3)] == pytest.approx(5 / 3)
    with pytest.raises(ValueError):
        linear.WindowConfig(5, 4)


def by_windows(panel, features, fit, least, most):
    """Predictions date by date, by plain loops."""
    pdf = panel.toPandas().sort_values(["ticker", "date"])
    dates, out = sorted(pdf["date"].unique()), {}
    for i in range(least, len(dates)):
        train = pdf[pdf["date"].isin(dates[max(0, i - most) : i])].dropna()
        test = pdf[pdf["date"] == dates[i]].dropna(subset=features)
        said = fit(train[features].to_numpy(), train["next_return"].to_numpy(), test[features].to_numpy())
        out |= {(t, dates[i]): p for t, p in zip(test["ticker"], said, strict=True)}
    return out


def test_rolling_ols_with_holes(spark):
    panel, cols = random_panel(spark), ["x0", "x1", "x2"]

    def fit(x, y, z):
        b = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        return np.column_stack([np.ones(len(z)), z]) @ b

    want = by_windows(panel, cols, fit, 5, 8)
    assert series(rolling.rolling_oos_predictions(panel, cols, window_config=linear.WindowConfig(5, 8)), "prediction") == pytest.approx(want)

    class Line:
        def fit(self, x, y):
            self.x, self.y = x, y

        def predict(self, z):
            return fit(self.x, self.y, z)

    assert series(rolling.rolling_oos_predictions(panel, cols, window_config=linear.WindowConfig(5, 8), model_factory=Line), "prediction") == pytest.approx(want)


@pytest.mark.parametrize("kind", ["ridge", "lasso", "elasticnet"])
def test_regularized(spark, kind):
    i = [0, 1, 2, 3, 4, 1, 2, 3, 4, 5, 2, 3, 4, 5, 6]
    x2 = [0.5 * j for j in range(5)] * 3
    panel = rows(spark, {"x1": i, "x2": x2, "next_return": [1 + 2 * a - b for a, b in zip(i, x2, strict=True)]}, tickers=list("ABC"), months=5)
    how = rolling.RegularizedModelConfig(model_type=kind, alphas=(1e-6, 1e-4, 1e-2), l1_ratios=(0.5, 0.9) if kind == "elasticnet" else None, cv_folds=2, max_iter=100_000)
    got = rolling.rolling_regularized_predictions(panel, ["x1", "x2"], window_config=linear.WindowConfig(3, 4), model_config=how)
    want = {k: v for k, v in series(panel, "next_return").items() if k[1] >= month(3)}
    assert series(got, "prediction") == pytest.approx(want, rel=1e-3)


@pytest.mark.parametrize("kind", ["ridge", "lasso", "elasticnet"])
@pytest.mark.parametrize("expanding", [False, True])
def test_regularized_from_sums_is_regularized_from_rows(spark, kind, expanding):
    """Edges of folds inside tickers, holes, a constant column, and values far from zero."""
    cols = ["x0", "x1", "x2", "same", "far"]
    panel = random_panel(spark, seed=5, tickers=11, months=14, holes=0.15)
    panel = panel.withColumn("same", F.lit(3.7)).withColumn("far", 1000 + F.crc32("ticker") % 7 + F.month("date"))
    how = rolling.RegularizedModelConfig(model_type=kind, alphas=(0.001, 0.01, 0.1, 1.0), l1_ratios=(0.3, 0.9) if kind == "elasticnet" else None, cv_folds=5)
    windows = linear.WindowConfig(2, 6, expanding=expanding)
    got = series(rolling.rolling_regularized_predictions(panel, cols, window_config=windows, model_config=how), "prediction")
    want = series(rolling.rolling_models(panel, cols, {"prediction": lambda: rolling.Regularized(how)}, window_config=windows), "prediction")
    assert len(want) > 60 and got == pytest.approx(want, rel=1e-8, abs=1e-8)


def test_fold_sums_of_small_windows(spark):
    """Fewer rows than folds, tickers that are numbers or null, no rows at all."""
    panel = rows(spark, {"x": [1, 2, None, 4, 3, None], "next_return": [1, 3, 2, 5, None, 2]}, tickers=["A", "B"], months=3)
    windows, how = linear.WindowConfig(1, 1), rolling.RegularizedModelConfig(alphas=(0.1,), cv_folds=5)
    numbered = panel.select(F.when(F.col("ticker") == "B", F.lit(2)).alias("ticker"), "date", "x", "next_return")
    for frame in (panel, numbered):
        got = series(rolling.rolling_regularized_predictions(frame, ["x"], window_config=windows, model_config=how), "prediction")
        want = series(rolling.rolling_models(frame, ["x"], {"prediction": lambda: rolling.Regularized(how)}, window_config=windows), "prediction")
        assert got and got == pytest.approx(want)
    assert rolling.rolling_regularized_predictions(panel.limit(0), ["x"], window_config=windows).count() == 0


def test_regularized_is_the_penalised_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    y = x @ [1, 0, -2, 0] + rng.normal(size=80)
    for kind, l1 in (("ridge", None), ("lasso", None), ("elasticnet", (0.3,))):
        m = rolling.Regularized(rolling.RegularizedModelConfig(model_type=kind, alphas=(0.2,), l1_ratios=l1, cv_folds=3)).fit(x, y)
        z, share = (x - x.mean(0)) / x.std(0), {"lasso": 1.0, "elasticnet": 0.3, "ridge": 0.0}[kind]

        def loss(w, z=z, share=share, kind=kind):
            rss = ((y - y.mean() - z @ w) ** 2).sum()
            return rss + 0.2 * w @ w if kind == "ridge" else rss / 160 + 0.2 * share * np.abs(w).sum() + 0.1 * (1 - share) * w @ w

        assert all(loss(m.weights) <= loss(m.weights + 1e-3 * rng.normal(size=4)) for _ in range(200))
    with pytest.raises(ValueError):
        rolling.RegularizedModelConfig(model_type="elasticnet")


class Times:
    def __init__(self, w):
        self.w = w

    def fit(self, x, y):
        return self

    def predict(self, x):
        return self.w * x[:, 0]


def test_tuning(spark):
    x = [1, 2, 3, 4, 5, 6, 2, 3, 5, 9, 7, 8]
    panel = rows(spark, {"feature": x, "next_return": [2 * v for v in x]}, tickers=["AAA", "BBB"], months=6)
    options = [rolling.CandidateModel("worse", lambda: Times(1.0)), rolling.CandidateModel("best", lambda: Times(2.0))]
    found = rolling.rolling_time_series_tuning(panel, ["feature"], candidates=options, window_config=linear.WindowConfig(3, 5), cv_folds=2)
    best = {r.date: r for r in found.best_models.collect()}
    assert sorted(best) == [month(3), month(4), month(5)] and {r.name for r in best.values()} == {"best"}
    assert all(r.mae == 0 and r.r2 == 1 and r.spearman == pytest.approx(1) for r in best.values())
    assert series(found.predictions, "prediction") == {k: v for k, v in series(panel, "next_return").items() if k[1] >= month(3)}
    fitted = found.fitted()
    assert sorted(fitted) == [month(3), month(4), month(5)] and all(m.w == 2.0 for m in fitted.values())
    with pytest.raises(ValueError):
        rolling.rolling_time_series_tuning(panel, ["feature"], candidates=[])
    assert [(list(a), list(b)) for a, b in rolling.time_splits(5, 2)] == [([0, 1, 2], [3]), ([0, 1, 2, 3], [4])]


def test_all_models(spark, tmp_path):
    i = list(range(6)) + list(range(1, 7))
    j = list(range(6)) * 2
    panel = rows(spark, {"x1": i, "x2": j, "next_return": [0.5 * a + 0.25 * b for a, b in zip(i, j, strict=True)]}, tickers=["AAA", "BBB"], months=6)
    few = rolling.AllModels(trees=30, min_samples_leaf=1)
    out = rolling.generate_oos_predictions_all_models(panel, ["x1", "x2"], window_config=linear.WindowConfig(2, 3), output_path=f"{tmp_path}/p", models=few).toPandas()
    assert list(out.columns) == ["ticker", "date", *rolling.MODEL_COLUMNS, "realized_return"] and out["date"].min() == month(2)
    assert all(out[m].corr(out["realized_return"]) > 0.8 for m in rolling.MODEL_COLUMNS)
    assert spark.read.option("header", True).csv(f"{tmp_path}/p").count() == len(out)


def test_tree_respects_limits():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=200)
    tree = RegressionTree(max_depth=3, min_samples_leaf=20).fit(x, y)
    _, counts = np.unique(tree.predict(x), return_counts=True)
    assert len(counts) <= 8 and counts.min() >= 20


def test_rankings(spark):
    df = rows(spark, {"prediction": [0.1, 5, 0.3, 5, 0.2, 5, None, 1], "vol": [1, 1, 6, 1, 1, 1, 1, 0], "beta": [1] * 8}, tickers=list("ABCD"), months=2)
    got = series(ranking.convert_predictions_to_rankings(df), "prediction_rank")
    assert [got[t, month(0)] for t in "ABC"] == pytest.approx([1 / 3, 1, 2 / 3]) and ("D", month(0)) not in got
    assert [got[t, month(1)] for t in "ABC"] == pytest.approx([0.75] * 3)
    adjusted = series(ranking.convert_predictions_to_rankings(df, config=ranking.RankingConfig(risk_adjust="volatility", volatility_col="vol", basis="zscore")), "prediction_rank")
    assert [adjusted[t, month(0)] for t in "ABC"] == pytest.approx([2 / 3, 1 / 3, 1]) and ("D", month(1)) not in adjusted
    for bad in ({"basis": "x"}, {"risk_adjust": "beta"}):
        with pytest.raises(ValueError):
            ranking.RankingConfig(**bad)
    with pytest.raises(KeyError):
        ranking.convert_predictions_to_rankings(df.drop("prediction"))


def test_regularized_frames_start_no_job(spark):
    panel = random_panel(spark, seed=8)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "building a frame")
    try:
        out = rolling.regularized_columns(panel, ["x0", "x1"], {"a": rolling.RegularizedModelConfig(cv_folds=3), "b": rolling.RegularizedModelConfig(model_type="lasso", cv_folds=3)}, window_config=linear.WindowConfig(4, 6))
        assert len(tracker.getJobIdsForGroup("lazy")) == 0
        assert out.count() > 0 and len(tracker.getJobIdsForGroup("lazy")) > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
