from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from panelwright.operators import dataset, exposures, features
from panelwright.sources import readers

from .frames import month, rows, series


@pytest.fixture(scope="module")
def daily(spark):
    """A has all days, B lacks two months and some prices, C has a zero price and no volume for a while."""
    rng = np.random.default_rng(1)
    data = []
    for t in "ABC":
        price = 50.0
        for k in range(0, 2600, 3):
            d = date(2000, 1, 3) + timedelta(days=k)
            if t == "B" and (d.year, d.month) in ((2001, 3), (2001, 4)):
                continue
            price *= 1 + rng.normal(0, 0.02)
            p = None if t == "B" and k % 51 == 0 else 0.0 if t == "C" and k == 300 else price
            v = 0.0 if t == "C" and 600 < k < 1100 else float(rng.integers(1, 1000))
            data.append((t, d, p, v))
    return data


def plain(data, **kw):
    """The characteristics by pandas, written from their definitions."""
    cfg = features.FeatureConfig(**kw)
    out = {}
    base = 2 if cfg.compounding == "reference" else 1
    for t, g in pd.DataFrame(data, columns=["ticker", "date", "p", "v"]).groupby("ticker"):
        g = g.set_index(pd.to_datetime(g.date)).sort_index()
        change = lambda s: (s / s.shift(1).replace(0, np.nan)) - 1
        vol = change(g.p).rolling(252, min_periods=63).std(ddof=0) * np.sqrt(252)
        m = pd.DataFrame({"p": g.p.resample("ME").last(), "v": g.v.resample("ME").mean(), "vol": vol.resample("ME").last().shift(1)})
        r = change(m.p)
        grown = lambda s, n, k: s.rolling(n, min_periods=k).apply(lambda w: np.nanprod(base + w) - 1)
        traded = (m.p * m.v).where(m.p * m.v > 0)
        mean_v = m.v.rolling(12, min_periods=6).mean()
        sharpe = r.shift(1).rolling(12, min_periods=6)
        f = pd.DataFrame({
            "dollar_volume": np.log(traded).shift(1),
            "value": -m.p / m.p.rolling(12, min_periods=6).mean() if cfg.value_method == "moving_average" else -grown(r.shift(13), 48, 24),
            "momentum": grown(r.shift(2), 11, 6),
            "volatility": m.vol,
            "investment": np.log(mean_v.where(mean_v > 0)).diff(),
            "profitability": sharpe.mean() / sharpe.std(ddof=0) if cfg.profitability_method == "rolling_sharpe" else grown(r.shift(1), 12, 6) / m.vol,
        }).dropna(how="all")
        for d, row in f.iterrows():
            out[t, d.date()] = row
    return out


@pytest.mark.parametrize("kw", [{}, {"value_method": "long_term_reversal", "profitability_method": "return_over_volatility", "compounding": "standard"}])
def test_features(spark, daily, kw):
    df = spark.createDataFrame(daily, "ticker string, date date, adj_close double, volume double").repartition(3)
    got = {(r.ticker, r.date): r for r in features.compute_features(df, config=features.FeatureConfig(**kw)).collect()}
    want = plain(daily, **kw)
    assert set(got) == set(want)
    for k, row in want.items():
        for c in features.FEATURES:
            a, b = got[k][c], row[c]
            assert (a is None) == bool(np.isnan(b)) and (a is None or a == pytest.approx(b, rel=1e-8, abs=1e-10)), (k, c)


def test_contracts(spark):
    df = spark.createDataFrame([], "ticker string, date date, adj_close double")
    with pytest.raises(KeyError):
        features.compute_features(df)
    with pytest.raises(ValueError):
        features.compute_features(df.drop("ticker"))
    with pytest.raises(ValueError):
        features.FeatureConfig(value_method="x")
    with pytest.raises(ValueError):
        exposures.ExposureConfig(min_months=9, max_months=8)
    empty = spark.createDataFrame([], "ticker string, date date, adj_close double, volume double")
    assert features.compute_features(empty).columns == ["ticker", "date", *features.FEATURES] and features.compute_features(empty).count() == 0


@pytest.mark.parametrize("mode", ["fast", "exact"])
def test_exposures_recover_beta(spark, mode):
    mkt = [0.01, 0.02, 0.03, 0.04, 0.05]
    factors = spark.createDataFrame([(month(i), m, 0.0, 0.0, 0.0) for i, m in enumerate(mkt)], "date date, MKT double, SMB double, HML double, RF double")
    returns = rows(spark, {"RET": [2 * m for m in mkt]}, tickers=["AAA"], months=5)
    cfg = exposures.ExposureConfig(3, 5)
    found = {r.date: r for r in exposures.compute_factor_exposures(returns, factors, config=cfg, mode=mode).collect()}
    assert sorted(found) == [month(3), month(4)]
    for r in found.values():
        assert r.beta_MKT == pytest.approx(2, abs=1e-6) and abs(r.beta_SMB) < 1e-8 and abs(r.beta_HML) < 1e-8
    short = exposures.compute_factor_exposures(returns.limit(3), factors, config=exposures.ExposureConfig(4, 5), mode=mode)
    assert short.count() == 0 and short.columns == ["ticker", "date", "alpha_ff3", "beta_MKT", "beta_SMB", "beta_HML"]


def test_exposure_modes_agree(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(0, 0.04, (40, 3))
    factors = spark.createDataFrame([(month(i), *map(float, x), 0.002) for i, x in enumerate(f)], "date date, MKT double, SMB double, HML double, RF double")
    ret = np.concatenate([f @ b + 0.01 * rng.normal(size=40) for b in ([1, 0.2, 0.1], [0.5, -1, 0])])
    returns = rows(spark, {"RET": [None if i % 13 == 0 else v for i, v in enumerate(ret)]}, tickers=["A", "B"], months=40)
    a, b = ({(r.ticker, r.date): r for r in exposures.compute_factor_exposures(returns, factors, config=exposures.ExposureConfig(10, 20), mode=m).collect()} for m in ("fast", "exact"))
    assert set(a) == set(b) and len(a) > 30
    assert all(a[k][c] == pytest.approx(b[k][c], abs=1e-8) for k in a for c in ("alpha_ff3", "beta_MKT", "beta_SMB", "beta_HML"))


def test_modeling_panel(spark):
    returns = rows(spark, {"RET": [0.01, 0.02, 0.03, 0.04, 0.05, 0.06]}, tickers=["AAA", "BBB"], months=3)
    chars = rows(spark, {"size": [10, 11, 12, 20, 21, 22], "gap": [None, 1, 2, 3, 4, 5]}, tickers=["AAA", "BBB"], months=3)
    loads = rows(spark, {"beta_MKT": [1] * 6}, tickers=["AAA", "BBB"], months=3)
    panel = dataset.assemble_modeling_dataset(returns, chars, loads)
    assert series(panel, "next_return") == {("AAA", month(0)): 0.02, ("AAA", month(1)): 0.03, ("BBB", month(0)): 0.05, ("BBB", month(1)): 0.06}
    assert series(panel, "size")["AAA", month(0)] == -1.0 and series(panel, "gap")["AAA", month(0)] == 0.0
    ranked = dataset.assemble_modeling_dataset(returns, chars, loads, standardize="rank")
    assert set(series(ranked, "size").values()) == {0.5, 1.0} and ("AAA", month(0)) not in series(ranked, "size")
    with pytest.raises(ValueError):
        dataset.assemble_modeling_dataset(returns, chars, loads, standardize="z")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "AAA.csv").write_text("volume,date,adj_close,other\n5,2020-01-02,1.5,z\nx,2020-01-03,2.5,z\n7,bad,1,z\n")
    (tmp_path / "d" / "BBB.csv").write_text("volume,date,adj_close,other\n1,2020-01-02,nan,z\n")
    (tmp_path / "meta1.csv").write_text("Symbol,Name\nAAA,x\nBBB,y\n,z\n")
    (tmp_path / "meta2.csv").write_text("Symbol,Name\nAAA,x\nCCC,y\n")
    tickers = readers.read_symbols(spark, f"{tmp_path}/meta1.csv", f"{tmp_path}/meta2.csv")
    assert sorted(r.ticker for r in tickers.collect()) == ["AAA", "BBB", "CCC"]
    got = sorted(map(tuple, readers.read_daily_csv(spark, f"{tmp_path}/d").collect()), key=str)
    assert got == [("AAA", date(2020, 1, 2), 1.5, 5.0), ("AAA", date(2020, 1, 3), 2.5, None), ("BBB", date(2020, 1, 2), None, 1.0)]
    assert tuple(readers.scan_report(spark, f"{tmp_path}/d", tickers).first()) == (3, 1, 1, 1)
    (tmp_path / "f.csv").write_text("date,MKT,SMB,HML,RF\n2020-02-28,1,2,3,0.1\n2020-01-31,4,,6,0.1\n")
    f = readers.read_factors(spark, f"{tmp_path}/f.csv", scale=0.01).collect()
    assert [r.date.month for r in f] == [1, 2] and f[0].SMB is None and f[1].MKT == pytest.approx(0.01)
    readers.write_csv(tickers, f"{tmp_path}/out", single=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 3
    df = spark.createDataFrame([("A", month(i), float(i)) for i in range(9)], "ticker string, date date, x double")
    assert sorted(r.x for r in readers.tail_rows(df, 2).collect()) == [7.0, 8.0]
    share = readers.sample_tickers(spark.range(2000).selectExpr("id AS ticker"), 0.3).count() / 2000
    assert 0.25 < share < 0.35 and readers.sample_tickers(df, 1.0).count() == 9


def test_csv_files_with_other_headers(spark, tmp_path):
    """Files are read by their own header; what is missing or broken is counted, and the scan goes on."""
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "A.csv").write_text("date,adj_close,volume\n2020-01-02,1.5,5\n")
    (folder / "B.csv").write_text('\ufeffvolume,"name, long",date,adj_close\r\n7,"x, y",2020-01-03,2.5\r\n8,z\r\n', encoding="utf-8")
    (folder / "C.csv").write_text("date,adj_close\n2020-01-04,3.5\n")
    (folder / "D.csv").write_bytes(bytes(range(256)) * 4)
    (folder / "E.csv").write_text("")
    (folder / "F.csv").write_text("adj_close,volume\n1,2\n")
    got = sorted(map(tuple, readers.read_daily_csv(spark, str(folder)).collect()), key=str)
    assert got == [("A", date(2020, 1, 2), 1.5, 5.0), ("B", date(2020, 1, 3), 2.5, 7.0), ("C", date(2020, 1, 4), 3.5, None)]
    tickers = spark.createDataFrame([(t,) for t in "ABCDEFG"], "ticker string")
    assert tuple(readers.scan_report(spark, str(folder), tickers).first()) == (7, 3, 2, 2)


def test_monthly_panel_holds_features_and_returns(spark, daily):
    daily = spark.createDataFrame(daily, "ticker string, date date, adj_close double, volume double")
    panel = features.monthly_panel(daily)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(panel.select("ticker", "date", *features.FEATURES).na.drop("all", subset=list(features.FEATURES)), features.compute_features(daily))
    returns = features.monthly_returns(daily)
    assert same(panel.filter("RET IS NOT NULL").select("ticker", "date", "RET"), returns)
    assert same(panel.filter("RET IS NOT NULL").select("ticker", "date", "next_return"), dataset.next_return(returns))
