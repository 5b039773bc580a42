"""The catalogue's panel queries in DuckDB's SQL, from shared common table expressions."""

from __future__ import annotations

from ..functions.xsec import quantile_edges

TRAIN_MIN, TRAIN_MAX = 24, 36
#: Least rows of a leaf of the tree that SQL grows too.
TREE_LEAF = 5
#: More buckets than any section of the tables has names, so that all are cut the other way.
FALLBACK = 1_000_000

_T = "PARTITION BY ticker ORDER BY date"


def _gated(aggregate: str, counted: str, rows: int, least: int) -> str:
    w = f"OVER ({_T} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({counted}) {w} >= {least} THEN {aggregate} {w} END"


CTES = {
    "daily": """SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, 100 + avg(CAST(l_extendedprice AS DOUBLE)) / 1000 AS adj_close,
        sum(CAST(l_quantity AS DOUBLE)) AS volume FROM lineitem GROUP BY 1, 2""",
    "dret": f"SELECT *, adj_close / nullif(lag(adj_close) OVER ({_T}), 0) - 1 AS ret FROM daily",
    "dvol": f"SELECT *, {_gated('stddev_pop(ret)', 'ret', 252, 63)} * sqrt(252::DOUBLE) AS rvol FROM dret",
    "observed": """SELECT ticker, last_day(date) AS date, arg_max(adj_close, date) AS price, avg(volume) AS volume,
        arg_max(rvol, date) FILTER (WHERE rvol IS NOT NULL) AS vol FROM dvol GROUP BY 1, 2""",
    "spine": """SELECT ticker, last_day(CAST(m AS DATE)) AS date FROM (
        SELECT ticker, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM observed GROUP BY ticker)""",
    "months": "SELECT ticker, date, price, volume, vol FROM spine LEFT JOIN observed USING (ticker, date)",
    "mret": f"SELECT *, price / nullif(lag(price) OVER ({_T}), 0) - 1 AS mret, CASE WHEN price * volume > 0 THEN ln(price * volume) END AS dv FROM months",
    "lagged": f"""SELECT *, lag(mret, 1) OVER ({_T}) AS r1, lag(mret, 2) OVER ({_T}) AS r2, lag(mret, 13) OVER ({_T}) AS r13, lag(vol) OVER ({_T}) AS volatility,
        lag(dv) OVER ({_T}) AS dollar_volume, {_gated('avg(volume)', 'volume', 12, 6)} AS mean_volume FROM mret""",
    "made": f"""SELECT *, -price / nullif({_gated('avg(price)', 'price', 12, 6)}, 0) AS value_ma, -({_gated('product(2 + r13)', 'r13', 48, 24)} - 1) AS value_reversal,
        {_gated('product(2 + r2)', 'r2', 11, 6)} - 1 AS momentum_reference, {_gated('product(1 + r2)', 'r2', 11, 6)} - 1 AS momentum_standard,
        {_gated('avg(r1)', 'r1', 12, 6)} / nullif({_gated('stddev_pop(r1)', 'r1', 12, 6)}, 0) AS profitability_sharpe,
        ({_gated('product(2 + r1)', 'r1', 12, 6)} - 1) / nullif(volatility, 0) AS profitability_rov,
        CASE WHEN mean_volume > 0 THEN ln(mean_volume) END AS lv FROM lagged""",
    "every": f"SELECT *, lv - lag(lv) OVER ({_T}) AS investment FROM made",
    "features": """SELECT ticker, date, dollar_volume, value_ma AS value, momentum_reference AS momentum, volatility, investment, profitability_sharpe AS profitability FROM every
        WHERE coalesce(dollar_volume, value_ma, momentum_reference, volatility, investment, profitability_sharpe) IS NOT NULL""",
    "returns": "SELECT ticker, date, mret AS ret FROM mret WHERE mret IS NOT NULL",
    "nexts": f"SELECT ticker, date, lead(ret) OVER ({_T}) AS next_return FROM returns",
    "split": """SELECT r.date, ret, f.volatility, f.value, median(f.volatility) OVER (PARTITION BY r.date) AS mv, median(f.value) OVER (PARTITION BY r.date) AS mb
        FROM returns r LEFT JOIN features f USING (ticker, date)""",
    "factors": """SELECT date, avg(ret) AS MKT,
        coalesce(avg(ret) FILTER (WHERE volatility < mv) - avg(ret) FILTER (WHERE volatility > mv), 0) AS SMB,
        coalesce(avg(ret) FILTER (WHERE value > mb) - avg(ret) FILTER (WHERE value < mb), 0) AS HML, 0.002::DOUBLE AS RF FROM split GROUP BY date""",
    "signals": "SELECT ticker, date, momentum, value, volatility, dollar_volume, next_return AS realized FROM features LEFT JOIN nexts USING (ticker, date)",
    "long": """SELECT ticker, date, 'momentum' AS model, momentum AS signal, realized AS ret, dollar_volume AS w FROM signals WHERE momentum IS NOT NULL
        UNION ALL SELECT ticker, date, 'value', value, realized, dollar_volume FROM signals WHERE value IS NOT NULL""",
}


def _buckets(q: int) -> str:
    edges = " + ".join(f"CASE WHEN rn > 1 + {p!r}::DOUBLE * (n - 1) THEN 1 ELSE 0 END" for p in quantile_edges(q)) if q < FALLBACK else "NULL"
    return f"""SELECT ticker, date, model, signal, ret, w, CAST(CASE WHEN distinct_n < {q}
          THEN CASE WHEN low = high THEN {-(-q // 2)} ELSE greatest(1, ceil((twice - low) * {q} / (high - low)::DOUBLE)) END
          ELSE 1 + {edges} END AS INTEGER) AS decile
        FROM (SELECT *, count(*) OVER d AS n, max(dense) OVER d AS distinct_n, min(twice) OVER d AS low, max(twice) OVER d AS high
          FROM (SELECT *, row_number() OVER (PARTITION BY date, model ORDER BY signal, ticker) AS rn, dense_rank() OVER (PARTITION BY date, model ORDER BY signal) AS dense,
                  2 * rank() OVER (PARTITION BY date, model ORDER BY signal) + count(*) OVER (PARTITION BY date, model, signal) - 1 AS twice FROM long)
          WINDOW d AS (PARTITION BY date, model))"""


CTES |= {
    "deciles": _buckets(10),
    "ew": "SELECT date, model, decile, avg(ret) AS ret FROM deciles WHERE ret IS NOT NULL GROUP BY ALL",
    "vw": "SELECT date, model, decile, sum(coalesce(w, 0) * ret) / nullif(sum(coalesce(w, 0)), 0) AS ret FROM deciles WHERE ret IS NOT NULL GROUP BY ALL",
    "ew_all": """SELECT date, model, CAST(decile AS VARCHAR) AS bucket, ret FROM ew
        UNION ALL SELECT date, model, 'LS', max(ret) FILTER (WHERE decile = 10) - max(ret) FILTER (WHERE decile = 1) FROM ew GROUP BY date, model""",
    "weights": "SELECT ticker, date, model, CAST(decile AS VARCHAR) AS bucket, 1.0::DOUBLE / count(*) OVER (PARTITION BY date, model, decile) AS weight FROM deciles",
    "dates": "SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM weights)",
    "moves": """SELECT model, bucket, idx, ticker, sum(change) AS change FROM (
        SELECT model, bucket, idx, ticker, weight AS change FROM weights JOIN dates USING (date)
        UNION ALL SELECT model, bucket, idx + 1, ticker, -weight FROM weights JOIN dates USING (date)) GROUP BY ALL""",
    "traded": "SELECT model, bucket, idx, sum(abs(change)) * 0.5 AS moved FROM moves GROUP BY ALL",
    "turnover": """SELECT date, model, bucket, CASE WHEN idx > 1 THEN coalesce(moved, 0) END AS turnover
        FROM (SELECT DISTINCT model, bucket FROM weights) CROSS JOIN dates LEFT JOIN traded USING (model, bucket, idx)""",
    "spread": """SELECT date, model, max(ret) FILTER (WHERE decile = hi) - max(ret) FILTER (WHERE decile = lo) AS ret
        FROM ew JOIN (SELECT model, min(decile) AS lo, max(decile) AS hi FROM ew GROUP BY model) USING (model) GROUP BY date, model""",
    "pairs": "SELECT a.date, a.ret AS a, b.ret AS b FROM spread a JOIN spread b USING (date) WHERE a.model = 'momentum' AND b.model = 'value' AND a.ret IS NOT NULL AND b.ret IS NOT NULL",
    "early": f"""SELECT ticker, date, ret - RF AS y, MKT AS a, SMB AS b, HML AS c FROM returns LEFT JOIN factors USING (date)""",
    "sums3": f"""SELECT ticker, date, count(y) OVER w AS n, {", ".join(f"sum({x}) OVER w AS s{x}" for x in "yabc")},
        {", ".join(f"sum({x} * {z}) OVER w AS s{x}{z}" for i, x in enumerate("abcy") for z in "abcy"[i:])} FROM early WINDOW w AS ({_T} ROWS BETWEEN {TRAIN_MAX - 1} PRECEDING AND CURRENT ROW)""",
    # Centred products m, and slopes of the three factors by Cramer's rule.
    "centred3": f"""SELECT ticker, date, n, sy, sa, sb, sc, {", ".join(f"s{x}{z} - s{x} * s{z} / n AS m{x}{z}" for i, x in enumerate("abcy") for z in "abcy"[i:])} FROM sums3 WHERE n >= {TRAIN_MIN}""",
    "solved3": """SELECT *, maa * (mbb * mcc - mbc * mbc) - mab * (mab * mcc - mbc * mac) + mac * (mab * mbc - mbb * mac) AS det FROM centred3""",
    "fitted3": """SELECT ticker, date, n, sy, sa, sb, sc,
        (may * (mbb * mcc - mbc * mbc) - mab * (mby * mcc - mbc * mcy) + mac * (mby * mbc - mbb * mcy)) / det AS k1,
        (maa * (mby * mcc - mcy * mbc) - may * (mab * mcc - mbc * mac) + mac * (mab * mcy - mby * mac)) / det AS k2,
        (maa * (mbb * mcy - mbc * mby) - mab * (mab * mcy - mby * mac) + may * (mab * mbc - mbb * mac)) / det AS k3 FROM solved3""",
    "loadings": f"""SELECT ticker, date, lag(sy / n - k1 * sa / n - k2 * sb / n - k3 * sc / n) OVER ({_T}) AS alpha_ff3, lag(k1) OVER ({_T}) AS beta_MKT, lag(k2) OVER ({_T}) AS beta_SMB, lag(k3) OVER ({_T}) AS beta_HML FROM fitted3
        QUALIFY beta_MKT IS NOT NULL""",
    "fit2": "SELECT date, momentum AS a, value AS b, next_return AS y FROM features LEFT JOIN nexts USING (ticker, date) WHERE momentum IS NOT NULL AND value IS NOT NULL AND next_return IS NOT NULL",
    "moments2": "SELECT date, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab, sum(a * y) AS say, sum(b * y) AS sby FROM fit2 GROUP BY date",
    "dated2": "SELECT d.date, row_number() OVER (ORDER BY d.date) - 1 AS place, m.* EXCLUDE (date) FROM (SELECT DISTINCT date FROM features) d LEFT JOIN moments2 m USING (date)",
    "windows2": f"""SELECT date, place, {", ".join(f"sum({x}) OVER w AS {x}" for x in ("n", "sa", "sb", "sy", "saa", "sbb", "sab", "say", "sby"))}
        FROM dated2 WINDOW w AS (ORDER BY date ROWS BETWEEN {TRAIN_MAX} PRECEDING AND 1 PRECEDING)""",
    "scored": "SELECT ticker, date, model, signal, ret AS y FROM long WHERE ret IS NOT NULL",
    "fit1": """SELECT date, momentum AS x, next_return AS y FROM features LEFT JOIN nexts USING (ticker, date)""",
    "moments": """SELECT date, count(y) FILTER (WHERE x IS NOT NULL) AS n, sum(x) FILTER (WHERE y IS NOT NULL) AS sx, sum(y) FILTER (WHERE x IS NOT NULL) AS sy,
        sum(x * x) FILTER (WHERE y IS NOT NULL) AS sxx, sum(x * y) AS sxy FROM fit1 GROUP BY date""",
    "windows": f"""SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy
        FROM moments WINDOW w AS (ORDER BY date ROWS BETWEEN {TRAIN_MAX} PRECEDING AND 1 PRECEDING)""",
}


def query(select: str) -> str:
    """select over the tables above: as many of them as it needs are put in front."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in CTES.items()) + "\n" + select


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def s9(column: str, out: str | None = None) -> str:
    """To nine significant digits, for values of very different sizes."""
    return f"CAST(printf('%.8e', {column}) AS DOUBLE) AS {out or column}"


def net_sql(spread: str) -> str:
    return f"""SELECT date, model, 'long_short' AS bucket, {spread} AS ret FROM (
      SELECT date, model, max(ret) FILTER (WHERE decile = hi) - max(ret) FILTER (WHERE decile = lo) AS gross,
             coalesce(max(cost) FILTER (WHERE decile = hi), 0) AS c_top, coalesce(max(cost) FILTER (WHERE decile = lo), 0) AS c_bottom
      FROM (SELECT e.date, e.model, e.decile, e.ret, coalesce(t.turnover, 0) * 0.0025::DOUBLE AS cost FROM ew e LEFT JOIN turnover t ON t.date = e.date AND t.model = e.model AND t.bucket = CAST(e.decile AS VARCHAR))
      JOIN (SELECT model, min(decile) AS lo, max(decile) AS hi FROM ew GROUP BY model) USING (model) GROUP BY date, model)"""


NET = """SELECT e.date, e.model, e.bucket, e.ret - CASE WHEN e.bucket = 'LS' THEN 0 ELSE coalesce(t.turnover, 0) * {rate} END AS ret
      FROM ew_all e LEFT JOIN turnover t ON t.date = e.date AND t.model = e.model AND t.bucket = e.bucket"""


def performance_sql(source: str, *, clipped: bool, keys: str = "model, bucket") -> str:
    ret = "CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.9), 2.0) END" if clipped else "ret"
    return f"""rows_ AS (SELECT {keys}, date, {ret} AS ret FROM ({source}) WHERE ret IS NOT NULL),
    path AS (SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM rows_ WHERE ret > -0.999),
    down AS (SELECT *, cum / max(cum) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM path),
    stats AS (SELECT {keys}, avg(ret) * 12 AS mean_return, stddev_samp(ret) * sqrt(12::DOUBLE) AS volatility, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12::DOUBLE) AS sharpe_ratio,
      CASE WHEN count(ret) > 1 THEN avg(ret) / nullif(stddev_samp(ret) / sqrt(count(ret)), 0) END AS t_stat_mean FROM rows_ GROUP BY {keys}),
    lows AS (SELECT {keys}, min(drawdown) AS max_drawdown FROM down GROUP BY {keys})"""


def with_performance(source: str, select: str, **kw) -> str:
    return query("").rstrip() + ",\n" + performance_sql(source, **kw) + "\n" + select


PERF = ("mean_return", "volatility", "sharpe_ratio", "t_stat_mean", "max_drawdown")


def xrank(method: str) -> str:
    d, same = "PARTITION BY date", "count(*) OVER (PARTITION BY date, momentum)"
    n = f"count(momentum) OVER ({d})"
    up = f"({d} ORDER BY momentum NULLS LAST)"
    return {
        "average": f"(rank() OVER {up} + ({same} - 1) / 2) / {n}",
        "min": f"rank() OVER {up} / {n}",
        "max": f"(rank() OVER {up} + {same} - 1) / {n}",
        "first": f"row_number() OVER ({d} ORDER BY momentum NULLS LAST, ticker) / {n}",
        "dense": f"dense_rank() OVER {up} / (SELECT count(DISTINCT momentum) FROM features g WHERE g.date = f.date)",
    }[method]


def two_slopes(table: str, where: str) -> str:
    """Intercept and slopes on momentum and value for each date of a table of their sums."""
    return f"""SELECT date, sy / n - k1 * sa / n - k2 * sb / n AS k0, k1, k2 FROM (
      SELECT *, (may * mbb - mby * mab) / (maa * mbb - mab * mab) AS k1, (maa * mby - mab * may) / (maa * mbb - mab * mab) AS k2 FROM (
        SELECT *, saa - sa * sa / n AS maa, sbb - sb * sb / n AS mbb, sab - sa * sb / n AS mab, say - sa * sy / n AS may, sby - sb * sy / n AS mby FROM {table} WHERE {where}))"""


def one_slope(shrunk: str, windows: str = "windows") -> str:
    """Predictions on one scaled feature; shrunk: its coefficient from q (product with the target) and n."""
    return f"""SELECT ticker, date, round(sy / n + {shrunk} * (momentum - sx / n) / sd, 6) AS prediction FROM features
    JOIN (SELECT *, (sxy - sx * sy / n) / sd AS q FROM (SELECT *, sqrt(sxx / n - sx / n * sx / n) AS sd FROM {windows} WHERE place >= {TRAIN_MIN} AND n > 0)) USING (date) WHERE momentum IS NOT NULL"""


_CHARACTERS = ("dollar_volume", "value", "momentum", "volatility", "investment", "profitability")
_LOADINGS = ("alpha_ff3", "beta_MKT", "beta_SMB", "beta_HML")


def modeling_sql(standard: str) -> str:
    made = ", ".join(f"{standard.format(c=c)} AS {c}" for c in _CHARACTERS)
    return query(f"""SELECT ticker, date, {r6(*_CHARACTERS, *_LOADINGS, 'next_return')} FROM (SELECT ticker, date, {made} FROM features WINDOW d AS (PARTITION BY date))
    JOIN loadings USING (ticker, date) JOIN nexts USING (ticker, date) WHERE {" AND ".join(f"{c} IS NOT NULL" for c in (*_CHARACTERS, *_LOADINGS, "next_return"))}""")


_FEATURE = lambda c: query(f"SELECT ticker, date, {r6(c)} FROM every WHERE {c} IS NOT NULL")

ORACLES = {
    "daily_panel": query(f"SELECT ticker, date, {r6('adj_close', 'volume')} FROM daily"),
    "tail_rows": query(f"SELECT ticker, date, {r6('adj_close')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM daily) WHERE k <= 100"),
    "ticker_sample": query(f"SELECT ticker, date, {r6('adj_close', 'volume')} FROM daily WHERE CAST('0x' || substr(md5(CAST(ticker AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 5000"),
    "safe_cast": """SELECT o_orderkey, CASE WHEN isfinite(v) THEN v END AS x FROM (SELECT o_orderkey, try_cast(CASE o_orderkey % 8
      WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN ' ' || CAST(o_orderkey AS VARCHAR) || ' ' WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN 'nan' WHEN 5 THEN '1e400' WHEN 6 THEN '-1.5e3' ELSE o_orderstatus END AS DOUBLE) AS v FROM orders)""",
    "daily_return": query(f"SELECT ticker, date, {r6('ret')} FROM dret"),
    "realized_vol": query(f"SELECT ticker, date, {r6('rvol')} FROM dvol"),
    "monthly_resample_last": query(f"SELECT ticker, date, {r6('price', 'volume', 'vol')} FROM observed"),
    "month_spine": query("SELECT ticker, date, price IS NULL AS is_gap FROM months"),
    "monthly_return": query(f"SELECT ticker, date, {r6('ret')} FROM returns"),
    "dollar_volume": _FEATURE("dollar_volume"),
    "value_ma": _FEATURE("value_ma"),
    "value_reversal": query(f"SELECT ticker, date, {s9('value_reversal')} FROM every WHERE value_reversal IS NOT NULL"),
    "momentum_reference": _FEATURE("momentum_reference"),
    "momentum_standard": _FEATURE("momentum_standard"),
    "volatility": _FEATURE("volatility"),
    "investment": _FEATURE("investment"),
    "profitability_sharpe": _FEATURE("profitability_sharpe"),
    "profitability_rov": _FEATURE("profitability_rov"),
    "features_all": query(f"SELECT ticker, date, {r6('dollar_volume', 'value', 'momentum', 'volatility', 'investment', 'profitability')} FROM features"),
    "factor_series": query(f"SELECT date, {r6('MKT', 'SMB', 'HML', 'RF')} FROM factors"),
    "next_return": query(f"SELECT ticker, date, {r6('next_return')} FROM nexts"),
    "zscore_char": query("SELECT ticker, date, round(coalesce((momentum - avg(momentum) OVER d) / nullif(stddev_pop(momentum) OVER d, 0), 0), 6) AS momentum FROM features WINDOW d AS (PARTITION BY date)"),
    **{f"pct_rank_{m}": query(f"SELECT ticker, date, round(CASE WHEN momentum IS NOT NULL THEN {xrank(m)} END, 6) AS momentum_rank FROM features f") for m in ("average", "min", "max", "first", "dense")},
    "modeling_panel": modeling_sql("coalesce(({c} - avg({c}) OVER d) / nullif(stddev_pop({c}) OVER d, 0), 0)"),
    "modeling_panel_ranks": modeling_sql("CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2) / count({c}) OVER d END"),
    "decile_qcut": query("SELECT ticker, date, model, decile FROM deciles"),
    "decile_cut_fallback": query(f"SELECT ticker, date, model, decile FROM ({_buckets(FALLBACK)})"),
    "decile_returns_ew": query(f"SELECT date, model, bucket, {r6('ret')} FROM ew_all"),
    "decile_returns_vw": query(f"SELECT date, model, CAST(decile AS VARCHAR) AS bucket, {r6('ret')} FROM vw"),
    "decile_pivot": query("SELECT date, model, " + ", ".join(f'round(max(ret) FILTER (WHERE bucket = \'{b}\'), 6) AS "b_{b}"' for b in [*range(1, 11), "LS"]) + " FROM ew_all GROUP BY date, model"),
    "long_short": query(f"SELECT date, model, 'long_short' AS bucket, {r6('ret')} FROM spread"),
    "long_short_capped": query("SELECT date, model, 'long_short' AS bucket, round(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.05), 0.05) END, 6) AS ret FROM spread"),
    "decile_weights_ew": query(f"SELECT ticker, date, model, bucket, {r6('weight')} FROM weights"),
    "decile_weights_vw": query("SELECT ticker, date, model, CAST(decile AS VARCHAR) AS bucket, round(CASE WHEN coalesce(total, 0) = 0 THEN 1.0::DOUBLE / n ELSE w / total END, 6) AS weight FROM (SELECT *, sum(w) OVER d AS total, count(*) OVER d AS n FROM deciles WINDOW d AS (PARTITION BY date, model, decile)) WHERE coalesce(total, 0) = 0 OR w IS NOT NULL"),
    "turnover": query(f"SELECT date, model, bucket, {r6('turnover')} FROM turnover"),
    "net_returns": query(f"SELECT date, model, bucket, {r6('ret')} FROM ({NET.format(rate='0.0025::DOUBLE')})"),
    "ls_cost_correct": query(f"SELECT date, model, bucket, {r6('ret')} FROM ({net_sql('gross - (c_top + c_bottom)')})"),
    "ls_cost_derived": query(f"SELECT date, model, bucket, {r6('ret')} FROM ({net_sql('gross - c_top + c_bottom - (c_top + c_bottom)')})"),
    "perf_summary": with_performance(NET.format(rate="0.0025::DOUBLE"), f"SELECT model, bucket, {r6(*PERF, 'avg_turnover')} FROM stats JOIN lows USING (model, bucket) LEFT JOIN (SELECT model, bucket, avg(turnover) AS avg_turnover FROM turnover GROUP BY ALL) USING (model, bucket)", clipped=True),
    "basic_summary": with_performance("SELECT * FROM ew_all", f"SELECT model, bucket, {r6(*PERF)} FROM stats LEFT JOIN lows USING (model, bucket)", clipped=False),
    "cumulative": with_performance("SELECT * FROM ew_all", f"SELECT date, model, bucket, {s9('cum')} FROM path", clipped=True),
    "drawdown": with_performance("SELECT * FROM ew_all", f"SELECT date, model, bucket, {r6('drawdown')} FROM down", clipped=True),
    "tc_stress": with_performance(
        f"SELECT tc_bps, date, model, bucket, ret FROM (SELECT unnest([0.0, 10.0, 25.0, 50.0]::DOUBLE[]) AS tc_bps), ({NET.format(rate='0')}) WHERE bucket = 'LS'",
        f"SELECT tc_bps, model, bucket, {r6(*PERF)} FROM stats JOIN lows USING (tc_bps, model, bucket)", clipped=True, keys="tc_bps, model, bucket",
    ),
    "late_rows": query(f"SELECT ticker, date, {r6('ret')} FROM returns WHERE date >= DATE '2000-01-31'"),
    "user_day_ranks": """SELECT ticker, date, round((rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) AS value_rank
      FROM (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, sum(CAST(value AS DOUBLE)) AS v FROM events GROUP BY 1, 2)""",
    "clip_realized": query("SELECT ticker, date, round(least(greatest(realized, -0.1), 0.2), 6) AS realized_return FROM signals WHERE realized IS NOT NULL"),
    "oos_r2": query(f"SELECT {s9('1 - sum((y - signal) * (y - signal)) / nullif(var_pop(y) * count(y), 0)', 'oos_r2')} FROM scored WHERE model = 'momentum'"),
    "forecast_accuracy": query(
        f"""SELECT model, {s9('1 - sum(e * e) / nullif(sum(s * s), 0)', 'oos_r2')}, {s9('avg(abs(e))', 'mae')}, {s9('avg(e * e)', 'mse')}
    FROM (SELECT model, y - signal AS e, y - avg(y) OVER (PARTITION BY date, model) AS s FROM scored) GROUP BY model"""
    ),
    "spearman_by_date": query(
        """SELECT date, model, round(covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0), 6) AS spearman FROM (
      SELECT date, model, (rank() OVER (PARTITION BY date, model ORDER BY signal) + (count(*) OVER (PARTITION BY date, model, signal) - 1) / 2) / count(*) OVER (PARTITION BY date, model) AS p,
        (rank() OVER (PARTITION BY date, model ORDER BY y) + (count(*) OVER (PARTITION BY date, model, y) - 1) / 2) / count(*) OVER (PARTITION BY date, model) AS q FROM scored)
    GROUP BY date, model HAVING count(*) >= 2"""
    ),
    "dm_stat": query(
        f"""SELECT 'momentum' AS model_1, 'value' AS model_2, round(avg(d) / sqrt((sum(u * u) / n + 2 * (2.0 / 3) * sum(u * u1) / n + 2 * (1.0 / 3) * sum(u * u2) / n) / n), 6) AS dm_stat, {s9('avg(d)', 'mean_loss_diff')}, n AS periods
    FROM (SELECT *, lag(u, 1) OVER (ORDER BY date) AS u1, lag(u, 2) OVER (ORDER BY date) AS u2, count(*) OVER () AS n FROM (SELECT date, d, d - avg(d) OVER () AS u FROM (
      SELECT date, avg((momentum - realized) * (momentum - realized) - (value - realized) * (value - realized)) AS d FROM signals WHERE momentum IS NOT NULL AND value IS NOT NULL AND realized IS NOT NULL GROUP BY date))) GROUP BY n"""
    ),
    "jk_stat": query(
        """SELECT round(s1, 6) AS sharpe_1, round(s2, 6) AS sharpe_2, round(s1 - s2, 6) AS sharpe_diff, round(CASE WHEN v > 0 THEN (s1 - s2) / sqrt(v) END, 6) AS jk_stat, n AS periods FROM (
      SELECT *, (2 * (1 - rho) * s1 * s2 + 0.5 * (s1 * s1 + s2 * s2)) / n - (s1 - s2) * (s1 - s2) / (2 * (n - 1)) AS v FROM (
        SELECT avg(a) / stddev_samp(a) * sqrt(12::DOUBLE) AS s1, avg(b) / stddev_samp(b) * sqrt(12::DOUBLE) AS s2, covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) AS rho, count(*) AS n FROM pairs))"""
    ),
    "pred_rank_riskadj": query(
        """SELECT ticker, date, round((rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) AS prediction_rank
    FROM (SELECT ticker, date, momentum / volatility AS x FROM features WHERE momentum IS NOT NULL AND volatility <> 0)"""
    ),
    "pred_rank_zscore": query("SELECT ticker, date, round((rank() OVER (PARTITION BY date ORDER BY momentum) + (count(*) OVER (PARTITION BY date, momentum) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) AS prediction_rank FROM features WHERE momentum IS NOT NULL"),
    "exposures_1factor": query(
        f"""SELECT ticker, date, round(lag(a) OVER ({_T}), 6) AS alpha_ff3, round(lag(b) OVER ({_T}), 6) AS beta_MKT FROM (
      SELECT ticker, date, regr_intercept(x, MKT) OVER w AS a, regr_slope(x, MKT) OVER w AS b, count(x) OVER w AS n
      FROM (SELECT ticker, date, ret - RF AS x, MKT FROM returns JOIN factors USING (date)) WINDOW w AS ({_T} ROWS BETWEEN {TRAIN_MAX - 1} PRECEDING AND CURRENT ROW))
    WHERE n >= {TRAIN_MIN} QUALIFY lag(b) OVER ({_T}) IS NOT NULL"""
    ),
    "xs_ols_1feature": query(
        """SELECT ticker, date, round(a + b * momentum, 6) AS prediction FROM features
    JOIN (SELECT date, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM fit1 WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY date HAVING count(*) >= 3) USING (date) WHERE momentum IS NOT NULL"""
    ),
    "rolling_ols_1feature": query(
        f"""SELECT ticker, date, round(sy / n - b * sx / n + b * momentum, 6) AS prediction FROM features
    JOIN (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM windows WHERE place >= {TRAIN_MIN} AND n > 0) USING (date) WHERE momentum IS NOT NULL"""
    ),
    "ridge_1feature": query(one_slope("q / (n + 10)")),
    "lasso_1feature": query(one_slope("sign(q) * greatest(abs(q) - n * 0.001::DOUBLE, 0) / n")),
    "elasticnet_1feature": query(one_slope("sign(q) * greatest(abs(q) - n * 0.002::DOUBLE * 0.5, 0) / (n + n * 0.002::DOUBLE * 0.5)")),
    "expanding_ols_1feature": query(
        f"""SELECT ticker, date, round(sy / n - b * sx / n + b * momentum, 6) AS prediction FROM features JOIN (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b FROM (
      SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy
      FROM moments WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE place >= {TRAIN_MIN} AND n > 0) USING (date) WHERE momentum IS NOT NULL"""
    ),
    "xs_ols_2features": query(f"SELECT ticker, date, round(k0 + k1 * momentum + k2 * value, 6) AS prediction FROM features JOIN ({two_slopes('moments2', 'n >= 4')}) USING (date) WHERE momentum IS NOT NULL AND value IS NOT NULL"),
    "xs_ols_2features_ranks": query(
        f"""SELECT ticker, date, round((rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) AS prediction FROM (
      SELECT ticker, date, k0 + k1 * momentum + k2 * value AS x FROM features JOIN ({two_slopes('moments2', 'n >= 4')}) USING (date) WHERE momentum IS NOT NULL AND value IS NOT NULL)"""
    ),
    "rolling_ols_2features": query(f"SELECT ticker, date, round(k0 + k1 * momentum + k2 * value, 6) AS prediction FROM features JOIN ({two_slopes('windows2', f'place >= {TRAIN_MIN} AND n > 0')}) USING (date) WHERE momentum IS NOT NULL AND value IS NOT NULL"),
    "exposures_ff3": query(f"SELECT ticker, date, {r6(*_LOADINGS)} FROM loadings"),
    "exposures_ff3_exact": query(f"SELECT ticker, date, {r6(*_LOADINGS)} FROM loadings"),
    "decile_growth": query(f"""SELECT date, model, bucket, {s9('ret')}, {s9('CASE WHEN ret IS NOT NULL THEN cum END', 'cum')} FROM (
      SELECT *, product(1 + ret) OVER (PARTITION BY bucket ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT date, model, bucket, CASE WHEN ret > -0.999 THEN ret END AS ret FROM ew_all WHERE model = 'momentum' AND bucket <> 'LS'))"""),
    "long_short_growth": query(f"""SELECT date, model, 'long_short' AS bucket, {s9('ret')}, {s9('CASE WHEN ret IS NOT NULL THEN cum END', 'cum')} FROM (
      SELECT *, product(1 + ret) OVER (PARTITION BY model ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT date, model, CASE WHEN ret > -0.999 THEN ret END AS ret FROM spread WHERE date >= DATE '1995-01-31'))"""),
    # Deciles go by the order of signals, so those of a signal's ranks are the same.
    "rank_vs_raw": query(f"""SELECT date, {s9('ret', 'raw')}, {s9('ret', 'rank')}, {s9('cum', 'cum_raw')}, {s9('cum', 'cum_rank')} FROM (
      SELECT date, ret, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT date, least(greatest(ret, -1), 1) AS ret FROM spread WHERE model = 'momentum' AND date >= DATE '1995-01-31' AND ret > -0.999))"""),
    "plot_suite_costs": with_performance(
        f"SELECT tc_bps, date, model, bucket, ret FROM (SELECT unnest([0.0, 10.0, 25.0, 50.0]::DOUBLE[]) AS tc_bps), ({NET.format(rate='0')}) WHERE bucket = 'LS'",
        f"SELECT date, tc_bps, model, bucket, {s9('cum')} FROM path WHERE date >= DATE '1995-01-31'", clipped=True, keys="tc_bps, model, bucket",
    ),
    "dm_table": query(
        f"""SELECT 'momentum' AS model_1, 'value' AS model_2, {s9('avg(d) / sqrt(var_pop(d) / count(d))', 'dm_stat')}, {s9('avg(d)', 'mean_loss_diff')}, count(d) AS periods FROM (
      SELECT date, avg((momentum - realized) * (momentum - realized) - (value - realized) * (value - realized)) AS d FROM signals WHERE momentum IS NOT NULL AND value IS NOT NULL AND realized IS NOT NULL GROUP BY date)"""
    ),
}
ORACLES["sharpe_table"] = ORACLES["jk_stat"].replace("SELECT round(s1, 6)", "SELECT 'momentum' AS model_1, 'value' AS model_2, round(s1, 6)", 1)
ORACLES["csv_panel"], ORACLES["csv_factors"] = ORACLES["daily_panel"], ORACLES["factor_series"]
ORACLES["csv_symbols"] = query("SELECT DISTINCT CAST(ticker AS VARCHAR) AS ticker FROM daily")
ORACLES["pct_rank_ranged"], ORACLES["decile_ranged"], ORACLES["modeling_panel_ranged"] = ORACLES["pct_rank_average"], ORACLES["decile_qcut"], ORACLES["modeling_panel"]


def _tree_level(k: int) -> str:
    """Of each date and node the cut of a feature that lowers squared errors most, and the nodes below it."""
    return f"""
cells{k} AS (SELECT date, node, f, x, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM (
    SELECT date, node, y, unnest([1, 2]) AS f, unnest([momentum, value]) AS x FROM node{k} WHERE y IS NOT NULL) GROUP BY ALL),
cuts{k} AS (SELECT *, lead(x) OVER w AS nx, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER p AS an, sum(s) OVER p AS al, sum(q) OVER p AS aq
    FROM cells{k} WINDOW p AS (PARTITION BY date, node, f), w AS (PARTITION BY date, node, f ORDER BY x)),
scored{k} AS (SELECT *, ls * ls / ln + (al - ls) * (al - ls) / (an - ln) AS score FROM cuts{k} WHERE nx IS NOT NULL AND ln >= {TREE_LEAF} AND an - ln >= {TREE_LEAF}),
best{k} AS (SELECT date, node, f, (x + nx) / 2 AS cut FROM scored{k} WHERE score > al * al / an + 1e-12 * (1 + aq) QUALIFY row_number() OVER (PARTITION BY date, node ORDER BY score DESC, f, x) = 1),
node{k + 1} AS (SELECT ticker, date, momentum, value, y, CASE WHEN f IS NULL THEN node ELSE 2 * node + CAST(CASE f WHEN 1 THEN momentum ELSE value END > cut AS INTEGER) END AS node
    FROM node{k} LEFT JOIN best{k} USING (date, node))"""


ORACLES["xs_tree"] = query(f"""SELECT ticker, date, round(p, 6) AS prediction FROM (
  WITH node0 AS (SELECT ticker, date, momentum, value, realized AS y, 1 AS node FROM signals WHERE momentum IS NOT NULL AND value IS NOT NULL),{_tree_level(0)},{_tree_level(1)},
  leaves AS (SELECT date, node, avg(y) AS p FROM node2 WHERE y IS NOT NULL GROUP BY ALL)
  SELECT ticker, date, p FROM node2 JOIN leaves USING (date, node))""")
