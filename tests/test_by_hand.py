"""Indicators against formulas written with pandas, not rendered from the expressions."""

import numpy as np
import pandas as pd
import pytest

from sparktide.ta import TA


def table(n=160, seed=3):
    rng = np.random.default_rng(seed)
    close = 50 + np.cumsum(rng.normal(0, 1, n))
    open_ = close + rng.normal(0, 0.5, n)
    high, low = np.maximum(open_, close) + rng.random(n), np.minimum(open_, close) - rng.random(n)
    return pd.DataFrame({"sym": "a", "ts": pd.date_range("2021-01-01", periods=n), "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 99, n) * 10.0})


def ema(x, n):
    """Seeded by the mean of the first n values from the first one that is there."""
    x = x.loc[x.first_valid_index() :].copy()
    out = x.copy()
    out.iloc[: n - 1] = np.nan
    out.iloc[n - 1] = x.iloc[:n].mean()
    return out.ewm(span=n, adjust=False).mean()


def kvo(t):
    step = ((t.high + t.low + t.close) / 3).diff()
    flow = t.volume * np.sign(step).fillna(1)
    value = ema(flow, 34) - ema(flow, 55)
    return {"KVO_34_55_13": value, "KVOs_34_55_13": ema(value, 13)}


def ulcer(t, everget):
    top = t.close.rolling(14).max()
    square = (100 * (t.close - top) / top) ** 2
    return np.sqrt((square.rolling(14).mean() if everget else square.rolling(14).sum()) / 14)


def ttm(t):
    return pd.Series(np.where(t.close > ((t.high + t.low) / 2).rolling(6).mean(), 1.0, -1.0), t.index)


def cmf(t):
    flow = (2 * t.close - t.high - t.low) / (t.high - t.low) * t.volume
    return flow.rolling(20).sum() / t.volume.rolling(20).sum()


def willr(t):
    top, bottom = t.high.rolling(14).max(), t.low.rolling(14).min()
    return 100 * ((t.close - bottom) / (top - bottom) - 1)


CASES = {
    "kvo": ({}, kvo),
    "ui": ({}, lambda t: {"UI_14": ulcer(t, False)}),
    "ui everget": ({"everget": True}, lambda t: {"UIe_14": ulcer(t, True)}),
    "ttm_trend": ({}, lambda t: {"TTM_TRND_6": ttm(t)}),
    "cmf": ({}, lambda t: {"CMF_20": cmf(t)}),
    "willr": ({}, lambda t: {"WILLR_14": willr(t)}),
    "roc": ({}, lambda t: {"ROC_10": 100 * (t.close / t.close.shift(10) - 1)}),
    "efi": ({}, lambda t: {"EFI_13": ema(t.close.diff() * t.volume, 13)}),
}


@pytest.mark.parametrize("case", CASES)
def test_by_hand(spark, case):
    params, formula = CASES[case]
    t = table()
    ta = TA(spark.createDataFrame(t), by="sym", ts="ts")
    got = ta.call(case.split()[0], **params).toPandas().sort_values("ts").reset_index(drop=True)
    for name, want in formula(t).items():
        np.testing.assert_allclose(got[name].astype(float), want.reindex(t.index), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=name)


def signalled(x, name, xa, xb, cross):
    """Thresholds as columns; a crossing down is neither above now nor below before."""
    out = {}
    for value, side in ((xa, "A"), (xb, "B")):
        if value is None:
            continue
        text = str(value).replace(".", "_")
        if cross:
            now, before = x > value, x.shift(1) < value
            out |= {f"{name}_XA_{text}": now & before, f"{name}_XB_{text}": ~now & ~before}
        else:
            out[f"{name}_{side}_{text}"] = x >= value if side == "A" else x <= value
    return out


@pytest.mark.parametrize("kind, params", [("rsi", {}), ("rsi", {"cross_values": True, "xa": 60, "xb": 40.5}), ("er", {"xa": 0.5, "xb": 0.2}), ("rsx", {"offset": 2}), ("macd", {}), ("macd", {"xa": 0.25})])
def test_signal_indicators(spark, kind, params):
    rows = TA(spark.createDataFrame(table()), "sym", "ts").call(kind, signal_indicators=True, **params).toPandas().sort_values("ts", ignore_index=True)
    given = {k: v for k, v in params.items() if k in ("xa", "xb")}
    if kind == "macd":
        first = next(c for c in rows if c.startswith("MACDh_"))
        second = first.replace("MACDh", "MACD")
        wanted = signalled(rows[first], first, given.get("xa", 0), None, True) | signalled(rows[second], second, 0, None, False)
    else:
        name = rows.columns[2]
        wanted = signalled(rows[name], name, given.get("xa", 80), given.get("xb", 20), params.get("cross_values", False))
    signs = [c for c in rows.columns[2:] if c in wanted]
    assert set(signs) == set(wanted) and len(rows.columns) == 2 + len(wanted) + (3 if kind == "macd" else 1)
    for c in signs:
        expected = wanted[c].astype(float).shift(params.get("offset", 0))
        np.testing.assert_array_equal(rows[c].to_numpy(float), expected.to_numpy(float), err_msg=c)


def metrics(x, ts, rate, period, log, use_cagr, tf, years, method):
    """Metrics of one series by their definitions; the first row has no return but counts."""
    units = lambda t: (t.iloc[-1] - t.iloc[0]).days / {"years": 252, "months": 30.417, "weeks": 7, "days": 1}[tf]
    yearly = lambda t: (t.iloc[-1] - t.iloc[0]).days / 252
    growth = lambda x, t: (x.iloc[-1] / x.iloc[0]) ** (1 / yearly(t)) - 1
    falls = lambda x: {"dollar": (x.cummax() - x).max(), "percent": (1 - x / x.cummax()).max(), "log": (np.log(x.cummax()) - np.log(x)).max()}
    r = np.log(x / x.shift(1)) if log else x / x.shift(1) - 1

    def downside(rate, per):
        under = (1 + rate) ** (1 / per) - 1 - r
        return np.sqrt((under[under > 0] ** 2).sum() / (len(r) - 1)) * np.sqrt(per)

    late = ts > ts.iloc[-1] - pd.Timedelta(days=365.25 * years)
    volatility = np.sqrt(len(r) / units(ts)) * r.std()
    excess = period * r.mean() - rate
    return {
        "cagr": growth(x, ts), "max_drawdown": falls(x)["dollar"], "max_drawdown_pct": falls(x)["percent"], "max_drawdown_log": falls(x)["log"], "log_max_drawdown": np.log(x.iloc[-1] / x.iloc[0]) - falls(x)["log"],
        "calmar_ratio": growth(x[late], ts[late]) / falls(x[late])[method], "downside_deviation": downside(rate, len(r) / units(ts)), "volatility": volatility,
        "sharpe_ratio": growth(x, ts) / (np.sqrt(len(r) / yearly(ts)) * r.std()) if use_cagr else excess / (np.sqrt(period) * r.std()),
        "sortino_ratio": (growth(x, ts) - rate) / downside(0, len(r) / yearly(ts)), "optimal_leverage": excess / (period * r.std() ** 2), "pure_profit_score": 0.0,
    }


@pytest.mark.parametrize(
    "params",
    [dict(rate=0.0, period=252, log=False, use_cagr=False, tf="years", years=3, method="percent"), dict(rate=0.05, period=365, log=True, use_cagr=True, tf="months", years=0.2, method="log")],
)
def test_metrics(spark, params):
    from sparktide.operators.metrics import performance

    t = table()
    found = performance(spark.createDataFrame(t), ["sym"], "ts", **{{"rate": "benchmark_rate"}.get(k, k): v for k, v in params.items()}).toPandas().iloc[0]
    for name, value in metrics(t.close, t.ts, **params).items():
        assert found[name] == pytest.approx(value, rel=1e-9), name


def test_alpha_fills_gaps_of_the_benchmark(spark):
    from sparktide.operators.metrics import jensens_alpha
    from sparktide.sources.bars import clean

    t = table()[["sym", "ts", "close", "open"]].rename(columns={"close": "r", "open": "b"})
    t.loc[[0, 5, 6, 7, 40, 158, 159], "b"] = np.nan
    rows = clean(spark.createDataFrame(t))  # NaN as null
    filled = t.b.interpolate()
    has = filled.notna()
    slope, start = np.polyfit(filled[has], t.r[has], 1)
    assert jensens_alpha(rows, ["sym"], "r", "b", "ts").first()["jensens_alpha"] == pytest.approx(start, rel=1e-6)
