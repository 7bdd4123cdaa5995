"""Indicators: SQL on another engine, warm-up, keys, kernels, and the TA entry."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktide.plans.expr import col
from sparktide.plans.queries import all_queries, all_sql
from sparktide.plans.registry import OPS, categories
from sparktide.ta import COMMON_STRATEGY, TA, Strategy, custom

DATA = "/root/testdata/sf0.001"
CHECKED = (
    "sma ema rma wma hma dema t3 kama vidya linreg rsi macd ppo stoch adx atr bbands kc aroon dpo obv ad mfi vwap zscore median quantile beta correl drawdown msw ha cdl_engulfing cdl_harami "
    "cdl_morningstar cdl_mathold td_seq edecay psl cci squeeze cpr performance_metrics vp tos_stdevall as_of_join previous_period cross signals offset_and_fill strategy_common "
    "macd_signals previous_period_month cpr_before_quarter cpr_before_day"
).split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    got = all_queries()[name](spark, DATA).toPandas()
    want = duck.sql(all_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    keys = [k for k in ("sym", "d", "bucket") if k in want]
    for df in (got, want):
        if "d" in df:
            df["d"] = pd.to_datetime(df["d"])
    got, want = (df.sort_values(keys).reset_index(drop=True) for df in (got, want))
    for c in want.columns:
        if c not in keys:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True, err_msg=c)


def bars(n=200, keys=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in keys:
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        open_ = close + rng.normal(0, 0.5, n)
        out.append(pd.DataFrame({"sym": k, "ts": pd.date_range("2020-01-01", periods=n), "open": open_, "high": np.maximum(open_, close) + rng.random(n), "low": np.minimum(open_, close) - rng.random(n), "close": close, "volume": rng.integers(1, 99, n) * 10.0}))
    return pd.concat(out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(bars()).repartition(3)


def one(df, key="a"):
    return df.where(F.col("sym") == key).orderBy("ts").toPandas().reset_index(drop=True)


def test_registry_is_complete():
    sizes = {c: len(n) for c, n in categories().items()}
    assert sizes["overlap"] == 46 and sizes["momentum"] == 53 and sizes["trend"] == 26 and sizes["volatility"] == 18 and sizes["math"] == 31 and sizes["cycles"] == 8
    assert sum(n.startswith("cdl_") for n in OPS) == 64


def test_every_indicator_runs_and_keys_do_not_leak(spark, table):
    from sparktide.plans.queries import INPUTS

    alone = spark.createDataFrame(bars(keys=("a",), seed=1))
    names = [n for n in OPS if OPS[n].category in ("cycles", "performance") or n in ("sma", "ema", "supertrend", "psar", "sarext", "jma", "rsx", "qqe", "hilo", "mama", "fisher", "pmax", "cdl_hikkake")]
    both, single = TA(table, "sym", "ts"), TA(alone, "sym", "ts")
    for n in names:
        both = both.appended({f"{n}:{k}": e for k, e in both.outputs(n, **INPUTS.get(n, {})).items()})
        single = single.appended({f"{n}:{k}": e for k, e in single.outputs(n, **INPUTS.get(n, {})).items()})
    x, y = one(both.frame), one(single.frame)
    pd.testing.assert_frame_equal(x[y.columns], y, check_dtype=False)


def test_warm_up_and_short_keys(spark, table):
    got = one(TA(table, "sym", "ts").call("sma", length=20))
    assert got["SMA_20"].isna().sum() == 19
    got = one(TA(table, "sym", "ts").call("rsi", length=14))
    assert got["RSI_14"].isna().sum() == 13
    short = spark.createDataFrame(bars(5, ("s",)))
    assert one(TA(short, "sym", "ts").call("ema", length=10), "s")["EMA_10"].isna().all()
    assert TA(short.where("sym = 'none'"), "sym", "ts").call("rsi").count() == 0


def test_nulls_inside_a_window(spark):
    df = bars(30, ("a",))
    df.loc[df.index == 15, "close"] = None
    got = one(TA(spark.createDataFrame(df).withColumn("close", F.when(~F.isnan("close"), F.col("close"))), "sym", "ts").call("sma", length=5))
    assert got["SMA_5"].isna().sum() == 4 + 5


def test_ema_and_rma_by_hand(table):
    x = one(table)["close"].to_numpy()
    y, k, out = None, 2 / 11, []
    for t, v in enumerate(x):
        y = x[:10].mean() if t == 9 else None if t < 9 else y + k * (v - y)
        out.append(y)
    np.testing.assert_allclose(one(TA(table, "sym", "ts").call("ema"))["EMA_10"].astype(float), np.array(out, float), rtol=1e-12, equal_nan=True)


def test_kernels_by_hand(table):
    b = one(table)
    x = b["close"].to_numpy()
    l0 = l1 = l2 = l3 = x[0]
    out = []
    for t, v in enumerate(x):
        if t:
            n0 = 0.5 * v + 0.5 * l0
            n1 = -0.5 * n0 + l0 + 0.5 * l1
            n2 = -0.5 * n1 + l1 + 0.5 * l2
            l3 = -0.5 * n2 + l2 + 0.5 * l3
            l0, l1, l2 = n0, n1, n2
        d = [l0 - l1, l1 - l2, l2 - l3]
        up, down = sum(max(v, 0) for v in d), sum(max(-v, 0) for v in d)
        out.append(100 * up / (up + down) if up + down else 100 * up)
    np.testing.assert_allclose(one(TA(table, "sym", "ts").call("lrsi"))["LRSI_14"], out, rtol=1e-9)
    sar = one(TA(table, "sym", "ts").call("psar"))
    long, short = sar["PSARl_0.02_0.2"], sar["PSARs_0.02_0.2"]
    assert (long.isna() ^ short.isna())[1:].all() and long.isna()[0] and short.isna()[0] and (long.dropna() < b["close"][long.notna()]).all()
    st = one(TA(table, "sym", "ts").call("supertrend"))
    assert set(st["SUPERTd_7_3.0"]) <= {1.0, -1.0}
    n = 10
    a, c2 = math.exp(-math.pi * math.sqrt(2) / n), None
    c2 = 2 * a * math.cos(math.pi * math.sqrt(2) / n)
    y = list(x[:2])
    for t in range(2, len(x)):
        y.append((1 - c2 + a * a) * x[t] + c2 * y[-1] - a * a * y[-2])
    np.testing.assert_allclose(one(TA(table, "sym", "ts").call("ssf"))["SSF_10_2"], y, rtol=1e-9)


def test_ta_entry(spark, table):
    ta = TA(table, "sym", "ts")
    assert ta.call("bbands", col_numbers=(0,), prefix="P").columns == ["sym", "ts", "P_BBL_5_2.0"]
    assert ta.call("sma", col_names="mine").columns[-1] == "mine"
    assert "SMA_10" in ta.sma(append=True).frame.columns and ta.sma(7).columns[-1] == "SMA_7"
    shifted, plain = one(ta.call("sma", length=3, offset=2)), one(ta.call("sma", length=3))
    np.testing.assert_allclose(shifted["SMA_3"][4:].astype(float), plain["SMA_3"][2:-2].astype(float))
    assert one(ta.call("sma", fillna=0.0))["SMA_10"].notna().all()
    assert not one(ta.call("sma", fill_method="bfill"))["SMA_10"].isna().any()
    for bad in (lambda: ta.call("nothing"), lambda: ta.call("sma", close="zzz"), lambda: Strategy("x", [{"length": 3}]), lambda: ta.strategy("nothing")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        ta.call("sma", wrong=1)
    done = ta.strategy(COMMON_STRATEGY).frame
    assert {"SMA_200", "VOL_SMA_20"} <= set(done.columns)
    chained = ta.strategy(Strategy("s", [{"kind": "sma", "length": 5}, {"kind": "ema", "close": "SMA_5", "length": 3, "col_names": "twice"}])).frame
    assert chained.where("twice is not null").count() > 0
    custom("double_close", lambda close, k=2: {f"D_{k}": close * k})
    assert one(ta.call("double_close"))["D_2"].iloc[0] == pytest.approx(2 * one(table)["close"].iloc[0])
    del OPS["double_close"]


def test_one_exchange_for_many_windows(table):
    ta = TA(table, "sym", "ts")
    for n in ("sma", "bbands", "aroon", "willr", "donchian", "cci", "obv", "kst", "trima"):
        ta = ta.sma(9, append=True) if n == "sma" else ta.call(n, append=True)
    plan = ta.frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(sym") == 1


def test_category_strategy(table):
    frame = TA(table, "sym", "ts").strategy("volatility").frame
    assert frame.count() == 400 and {"TRUERANGE_1", "NATR_14", "UI_14"} <= set(frame.columns)


def test_streaming_average(spark, tmp_path):
    from sparktide.streaming.bars import streaming_averages, streaming_bars

    ticks = pd.DataFrame({"sym": ["a"] * 240, "ts": pd.date_range("2024-01-01", periods=240, freq="15min"), "p": np.arange(240.0)})
    spark.createDataFrame(ticks).write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema("sym string, ts timestamp, p double").parquet(f"{tmp_path}/ticks")
    query = streaming_bars(stream, ["sym"], "ts", "p").writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.table("bars").orderBy("ts").toPandas()
    assert len(got) >= 58 and got["open"].iloc[0] == 0 and got["close"].iloc[0] == 3 and got["volume"].iloc[0] == 4
    spark.createDataFrame(got).write.parquet(f"{tmp_path}/bars")
    bars_ = spark.readStream.schema("sym string, ts timestamp, open double, high double, low double, close double, volume double").parquet(f"{tmp_path}/bars")
    query = streaming_averages(bars_, "sym", 10).writeStream.format("memory").queryName("averages").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    out = spark.table("averages").orderBy("ts").toPandas()
    batch = one(TA(spark.createDataFrame(got), "sym", "ts").call("ema"))
    np.testing.assert_allclose(out["value"].astype(float), batch["EMA_10"].astype(float), rtol=1e-9, equal_nan=True)


def test_column_by_prefix(table):
    assert TA(table, "sym", "ts").column("vol").key == col("volume").key
