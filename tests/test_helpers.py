"""Helpers, bars, custom indicators and tables."""

from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F


def test_weights_and_codes():
    from sparktide.functions import utils as u

    assert u.fibonacci(5) == [1, 1, 2, 3, 5] and u.fibonacci(3, zero=True) == [0, 1, 1, 2]
    assert u.pascals_triangle(4) == [1, 4, 6, 4, 1] and u.pascals_triangle(2, weighted=True, inverse=True) == [0.75, 0.5, 0.75]
    assert u.symmetric_triangle(4) == [1, 2, 2, 1] and sum(u.symmetric_triangle(5, weighted=True)) == pytest.approx(1)
    assert u.combination(5, 2) == 10 and u.combination(3, 2, repetition=True) == 6
    assert u.weights([1, 2])([3, 4]) == 11 and u.zero(1e-20) == 0
    assert u.ma_code("T3") == 8
    with pytest.raises(ValueError):
        u.ma_code("xyz")
    with pytest.raises(TypeError):
        u.ma_code(3)
    assert u.exchange_time("TSE", datetime(2024, 1, 1, 20, tzinfo=timezone.utc)).endswith("TSE: 05:00:00")


def test_bars_from_ticks_and_files(spark, tmp_path):
    from sparktide.sources.bars import normalize_vendor, read_bars, to_bars, write_bars, year_to_date

    ticks = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1, 5.0), ("a", "2024-01-01 11:00:00", 2, 9.0), ("a", "2024-01-01 12:00:00", 3, 2.0), ("a", "2024-01-02 10:00:00", 4, 3.0)], "sym string, ts string, id int, p double").withColumn("ts", F.to_timestamp("ts"))
    bars = to_bars(ticks, ["sym"], F.to_date("ts"), "p", F.count("*"), ["ts", "id"], "d")
    got = bars.orderBy("d").collect()
    assert tuple(got[0])[2:] == (5.0, 9.0, 2.0, 2.0, 2.0 + 1) and tuple(got[1])[2:] == (3.0, 3.0, 3.0, 3.0, 1.0)
    write_bars(bars, f"{tmp_path}/csv", ["sym"], "csv")
    assert read_bars(spark, f"{tmp_path}/csv", "csv").count() == 2
    nan = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "Close double, High double, Low double")
    nan.write.parquet(f"{tmp_path}/nan")
    assert tuple(read_bars(spark, f"{tmp_path}/nan").first()) == (None, None, 1.0)
    assert normalize_vendor(spark.createDataFrame([(1.0,)], "`1. open` double")).columns == ["open"]
    assert year_to_date(ticks, "ts").count() == 4


def test_custom_folder(spark, tmp_path):
    from sparktide.custom import create_dir, import_dir, unregister
    from sparktide.ta import TA

    assert "momentum" in create_dir(str(tmp_path))
    (tmp_path / "momentum" / "thrice.py").write_text("def thrice(close, k=3):\n    return {f'T_{k}': close * k}\n")
    assert import_dir(str(tmp_path)) == ["thrice"]
    df = spark.createDataFrame([("a", 1, 2.0)], "sym string, ts int, close double")
    assert TA(df, "sym").call("thrice").first()["T_3"] == 6.0
    unregister("thrice")
    (tmp_path / "momentum" / "bad.py").write_text("x = 1\n")
    with pytest.raises(ImportError):
        import_dir(str(tmp_path))


def test_as_of_takes_the_last_value_before(spark):
    from sparktide.operators.tables import as_of

    left = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("b", 5, 12)], "k string, t int, v int")
    right = spark.createDataFrame([("a", 2, 1.5), ("a", 5, 2.5), ("a", 9, 3.5)], "k string, t int, x double")
    assert sorted(map(tuple, as_of(left, right, ["k"], "t", ["x"]).collect()), key=str) == [("a", 1, 10, None), ("a", 5, 11, 2.5), ("b", 5, 12, None)]


def test_profile_by_price(spark):
    from sparktide.operators.tables import volume_profile

    pdf = pd.DataFrame({"k": "a", "t": range(100), "close": [float(i % 10) for i in range(100)], "volume": 1.0})
    got = volume_profile(spark.createDataFrame(pdf), ["k"], "t", width=5, sort_close=True).orderBy("bucket").collect()
    assert [r["total_volume"] for r in got] == [20.0] * 5 and got[0]["low_close"] == 0.0 and got[-1]["high_close"] == 9.0


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 300 and set(o) <= set(q); print(len(q), len(o))"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
