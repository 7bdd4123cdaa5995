"""Performance of whole series: one row per key, from plain aggregates.

Running maxima take one window; everything else is one aggregate per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIODS = 252
DAY = 86400.0
#: Seconds of a unit of time; a year is one of 252 days. Units of a day and more count whole days.
SPANS = {"years": 252 * DAY, "months": 30.417 * DAY, "weeks": 7 * DAY, "days": DAY, "hours": DAY / 24, "minutes": 60.0, "seconds": 1.0}
METHODS = {"dollar": "dd", "percent": "dd_pct", "log": "dd_log"}


def _guard(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def _drawdowns(top: str) -> list[Column]:
    return [F.max(F.col(top) - F.col("_x")), F.max(1 - F.try_divide(F.col("_x"), F.col(top))), F.max(F.ln(top) - F.ln("_x"))]


def _growth(first: str, last: str, seconds: str) -> Column:
    """Growth a year from first to last value."""
    years = F.floor(F.col(seconds) / DAY) * DAY / SPANS["years"]
    return _guard(F.when(years > 0, F.pow(F.try_divide(F.col(last), F.col(first)), F.try_divide(F.lit(1.0), years)) - 1))


def _per_unit(rows: Column, seconds: Column, unit: str) -> Column:
    """Rows in a unit of time."""
    span = seconds if unit in ("minutes", "seconds") else F.floor(seconds / DAY) * DAY
    return F.try_divide(rows.cast("double"), span / SPANS.get(unit, SPANS["years"]))


def performance(
    df: DataFrame, by: list[str], ts: str, close: str = "close", benchmark_rate: float = 0.0, capital: float = 1.0, period: float = PERIODS,
    log: bool = False, use_cagr: bool = False, tf: str = "years", years: float = 3, method: str = "percent", nearest_day: bool = False,
) -> DataFrame:
    """All metrics of each key.

    Columns: cagr, max_drawdown (and _pct, _log), log_max_drawdown, calmar_ratio (of the
    last ``years``, drawdown by ``method``), downside_deviation (``benchmark_rate`` a year,
    spread over the rows of one ``tf``), sharpe_ratio (``use_cagr``: growth over volatility),
    sortino_ratio (downside against 0), volatility (a ``tf``), optimal_leverage,
    pure_profit_score. ``log``: of log returns. Every row counts, that without a return
    too. Nulls are skipped; a metric without enough rows, or without spread, is null. All
    windows and the aggregate share one exchange by key.
    """
    key, ahead = Window.partitionBy(*by), Window.unboundedPreceding
    s = df.select(*by, F.col(ts).alias("_t"), F.col(close).cast("double").alias("_x"), F.col(ts).cast("timestamp").cast("double").alias("_s"))
    w = key.orderBy("_t")
    s = s.withColumns({"_top": F.max("_x").over(w.rowsBetween(ahead, 0)), "_prev": F.lag("_x").over(w), "_end": F.max("_s").over(key), "_begin": F.min("_s").over(key), "_rows": F.count("*").over(key)})
    s = s.withColumn("_recent", F.col("_s") > F.col("_end") - 365.25 * DAY * years if years > 0 else F.lit(False))
    s = s.withColumn("_tail", F.when(F.col("_recent"), F.max("_x").over(Window.partitionBy(*by, "_recent").orderBy("_t").rowsBetween(ahead, 0))))
    ratio = F.try_divide(F.col("_x"), F.col("_prev"))
    rate = F.pow(F.lit(1.0 + benchmark_rate), F.try_divide(F.lit(1.0), _per_unit(F.col("_rows"), F.col("_end") - F.col("_begin"), tf))) - 1
    s = s.withColumns({"_r": F.ln(ratio) if log else ratio - 1, "_rate": rate})
    below = lambda limit: F.coalesce(F.sum(F.when(F.col("_r") < limit, (limit - F.col("_r")) ** 2)), F.lit(0.0))
    recent = F.when(F.col("_recent"), F.col("_t"))
    dd, tail = _drawdowns("_top"), _drawdowns("_tail")
    a = s.groupBy(*by).agg(
        F.min_by("_x", "_t").alias("first"), F.max_by("_x", "_t").alias("last"), (F.max("_s") - F.min("_s")).alias("seconds"), F.count("*").alias("rows"),
        dd[0].alias("dd"), dd[1].alias("dd_pct"), dd[2].alias("dd_log"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("sd"), below(F.col("_rate")).alias("down"), below(F.lit(0.0)).alias("down_zero"),
        F.min_by("_x", recent).alias("tail_first"), (F.max("_s") - F.min(F.when(F.col("_recent"), F.col("_s")))).alias("tail_seconds"), tail[list(METHODS).index(method)].alias("tail_dd"),
    )
    each = _per_unit(F.col("rows"), F.col("seconds"), tf)
    factor = F.floor(each + 1) if nearest_day and tf == "years" else each
    deviation = lambda down, per: F.sqrt(F.try_divide(F.col(down), (F.col("rows") - 1).cast("double")) * per)
    a = a.withColumns({"cagr": _growth("first", "last", "seconds"), "volatility": F.sqrt(factor) * F.col("sd"), "excess": period * F.col("mean") - benchmark_rate})
    yearly = F.sqrt(_per_unit(F.col("rows"), F.col("seconds"), "years")) * F.col("sd")
    sharpe = F.try_divide(F.col("cagr"), yearly) if use_cagr else F.try_divide(F.col("excess"), math.sqrt(period) * F.col("sd"))
    return a.select(
        *by, "cagr", F.col("dd").alias("max_drawdown"), F.col("dd_pct").alias("max_drawdown_pct"), F.col("dd_log").alias("max_drawdown_log"),
        (F.ln(F.try_divide(F.col("last"), F.col("first"))) - F.col("dd_log")).alias("log_max_drawdown"), F.try_divide(_growth("tail_first", "last", "tail_seconds"), F.col("tail_dd")).alias("calmar_ratio"),
        deviation("down", each).alias("downside_deviation"), sharpe.alias("sharpe_ratio"),
        F.try_divide(F.col("cagr") - benchmark_rate, deviation("down_zero", _per_unit(F.col("rows"), F.col("seconds"), "years"))).alias("sortino_ratio"), "volatility",
        (capital * F.try_divide(F.col("excess"), period * F.col("sd") * F.col("sd"))).alias("optimal_leverage"), F.lit(0.0).alias("pure_profit_score"),
    )


def interpolated(df: DataFrame, by: list[str], ts: str, name: str) -> DataFrame:
    """The table with gaps of a column on the line between their neighbours, row by row;
    nulls at the end get the last value, nulls at the start stay."""
    w = Window.partitionBy(*by).orderBy(ts)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_row", F.row_number().over(w))
    known = F.when(F.col(name).isNotNull(), F.struct(F.col(name).cast("double").alias("v"), F.col("_row").alias("r")))
    df = df.withColumns({"_p": F.last(known, True).over(before), "_n": F.first(known, True).over(after)})
    step = F.coalesce(F.try_divide((F.col("_n.v") - F.col("_p.v")) * (F.col("_row") - F.col("_p.r")), (F.col("_n.r") - F.col("_p.r")).cast("double")), F.lit(0.0))
    return df.withColumn(name, F.coalesce(F.col(name).cast("double"), F.col("_p.v") + step)).drop("_row", "_p", "_n")


def jensens_alpha(df: DataFrame, by: list[str], returns: str, benchmark: str, ts: str | None = None) -> DataFrame:
    """Intercept of the regression of returns on benchmark returns, of rows that have
    both. With an order ``ts`` gaps of the benchmark are interpolated first."""
    df = interpolated(df, by, ts, benchmark) if ts else df
    return df.groupBy(*by).agg(F.regr_intercept(returns, benchmark).alias("jensens_alpha"))


def linear_regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Intercept a, slope b, correlation r and its t value, per key."""
    out = df.groupBy(*by).agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), F.corr(x, y).alias("r"), F.count("*").alias("n"))
    return out.select(*by, "a", "b", "r", F.try_divide(F.col("r"), F.sqrt(F.try_divide(1 - F.col("r") ** 2, (F.col("n") - 2).cast("double")))).alias("t"))
