"""Operators that change the rows: profiles, whole-series bands, periods, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.expr import E, col
from ..plans.registry import OPS  # noqa: F401
from ..sources.bars import resample


def volume_profile(df: DataFrame, by: list[str], ts: str, close: str = "close", volume: str = "volume", width: int = 10, sort_close: bool = False) -> DataFrame:
    """Price range and volume of ``width`` buckets of each key: chunks of about
    equal row counts in time order, or with ``sort_close`` equal price ranges.
    Volume is positive where the price rose, negative where it fell."""
    w = Window.partitionBy(*by).orderBy(ts)
    rose = F.col(close) - F.lag(close).over(w)
    base = df.select(*by, F.col(ts), F.col(close).alias("_x"), F.col(volume).alias("_v"), rose.alias("_d"))
    if sort_close:
        whole = Window.partitionBy(*by)
        lo, hi = F.min("_x").over(whole), F.max("_x").over(whole)
        place = F.least(F.floor(F.try_divide((F.col("_x") - lo) * width, hi - lo)), F.lit(width - 1))
        base = base.withColumn("bucket", F.coalesce(place, F.lit(0)).cast("long") + 1)
    else:
        base = base.withColumn("bucket", F.ntile(width).over(Window.partitionBy(*by).orderBy(ts)).cast("long"))
    return base.groupBy(*by, "bucket").agg(
        F.min("_x").alias("low_close"), F.avg("_x").alias("mean_close"), F.max("_x").alias("high_close"),
        F.sum(F.when(F.col("_d") > 0, F.col("_v")).otherwise(0.0)).alias("pos_volume"), F.sum(F.when(F.col("_d") < 0, F.col("_v")).otherwise(0.0)).alias("neg_volume"), F.sum("_v").alias("total_volume"),
    )


def stdev_all(df: DataFrame, by: list[str], ts: str, close: str = "close", length: int | None = None, stds: tuple = (1, 2, 3), ddof: int = 1) -> DataFrame:
    """Least-squares line of a key's whole series (or its last rows) and bands
    of standard deviations around it."""
    w = Window.partitionBy(*by).orderBy(ts)
    rows = df.withColumn("_x", F.row_number().over(w).cast("double") - 1)
    if length:
        rows = rows.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts)))).where(F.col("_back") <= length).drop("_back")
    whole = Window.partitionBy(*by)
    line = F.regr_intercept(close, "_x").over(whole) + F.regr_slope(close, "_x").over(whole) * F.col("_x")
    sd = (F.stddev_samp if ddof else F.stddev_pop)(close).over(whole)
    name = f"TOS_STDEVALL{f'_{length}' if length else ''}"
    out = rows.withColumns({"_line": line, "_sd": sd})
    bands = [c for k in stds for c in ((F.col("_line") - k * F.col("_sd")).alias(f"{name}_L_{k}"), (F.col("_line") + k * F.col("_sd")).alias(f"{name}_U_{k}"))]
    return out.select(*by, ts, F.col("_line").alias(f"{name}_LR"), *bands)


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, values: list[str]) -> DataFrame:
    """``left`` with the last values of ``right`` at or before each row: one
    union, one exchange on the key, no range join."""
    have = [c for c in left.columns if c not in (*by, ts)]
    a = left.select(*by, ts, F.lit(1).alias("_side"), F.struct(*(have or [ts])).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_new"))
    b = right.select(*by, ts, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_new"))
    w = Window.partitionBy(*by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_new", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*by, ts, *(F.col(f"_row.{c}").alias(c) for c in have), *(F.col(f"_last.{v}").alias(v) for v in values))


def previous_period(bars: DataFrame, by: list[str], ts: str, unit: str = "week", lag: int = 1) -> DataFrame:
    """Each bar with the bar of the calendar period ``lag`` before its own."""
    period = F.date_trunc(unit, F.col(ts))
    long = resample(bars, by, ts, period)
    w = Window.partitionBy(*by).orderBy(ts)
    prev = long.select(*by, F.col(ts).alias("_p"), *(F.lag(c, lag).over(w).alias(f"prev_{c}") for c in ("open", "high", "low", "close", "volume")))
    return bars.withColumn("_p", period).join(prev, [*by, "_p"], "left").drop("_p")


def pivots(bars: DataFrame, by: list[str], ts: str, method: str = "classic", unit: str = "week", lag: int = 1) -> DataFrame:
    """Central pivot range and levels from a longer period before."""
    from ..functions.trend import pivot_levels
    from ..plans.expr import Planner

    prev = previous_period(bars, by, ts, unit, lag)
    levels: dict[str, E] = pivot_levels(method, *(col(f"prev_{c}") for c in ("open", "high", "low", "close")))
    return Planner(prev, by, [ts]).plan(levels, [*by, ts])


def ichimoku_span(bars: DataFrame, by: list[str], ts: str, tenkan: int = 9, kijun: int = 26, senkou: int = 52) -> DataFrame:
    """The forward spans: ``kijun`` business days after each key's last bar."""
    w = Window.partitionBy(*by).orderBy(ts)
    mid = lambda n: (F.max("high").over(w.rowsBetween(1 - n, 0)) + F.min("low").over(w.rowsBetween(1 - n, 0))) / 2
    rows = bars.select(*by, ts, ((mid(tenkan) + mid(kijun)) / 2).alias("a"), mid(senkou).alias("b"), F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts))).alias("back"))
    tail = rows.where(F.col("back") <= kijun).withColumn("k", kijun - F.col("back") + 1)
    last = rows.where("back = 1").select(*by, F.to_date(ts).alias("last"))
    days = last.select(*by, F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", 2 * kijun + 7))).alias("day")).where(F.dayofweek("day").between(2, 6))
    days = days.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("day"))).where(F.col("k") <= kijun)
    return days.join(tail, [*by, "k"], "left").select(*by, F.col("day").alias(ts), F.col("a").alias(f"ISA_{tenkan}"), F.col("b").alias(f"ISB_{kijun}"))


def correlation(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(a, b).alias("corr"))


def total_time(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Span of each key: days, and in years of 252 days, months, weeks, hours."""
    days: Column = F.datediff(F.max(ts), F.min(ts)).cast("double")
    out = df.groupBy(*by).agg(days.alias("days"))
    return out.select(*by, (F.col("days") / 252).alias("years"), (F.col("days") / 30.417).alias("months"), (F.col("days") / 7).alias("weeks"), "days", (F.col("days") * 24).alias("hours"), (F.col("days") * 1440).alias("minutes"), (F.col("days") * 86400).alias("seconds"))
