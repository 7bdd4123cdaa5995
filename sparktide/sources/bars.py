"""Bar tables: open, high, low, close and volume per key and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A bar table from files, with lower-case names and NaN as null."""
    reader = spark.read.format(format).options(**({"header": "true", "inferSchema": "true"} if format == "csv" and schema is None else {}), **options)
    df = (reader.schema(schema) if schema else reader).load(path)
    df = df.select(*(F.col(f"`{c}`").alias(c.lower()) for c in df.columns))
    return clean(df)


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in all float columns."""
    bad = lambda c: F.isnan(c) | F.abs(F.col(c)).eqNullSafe(float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def normalize_vendor(df: DataFrame) -> DataFrame:
    """Names like ``1. open`` become ``open``."""
    return df.select(*(F.col(f"`{c}`").alias(c.split(". ", 1)[-1].strip().lower().replace(" ", "_")) for c in df.columns))


def to_bars(df: DataFrame, by: list[str], period: Column, price: str, volume: Column, order: list[str], name: str = "ts") -> DataFrame:
    """Bars from ticks: one aggregate, map-side combined. ``order`` tells the
    first and the last tick of a period and must be unique in it."""
    at = F.struct(*order)
    return df.groupBy(*by, period.alias(name)).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), volume.cast("double").alias("volume"),
    )


def resample(bars: DataFrame, by: list[str], ts: str, period: Column) -> DataFrame:
    """Longer bars from shorter ones."""
    return bars.groupBy(*by, period.alias(ts)).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"),
    )


def write_bars(bars: DataFrame, path: str, by: list[str], format: str = "parquet", mode: str = "error", ts: str = "ts") -> None:
    """Bars as files, a key's rows together and, where there is a column ``ts``, in its order."""
    order = [*by, *([ts] if ts in bars.columns else [])]
    bars.repartition(*by).sortWithinPartitions(*order).write.format(format).mode(mode).options(**({"header": "true"} if format == "csv" else {})).save(path)


def year_to_date(df: DataFrame, ts: str) -> DataFrame:
    """Rows of the current year, or all if there are none."""
    own = df.where(F.col(ts) >= F.date_trunc("year", F.current_timestamp()))
    return own if own.take(1) else df


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sym, d`` and bars of extended prices by return flag and ship day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_returnflag", "sym")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return to_bars(lines, ["sym"], F.to_date("l_shipdate"), "l_extendedprice", F.sum("l_quantity"), order, "d")


_ORDER = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
LINEITEM_DAILY_SQL = f"""SELECT l_returnflag AS sym, CAST(l_shipdate AS DATE) AS d, arg_min(l_extendedprice, {_ORDER}) AS open, max(l_extendedprice) AS high,
 min(l_extendedprice) AS low, arg_max(l_extendedprice, {_ORDER}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2"""


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sym, d`` and bars of values by event type and hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "sym")
    return to_bars(events, ["sym"], F.date_trunc("hour", "ts"), "value", F.count("*"), ["ts", "event_id"], "d")


EVENTS_HOURLY_SQL = """SELECT event_type AS sym, date_trunc('hour', ts) AS d, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"""
