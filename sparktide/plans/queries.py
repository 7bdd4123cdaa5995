"""Every indicator as a query over daily bars, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import EVENTS_HOURLY_SQL, LINEITEM_DAILY_SQL, events_hourly, lineitem_daily
from ..ta import TA
from .expr import Unexpressed, Writer, col, roll, when
from .registry import OPS

KEEP = ("sym", "d")
DIGITS = 6
HALF = 0.500123
#: Decimals of results so large that doubles hold fewer.
FEWER = {"mult": 0, "emv": 0, "eom": -6, "pvt": 2, "variance": 2, "vfi": 2, "marketfi": 4, "ad": 3, "adosc": 3, "efi": 3, "kvo": 3, "stc": 3}
#: Inputs that are no bar columns.
INPUTS = {
    "beta": {"benchmark": "open"}, "correl": {"benchmark": "open"}, **{k: {"series_a": "high", "series_b": "low"} for k in ("add", "sub", "mult", "div")},
    "long_run": {"fast": "high", "slow": "low"}, "short_run": {"fast": "high", "slow": "low"}, "tsignals": {"trend": when(col("close") > col("open"), 1, 0)},
    "xsignals": {"signal": "close", "xa": 40000.0, "xb": 30000.0}, "acos": {"close": col("low") / col("high")}, "asin": {"close": col("low") / col("high")},
    "mcgd": {"close": roll("avg", col("high"), 30)},  # daily closes jump so far that this average overflows
    **{k: {"close": col("close") / 10000} for k in ("exp", "sinh", "cosh", "tan", "tanh")},
}


def shown(x: Column, digits: int) -> Column:
    """Rounded by plain arithmetic, which any engine does alike; the limit is a
    little off one half, where many results lie exactly."""
    scale = 10.0**digits
    return F.floor(x.cast("double") * scale + HALF).cast("double") / scale


def shown_sql(x: str, digits: int) -> str:
    scale = f"CAST({10.0**digits!r} AS DOUBLE)"
    return f"CAST(floor(CAST({x} AS DOUBLE) * {scale} + {HALF}) AS DOUBLE) / {scale}"


def _run(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = TA(lineitem_daily(spark, sf_dir), "sym", "d").call(kind, **INPUTS.get(kind, {}))
        values = [shown(F.col(f"`{c}`"), FEWER.get(kind, DIGITS)).alias(c) for c in out.columns if c not in KEEP]
        return out.select(*KEEP, *values)

    return query


class _Names:
    """Stands for a bar table where only names matter."""

    columns = ["sym", "d", "open", "high", "low", "close", "volume"]


def oracle(kind: str) -> str | None:
    ta = TA(_Names(), "sym", "d")  # type: ignore[arg-type]
    try:
        return Writer(LINEITEM_DAILY_SQL, ["sym"], ["d"]).sql(ta.outputs(kind, **INPUTS.get(kind, {})), list(KEEP), lambda x: shown_sql(x, FEWER.get(kind, DIGITS)))
    except Unexpressed:
        return None


def indicator_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name, op in OPS.items() if op.category != "math aliases"}


def indicator_sql() -> dict[str, str]:
    return {name: sql for name, op in OPS.items() if op.category != "math aliases" and (sql := oracle(name))}


# --- signals, tables and metrics ---


def _expressions() -> dict[str, dict]:
    from ..functions import common as c
    from ..operators import signals as s

    close, open_ = col("close"), col("open")
    fast, slow = c.sma(close, 5), c.sma(close, 20)
    rsi = c.rma(c.positive(close.diff()), 14)
    from ..ta import finished

    ta = TA(_Names(), "sym", "d")  # type: ignore[arg-type]
    return {
        "above": s.above(close, open_, ("close", "open")), "below": s.below(close, open_, ("close", "open")), "above_value": s.above_value(close, 30000.5, "close"), "below_value": s.below_value(close, 30000.5, "close"),
        "cross": s.cross(fast, slow, True, ("sma5", "sma20")) | s.cross(fast, slow, False, ("sma5", "sma20")), "cross_value": s.cross_value(close, 30000.0, True, "close"), "crossover": {"CROSSOVER": s.cross(fast, slow)["a_XA_b"]},
        "signals": s.signals(rsi, "rma", 5000.0, 1000.0, True, fast, "sma5", True), "candle_color": {"color": s.candle_color(open_, close)},
        "offset_and_fill": finished({"SMA_5": fast}, offset=2, fillna=0.0, prefix="a") | finished({"SMA_20": slow}, fill_method="bfill", suffix="b") | finished({"MOM_3": close.diff(3)}, offset=-2, fill_method="ffill", col_names="momentum"),
        **{f"{kind}_signals": ta.outputs(kind, signal_indicators=True, xserie="open") for kind in ("rsi", "macd", "er", "rsx")},
        "increasing_strict": OPS["increasing"].build(close, length=2, strict=True), "ppo_ema": OPS["ppo"].build(close, mamode="ema"), "bbands_dema": OPS["bbands"].build(close, length=10, mamode="dema"),
        "squeeze_lazybear": OPS["squeeze"].build(col("high"), col("low"), close, lazybear=True, detailed=True), "macd_asmode": OPS["macd"].build(close, asmode=True), "cpr_camarilla": OPS["cpr"].build(open_, col("high"), col("low"), close, method="camarilla", virgin_cpr=True),
        "cpr_fibonacci": OPS["cpr"].build(open_, col("high"), col("low"), close, method="fibonacci"), "cpr_woodie": OPS["cpr"].build(open_, col("high"), col("low"), close, method="woodie"), "vwap_month": OPS["vwap"].build(col("high"), col("low"), close, col("volume"), col("d"), anchor="M"),
    }


def _expressed(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ta = TA(lineitem_daily(spark, sf_dir), "sym", "d")
        out = ta._planned(_expressions()[name], KEEP)
        return out.select(*KEEP, *(shown(F.col(f"`{c}`"), DIGITS).alias(c) for c in out.columns if c not in KEEP))

    return query


def _rounded(df: DataFrame, keys: tuple[str, ...], digits: int = DIGITS) -> DataFrame:
    return df.select(*keys, *(shown(F.col(f"`{c}`"), digits).alias(c) for c in df.columns if c not in keys))


def _tables() -> dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...], int, str | None]]:
    """Query, its key columns, decimals and SQL over the view ``bars``."""
    from ..operators import metrics as m
    from ..operators import tables as t
    from ..sources.bars import resample

    week = lambda: F.date_trunc("week", F.col("d")).cast("date")  # noqa: E731  # columns need a session
    by, order = ["sym"], "OVER (PARTITION BY sym ORDER BY d)"
    weekly = "SELECT sym, CAST(date_trunc('week', d) AS DATE) AS d, arg_min(open, d) AS open, max(high) AS high, min(low) AS low, arg_max(close, d) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2"
    change = f"SELECT sym, d, close / lag(close) {order} - 1 AS r, open / lag(open) {order} - 1 AS b FROM bars"
    prev = f"SELECT sym, d AS p, lag(open) {order} AS po, lag(high) {order} AS ph, lag(low) {order} AS pl, lag(close) {order} AS pc, lag(volume) {order} AS pv FROM ({weekly})"

    def returns(df: DataFrame) -> DataFrame:
        from ..plans.expr import lag as back

        return TA(df, "sym", "d")._planned({"r": col("close") / back(col("close")) - 1, "b": col("open") / back(col("open")) - 1}, KEEP)

    perf = f"""WITH s AS (SELECT sym, d, close AS x, max(close) OVER (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING) AS top, close / lag(close) {order} - 1 AS r, d > max(d) OVER (PARTITION BY sym) - INTERVAL 1095 DAY - INTERVAL 18 HOUR AS recent FROM bars),
t AS (SELECT sym, d, x, max(x) OVER (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING) AS top FROM s WHERE recent),
u AS (SELECT sym, (pow(arg_max(x, d) / arg_min(x, d), 252.0::DOUBLE / date_diff('day', min(d), max(d))) - 1) / max(1 - x / top) AS calmar FROM t GROUP BY sym),
a AS (SELECT sym, arg_min(x, d) AS f, arg_max(x, d) AS l, date_diff('day', min(d), max(d)) / 252.0::DOUBLE AS years, max(top - x) AS dd, max(1 - x / top) AS ddp, max(ln(top) - ln(x)) AS ddl,
 avg(r) AS mean, stddev_samp(r) AS sd, sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS down, count(*) AS m FROM s GROUP BY sym),
c AS (SELECT *, pow(l / f, 1 / years) - 1 AS cagr, sqrt(down / (m - 1) * (m / years)) AS downside FROM a)
SELECT sym, cagr, dd AS max_drawdown, ddp AS max_drawdown_pct, ddl AS max_drawdown_log, ln(l / f) - ddl AS log_max_drawdown, calmar AS calmar_ratio, downside AS downside_deviation,
 252 * mean / (sqrt(252.0::DOUBLE) * sd) AS sharpe_ratio, cagr / downside AS sortino_ratio, sqrt(m / years) * sd AS volatility, 252 * mean / (252 * sd * sd) AS optimal_leverage, 0.0::DOUBLE AS pure_profit_score FROM c JOIN u USING (sym)"""
    return {
        "performance_metrics": (lambda df: m.performance(df, by, "d"), ("sym",), 4, perf),
        "jensens_alpha": (lambda df: m.jensens_alpha(returns(df), by, "r", "b"), ("sym",), 6, f"SELECT sym, regr_intercept(r, b) AS jensens_alpha FROM ({change}) GROUP BY sym"),
        "linear_regression": (lambda df: m.linear_regression(df, by, "open", "close"), ("sym",), 4, "SELECT sym, a, b, r, r / sqrt((1 - r * r) / (n - 2)) AS t FROM (SELECT sym, regr_intercept(close, open) AS a, regr_slope(close, open) AS b, corr(open, close) AS r, count(*) AS n FROM bars GROUP BY sym)"),
        "vp": (lambda df: t.volume_profile(df, by, "d"), ("sym", "bucket"), 4, f"SELECT sym, bucket, min(close) AS low_close, avg(close) AS mean_close, max(close) AS high_close, sum(CASE WHEN c > 0 THEN volume ELSE 0 END) AS pos_volume, sum(CASE WHEN c < 0 THEN volume ELSE 0 END) AS neg_volume, sum(volume) AS total_volume FROM (SELECT *, ntile(10) {order} AS bucket, close - lag(close) {order} AS c FROM bars) GROUP BY 1, 2"),
        "tos_stdevall": (lambda df: t.stdev_all(df, by, "d"), KEEP, 1, f"""WITH x AS (SELECT sym, d, close, row_number() {order} - 1 AS x FROM bars), g AS (SELECT sym, regr_intercept(close, x) AS a, regr_slope(close, x) AS b, stddev_samp(close) AS s FROM x GROUP BY sym)
SELECT sym, d, a + b * x AS "TOS_STDEVALL_LR", {", ".join(f'a + b * x - {k} * s AS "TOS_STDEVALL_L_{k}", a + b * x + {k} * s AS "TOS_STDEVALL_U_{k}"' for k in (1, 2, 3))} FROM x JOIN g USING (sym)"""),
        "resample_weekly": (lambda df: resample(df, by, "d", week()), KEEP, 4, weekly),
        "previous_period": (lambda df: t.previous_period(df, by, "d", "week").select("sym", "d", "prev_open", "prev_high", "prev_low", "prev_close", "prev_volume"), KEEP, 4, f"SELECT sym, d, po AS prev_open, ph AS prev_high, pl AS prev_low, pc AS prev_close, pv AS prev_volume FROM bars LEFT JOIN (SELECT sym AS psym, * EXCLUDE (sym) FROM ({prev})) ON psym = sym AND p = date_trunc('week', d)"),
        "cpr_weekly": (lambda df: t.pivots(df, by, "d", "classic", "week").select("sym", "d", "CPR_TC", "CPR_PIVOT", "CPR_BC", "CPR_R1", "CPR_S1"), KEEP, 4, f'SELECT sym, d, 2 * (ph + pl + pc) / 3 - (ph + pl) / 2 AS "CPR_TC", (ph + pl + pc) / 3 AS "CPR_PIVOT", (ph + pl) / 2 AS "CPR_BC", 2 * (ph + pl + pc) / 3 - pl AS "CPR_R1", 2 * (ph + pl + pc) / 3 - ph AS "CPR_S1" FROM bars LEFT JOIN (SELECT sym AS psym, * EXCLUDE (sym) FROM ({prev})) ON psym = sym AND p = date_trunc(\'week\', d)'),
        "as_of_join": (lambda df: t.as_of(df.select("sym", "d", "close"), df.where(F.dayofweek("d") == 2).select("sym", "d", F.col("close").alias("monday_close")), by, "d", ["monday_close"]), KEEP, 4, "SELECT a.sym, a.d, a.close, b.monday_close FROM bars a ASOF LEFT JOIN (SELECT sym, d, close AS monday_close FROM bars WHERE dayofweek(d) = 1) b ON a.sym = b.sym AND a.d >= b.d"),
        "frame_correlation": (lambda df: t.correlation(df, by, "open", "close"), ("sym",), 6, "SELECT sym, corr(open, close) AS corr FROM bars GROUP BY sym"),
        "total_time": (lambda df: t.total_time(df, by, "d"), ("sym",), 6, "SELECT sym, n / 252 AS years, n / 30.417::DOUBLE AS months, n / 7 AS weeks, n AS days, n * 24 AS hours, n * 1440 AS minutes, n * 86400 AS seconds FROM (SELECT sym, CAST(date_diff('day', min(d), max(d)) AS DOUBLE) AS n FROM bars GROUP BY sym)"),
        "ichimoku_span": (lambda df: t.ichimoku_span(df, by, "d"), KEEP, 4, None),
    }


def _table(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        run, keys, digits, _ = _tables()[name]
        return _rounded(run(lineitem_daily(spark, sf_dir)), keys, digits)

    return query


def table_sql() -> dict[str, str]:
    out = {}
    for name, (_, keys, digits, sql) in _tables().items():
        if sql:
            inner = f"WITH bars AS MATERIALIZED ({LINEITEM_DAILY_SQL}) SELECT * FROM ({sql})"
            out[name] = f"SELECT {', '.join(keys)}, {shown_sql('COLUMNS(* EXCLUDE (' + ', '.join(keys) + '))', digits)} FROM ({inner})"
    return out


#: Bars, their SQL and the longer period before which is told at each bar.
PERIODS_BEFORE = {"month": (lineitem_daily, LINEITEM_DAILY_SQL), "quarter": (lineitem_daily, LINEITEM_DAILY_SQL), "day": (events_hourly, EVENTS_HOURLY_SQL)}
BEFORE = {"prev_open": "po", "prev_high": "ph", "prev_low": "pl", "prev_close": "pc", "prev_volume": "pv"}
LEVELS = {"CPR_TC": "2 * (ph + pl + pc) / 3 - (ph + pl) / 2", "CPR_PIVOT": "(ph + pl + pc) / 3", "CPR_BC": "(ph + pl) / 2", "CPR_R1": "2 * (ph + pl + pc) / 3 - pl", "CPR_S1": "2 * (ph + pl + pc) / 3 - ph"}


def _before(unit: str, pivots: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators import tables as t

        bars = PERIODS_BEFORE[unit][0](spark, sf_dir)
        out = t.pivots(bars, ["sym"], "d", "classic", unit) if pivots else t.previous_period(bars, ["sym"], "d", unit)
        out = _rounded(out.select(*KEEP, *(LEVELS if pivots else BEFORE)), KEEP, 4)
        return out.withColumn("d", F.date_format("d", "yyyy-MM-dd HH:mm:ss"))

    return query


def _before_sql(unit: str, pivots: bool) -> str:
    shown_ = ", ".join(f'{shown_sql(x, 4)} AS "{name}"' for name, x in (LEVELS if pivots else BEFORE).items())
    return f"""WITH bars AS MATERIALIZED ({PERIODS_BEFORE[unit][1]}),
long AS (SELECT sym, date_trunc('{unit}', d) AS p, arg_min(open, d) AS o, max(high) AS h, min(low) AS l, arg_max(close, d) AS c, sum(volume) AS v FROM bars GROUP BY 1, 2),
prev AS (SELECT sym AS psym, p, lag(o) OVER w AS po, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lag(c) OVER w AS pc, lag(v) OVER w AS pv FROM long WINDOW w AS (PARTITION BY sym ORDER BY p))
SELECT sym, strftime(d, '%Y-%m-%d %H:%M:%S') AS d, {shown_} FROM bars LEFT JOIN prev ON psym = sym AND p = date_trunc('{unit}', d)"""


def before_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"{name}_{unit}": _before(unit, pivots) for unit in PERIODS_BEFORE for name, pivots in (("previous_period", False), ("cpr_before", True))}


def before_sql() -> dict[str, str]:
    return {f"{name}_{unit}": _before_sql(unit, pivots) for unit in PERIODS_BEFORE for name, pivots in (("previous_period", False), ("cpr_before", True))}


def _strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..ta import COMMON_STRATEGY

    out = TA(lineitem_daily(spark, sf_dir), "sym", "d").strategy(COMMON_STRATEGY).frame
    return _rounded(out.drop("open", "high", "low", "close", "volume"), KEEP)


def _strategy_sql() -> str:
    from ..ta import COMMON_STRATEGY

    ta, outputs = TA(_Names(), "sym", "d"), {}  # type: ignore[arg-type]
    for call in COMMON_STRATEGY.ta:
        outputs |= ta.outputs(**call)
    return Writer(LINEITEM_DAILY_SQL, ["sym"], ["d"]).sql(outputs, list(KEEP), lambda x: shown_sql(x, DIGITS))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return indicator_queries() | {n: _expressed(n) for n in _expressions()} | {n: _table(n) for n in _tables()} | before_queries() | {"strategy_common": _strategy}


def all_sql() -> dict[str, str]:
    own = {n: Writer(LINEITEM_DAILY_SQL, ["sym"], ["d"]).sql(e, list(KEEP), lambda x: shown_sql(x, DIGITS)) for n, e in _expressions().items()}
    return indicator_sql() | own | table_sql() | before_sql() | {"strategy_common": _strategy_sql()}
