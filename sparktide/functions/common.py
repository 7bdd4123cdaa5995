"""Building blocks that many indicators share."""

from __future__ import annotations

import math

from ..plans.expr import E, cum, fn, greatest, lag, least, linear, roll, row, sign, sqrt, when, wrap, wsum


def sma(x, n: int) -> E:
    return roll("avg", x, n)


def signed(x, initial=None) -> E:
    """Sign of the step from the row before; ``initial`` on the first row."""
    return when(row().eq(1), initial, sign(wrap(x).diff()))


def ema(x, n: int, seeded: bool = True) -> E:
    """Seeded by the mean of the first n values, or else by the first value."""
    x = wrap(x)
    count = cum("count", x)
    k = 2 / (n + 1)
    first = count.eq(n if seeded else 1) & x.notnull()
    return linear(when(count >= 1, 1 - k), k * x, when(first, cum("sum", x) / count))


def alpha_ema(x, k: float) -> E:
    """Exponential average from the first value on."""
    x = wrap(x)
    return linear(1 - k, k * x, when(cum("count", x).eq(1) & x.notnull(), x))


def rma(x, n: int) -> E:
    """Wilder's average; at row n the mean of the values so far, or without any
    such value the first one after it."""
    x = wrap(x)
    late = (row() > n) & cum("count", x).eq(1) & x.notnull()
    return linear(1 - 1 / n, x / n, when(row().eq(n), linear_mean(x), when(late & (lag(cum("count", x)).eq(0)), x)))


def linear_mean(x) -> E:
    """Running mean of the values so far, nulls skipped."""
    return cum("sum", when(wrap(x).notnull(), x, 0)) / cum("count", x)


def wilder_sum(x, n: int) -> E:
    """Sum of rows 2 to n, then y' - y'/n + x."""
    x = wrap(x)
    return linear(1 - 1 / n, x, when(row().eq(n), roll("sum", when(row() >= 2, x, 0), n)))


def weighted(x, weights) -> E:
    total = sum(weights)
    return wsum(x, [w / total for w in weights])


def wma(x, n: int) -> E:
    return weighted(x, range(1, n + 1))


def fibonacci(n: int) -> list[int]:
    out = [1, 1]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return out[:n]


def pascal(n: int) -> list[int]:
    return [math.comb(n - 1, k) for k in range(n)]


def triangle(n: int) -> list[int]:
    return [min(k, n + 1 - k) for k in range(1, n + 1)]


def hma(x, n: int) -> E:
    return wma(2 * wma(x, n // 2) - wma(x, n), int(math.sqrt(n)))


def dema(x, n: int) -> E:
    e1 = ema(x, n)
    return 2 * e1 - ema(e1, n)


def tema(x, n: int) -> E:
    e1 = ema(x, n)
    e2 = ema(e1, n)
    return 3 * (e1 - e2) + ema(e2, n)


def t3(x, n: int, a: float = 0.7) -> E:
    e = [ema(x, n)]
    for _ in range(5):
        e.append(ema(e[-1], n))
    c1, c2, c3, c4 = -(a**3), 3 * a**2 + 3 * a**3, -6 * a**2 - 3 * a - 3 * a**3, a**3 + 3 * a**2 + 3 * a + 1
    return c1 * e[5] + c2 * e[4] + c3 * e[3] + c4 * e[2]


def trima(x, n: int) -> E:
    half = n // 2 + 1
    return sma(sma(x, half), half)


def vidya(x, n: int, drift: int = 1) -> E:
    x = wrap(x)
    k = 2 / (n + 1) * abs(cmo(x, n, 1, drift))
    return linear(1 - k, k * x, when(row().eq(n), sma(x, n)))


def cmo(x, n: int, scalar: float = 100, drift: int = 1) -> E:
    d = wrap(x).diff(drift)
    up, down = roll("sum", greatest(d, 0 * d), n), roll("sum", greatest(-d, 0 * d), n)
    return scalar * (up - down) / (up + down)


def sinwma(x, n: int) -> E:
    return weighted(x, [math.sin((k + 1) * math.pi / (n + 1)) for k in range(n)])


def zlma(x, n: int, mamode: str = "ema") -> E:
    x = wrap(x)
    return ma(mamode, 2 * x - lag(x, (n - 1) // 2), n)


def midpoint(x, n: int) -> E:
    return (roll("max", x, n) + roll("min", x, n)) / 2


def slope(x, n: int) -> E:
    """Least-squares slope over the last n rows."""
    mean, norm = (n - 1) / 2, n * (n * n - 1) / 12
    return wsum(x, [(k - mean) / norm for k in range(n)])


def linreg(x, n: int, at: float | None = None) -> E:
    """Least-squares line at ``at`` (0: the oldest row, n - 1: this one)."""
    return sma(x, n) + slope(x, n) * ((n - 1 if at is None else at) - (n - 1) / 2)


def regression_r(x, n: int) -> E:
    return slope(x, n) * math.sqrt((n * n - 1) / 12) / roll("stddev_pop", x, n)


#: Moving averages that the dispatcher knows.
AVERAGES = {
    "dema": dema, "ema": ema, "fwma": lambda x, n: weighted(x, fibonacci(n)), "hma": hma, "linreg": linreg, "midpoint": midpoint, "pwma": lambda x, n: weighted(x, pascal(n)), "rma": rma,
    "sinwma": sinwma, "sma": sma, "swma": lambda x, n: weighted(x, triangle(n)), "t3": t3, "tema": tema, "trima": trima, "vidya": vidya, "wma": wma, "zlma": zlma,
}


def ma(mode: str | None, x, n: int) -> E:
    """Moving average by name; an unknown name is ``ema``."""
    return AVERAGES.get(str(mode).lower(), ema)(x, n)


def label(mode: str | None) -> str:
    """Name of the average in output names."""
    return {"zlma": "ZL_EMA", "linreg": "LR", "midpoint": "MIDPOINT"}.get(str(mode).lower(), str(mode).upper() if str(mode).lower() in AVERAGES else "EMA")


def true_range(high: E, low: E, close: E, drift: int = 1) -> E:
    prev = lag(close, drift)
    return when(prev.notnull(), greatest(nonzero_range(high, low), abs(high - prev), abs(prev - low)))


def nonzero_range(a: E, b: E) -> E:
    from ..plans.expr import EPS

    d = a - b
    return when(d.eq(0), EPS, d)


def atr(high: E, low: E, close: E, n: int, mode: str = "rma", drift: int = 1) -> E:
    return ma(mode, true_range(high, low, close, drift), n)


def mad(x, n: int) -> E:
    """Mean absolute deviation from the window's own mean."""
    x, mean = wrap(x), sma(x, n)
    total = abs(x - mean)
    for k in range(1, n):
        total = total + abs(lag(x, k) - mean)
    return total / n


def hl2(high, low):
    return (high + low) / 2


def hlc3(high, low, close):
    return (high + low + close) / 3


def ohlc4(o, h, low, c):
    return (o + h + low + c) / 4


def stdev(x, n: int, ddof: int = 0) -> E:
    return roll("stddev_samp" if ddof else "stddev_pop", x, n)


def flag(cond: E) -> E:
    return when(cond, 1, 0)


def positive(x: E) -> E:
    return when(x > 0, x, when(x.notnull(), 0))


def increasing(x: E, n: int = 1) -> E:
    return flag(x.diff(n) > 0)


def decreasing(x: E, n: int = 1) -> E:
    return flag(x.diff(n) < 0)


__all__ = [n for n in dir() if not n.startswith("_")]
_ = (fn, least, sqrt)
