"""Averages and price overlays."""

from __future__ import annotations

import math

from ..plans.expr import E, coalesce, cum, fn, lag, recursive, roll, row, rows, sqrt, when
from ..plans.registry import op
from . import common as c

CAT = "overlap"


@op(CAT)
def alma(close: E, length=10, sigma=6.0, distribution_offset=0.85):
    m, s = distribution_offset * (length - 1), length / sigma
    w = [math.exp(-((k - m) ** 2) / (2 * s * s)) for k in range(length)]
    return {f"ALMA_{length}_{sigma}_{distribution_offset}": c.weighted(close, w[::-1])}


@op(CAT)
def avgprice(open_, high, low, close):
    return {"AVGPRICE": c.ohlc4(open_, high, low, close)}


@op(CAT)
def dema(close, length=10):
    return {f"DEMA_{length}": c.dema(close, length)}


@op(CAT)
def ema(close, length=10, sma=True):
    return {f"EMA_{length}": c.ema(close, length, sma)}


@op(CAT)
def fwma(close, length=10):
    return {f"FWMA_{length}": c.weighted(close, c.fibonacci(length))}


@op(CAT)
def hilo(high, low, close, high_length=13, low_length=21, mamode="sma"):
    both = (close, c.ma(mamode, high, high_length), c.ma(mamode, low, low_length))
    tail = f"_{high_length}_{low_length}"
    return {n + tail: recursive("hilo", both, k) for k, n in enumerate(("HILO", "HILOl", "HILOs"))}


@op(CAT)
def hl2(high, low):
    return {"HL2": c.hl2(high, low)}


@op(CAT)
def hlc3(high, low, close):
    return {"HLC3": c.hlc3(high, low, close)}


@op(CAT)
def hma(close, length=10):
    return {f"HMA_{length}": c.hma(close, length)}


@op(CAT)
def ht_trendline(close):
    return {"HT_TRENDLINE": recursive("hilbert", (close,), 6, start=37)}


@op(CAT)
def hwma(close, na=0.2, nb=0.1, nc=0.1):
    return {f"HWMA_{na}_{nb}_{nc}": recursive("holt_winters", (close,), na=na, nb=nb, nc=nc)}


@op(CAT)
def ichimoku(high, low, close, tenkan=9, kijun=26, senkou=52, include_chikou=True, lookahead=True):
    mid = lambda n: (roll("max", high, n) + roll("min", low, n)) / 2
    t, k = mid(tenkan), mid(kijun)
    out = {f"ISA_{tenkan}": lag((t + k) / 2, kijun), f"ISB_{kijun}": lag(mid(senkou), kijun), f"ITS_{tenkan}": t, f"IKS_{kijun}": k}
    return out | ({f"ICS_{kijun}": lag(close, -kijun)} if include_chikou and lookahead else {})


@op(CAT)
def jma(close, length=7, phase=0):
    return {f"JMA_{length}_{phase}": recursive("jurik", (close,), n=length, phase=float(phase))}


@op(CAT)
def kama(close, length=10, fast=2, slow=30, drift=1):
    er = abs(close.diff(length)) / roll("sum", abs(close.diff(drift)), length)
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    k = coalesce(er, 0) * (f - s) + s
    sc = k * k
    from ..plans.expr import linear

    return {f"KAMA_{length}_{fast}_{slow}": linear(1 - sc, sc * close, when(row().eq(length), close))}


@op(CAT)
def linreg(close, length=14, slope=False, intercept=False, angle=False, r=False, tsf=False, degrees=True):
    n = length
    if slope:
        return {f"LRm_{n}": c.slope(close, n)}
    if intercept:
        return {f"LRb_{n}": c.linreg(close, n, 0)}
    if angle:
        a = fn("atan", c.slope(close, n))
        return {f"LRa_{n}": fn("degrees", a) if degrees else a}
    if r:
        return {f"LRr_{n}": c.regression_r(close, n)}
    return {f"LR_{n}": c.linreg(close, n, n if tsf else None)}


@op(CAT)
def linregangle(close, length=14):
    return linreg(close, length, angle=True)


@op(CAT)
def linregintercept(close, length=14):
    return linreg(close, length, intercept=True)


@op(CAT)
def linregslope(close, length=14):
    return linreg(close, length, slope=True)


@op(CAT)
def ma(close, name="ema", length=10):
    return {f"{c.label(name)}_{length}": c.ma(name, close, length)}


@op(CAT)
def mama(close, fastlimit=0.5, slowlimit=0.05):
    return {f"{n}_{fastlimit}_{slowlimit}": recursive("mesa_adaptive", (close,), k, fast=fastlimit, slow=slowlimit) for k, n in enumerate(("MAMA", "FAMA"))}


@op(CAT)
def mavp(close, periods: E | None = None, minperiod=2, maxperiod=30):
    """Without periods they run evenly from the least to the largest over the key's rows."""
    if periods is None:
        periods = minperiod + (row() - 1) * (maxperiod - minperiod) / when(rows() > 1, rows() - 1, 1)
    p = fn("floor", when(periods < minperiod, minperiod, when(periods > maxperiod, maxperiod, periods)) + 1e-9)
    out = None
    for n in range(maxperiod, minperiod - 1, -1):
        out = when(p.eq(n), c.sma(close, n), out)
    return {f"MAVP_{minperiod}_{maxperiod}": when(row() >= maxperiod, out)}


@op(CAT)
def mcgd(close, length=10, c=1.0):
    return {f"MCGD_{length}": recursive("mcginley", (close,), n=float(length), c=float(c))}


@op(CAT)
def medprice(high, low):
    return {"MEDPRICE": c.hl2(high, low)}


@op(CAT)
def midpoint(close, length=2):
    return {f"MIDPOINT_{length}": c.midpoint(close, length)}


@op(CAT)
def midprice(high, low, length=2):
    return {f"MIDPRICE_{length}": (roll("max", high, length) + roll("min", low, length)) / 2}


@op(CAT)
def mmar(close, length=10, num_ribbons=6, step=5):
    return {f"MMAR_{length + k * step}": c.ema(close, length + k * step) for k in range(num_ribbons)}


@op(CAT)
def ohlc4(open_, high, low, close):
    return {"OHLC4": c.ohlc4(open_, high, low, close)}


@op(CAT)
def pwma(close, length=10):
    return {f"PWMA_{length}": c.weighted(close, c.pascal(length))}


@op(CAT)
def rainbow(close, length=2, num_ribbons=10):
    """Nested averages, each as one weighted window."""
    out, w = {}, [1.0]
    for k in range(1, num_ribbons + 1):
        w = [sum(w[i - j] for j in range(length) if 0 <= i - j < len(w)) / length for i in range(len(w) + length - 1)]
        out[f"RAINBOW_{k}"] = c.wsum(close, w)
    return out


@op(CAT)
def rma(close, length=10):
    return {f"RMA_{length}": c.rma(close, length)}


@op(CAT)
def sinwma(close, length=14):
    return {f"SINWMA_{length}": c.sinwma(close, length)}


@op(CAT)
def sma(close, length=10, min_periods=None):
    return {f"SMA_{length}": roll("avg", close, length, least=min_periods)}


@op(CAT)
def ssf(close, length=10, poles=2):
    return {f"SSF_{length}_{poles}": recursive("super_smoother", (close,), n=length, poles=poles)}


@op(CAT)
def supertrend(high, low, close, length=7, multiplier=3.0):
    both = (c.hl2(high, low), multiplier * c.atr(high, low, close, length), close)
    return {f"{n}_{length}_{multiplier}": recursive("supertrend", both, k) for k, n in enumerate(("SUPERT", "SUPERTd", "SUPERTl", "SUPERTs"))}


@op(CAT)
def swma(close, length=10):
    return {f"SWMA_{length}": c.weighted(close, c.triangle(length))}


@op(CAT)
def t3(close, length=10, a=0.7):
    return {f"T3_{length}_{a}": c.t3(close, length, a)}


@op(CAT)
def tema(close, length=10):
    return {f"TEMA_{length}": c.tema(close, length)}


@op(CAT)
def trima(close, length=10):
    return {f"TRIMA_{length}": c.trima(close, length)}


@op(CAT)
def tsf(close, length=14):
    return {f"TSF_{length}": c.linreg(close, length, length)}


@op(CAT)
def typprice(high, low, close):
    return {"TYPPRICE": c.hlc3(high, low, close)}


@op(CAT)
def vidya(close, length=14, drift=1):
    return {f"VIDYA_{length}": c.vidya(close, length, drift)}


@op(CAT)
def vwap(high, low, close, volume, ts: E, anchor="D"):
    """Reset each day (D), week (W) or month (M) of ``ts``."""
    part = fn({"D": "day", "W": "week", "M": "month"}[anchor.upper()[0]], ts)
    return {f"VWAP_{anchor}": cum("sum", c.hlc3(high, low, close) * volume, part) / cum("sum", volume, part)}


@op(CAT)
def vwma(close, volume, length=10):
    return {f"VWMA_{length}": c.sma(close * volume, length) / c.sma(volume, length)}


@op(CAT)
def wcp(high, low, close):
    return {"WCP": (high + low + 2 * close) / 4}


@op(CAT)
def wma(close, length=10):
    return {f"WMA_{length}": c.wma(close, length)}


@op(CAT)
def zlma(close, length=10, mamode="ema"):
    return {f"ZL_{c.label(mamode)}_{length}": c.zlma(close, length, mamode)}


_ = sqrt
