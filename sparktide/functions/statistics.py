"""Rolling statistics, returns and drawdown, cycles."""

from __future__ import annotations

import math

from ..plans.expr import E, cum, first_value, fn, lag, ln, recursive, roll, row, sqrt, when, wsum
from ..plans.registry import op
from . import common as c
from .common import sma

CAT = "statistics"


def _change(x):
    return x / lag(x) - 1


@op(CAT)
def beta(close, benchmark: E, length=30):
    mine, other = _change(close), _change(benchmark)
    return {f"BETA_{length}": roll("covar_samp", mine, length, other) / roll("var_samp", other, length)}


@op(CAT)
def correl(close, benchmark: E, length=30):
    return {f"CORREL_{length}": roll("corr", close, length, benchmark)}


@op(CAT)
def entropy(close, length=10, base=2.0):
    total = roll("sum", close, length)
    out = None
    for k in range(length):
        p = lag(close, k) / total
        term = -p * ln(p) / math.log(base)
        out = term if out is None else out + term
    return {f"ENTP_{length}": out}


def _moments(x, n, power):
    mean, out = sma(x, n), None
    for k in range(n):
        d = lag(x, k) - mean
        term = d
        for _ in range(power - 1):
            term = term * d
        out = term if out is None else out + term
    return out / n


@op(CAT)
def kurtosis(close, length=30):
    n, v = length, roll("var_pop", close, length)
    g = _moments(close, n, 4) / (v * v) - 3
    return {f"KURT_{length}": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)}


@op(CAT)
def skew(close, length=30):
    n, sd = length, roll("stddev_pop", close, length)
    return {f"SKEW_{length}": _moments(close, n, 3) / (sd * sd * sd) * (math.sqrt(n * (n - 1)) / (n - 2))}


@op(CAT)
def mad(close, length=30):
    return {f"MAD_{length}": c.mad(close, length)}


@op(CAT)
def md(close, length=30):
    return {f"MD_{length}": c.mad(close, length)}


@op(CAT)
def median(close, length=30):
    return {f"MEDIAN_{length}": roll("quantile", close, length, 0.5)}


@op(CAT)
def quantile(close, length=30, q=0.5):
    return {f"QTL_{length}_{q}": roll("quantile", close, length, q)}


@op(CAT)
def stderr(close, length=14, ddof=1):
    return {f"STDERR_{length}": c.stdev(close, length, ddof) / math.sqrt(length)}


@op(CAT)
def stdev(close, length=30, ddof=0):
    return {f"STDEV_{length}": c.stdev(close, length, ddof)}


@op(CAT)
def variance(close, length=30, ddof=0):
    return {f"VAR_{length}": roll("var_samp" if ddof else "var_pop", close, length)}


@op(CAT)
def zscore(close, length=30, std=1):
    return {f"ZS_{length}": (close - sma(close, length)) / (std * c.stdev(close, length, 1))}


@op("performance")
def drawdown(close):
    top = cum("max", close)
    return {"DD": top - close, "DD_PCT": 1 - close / top, "DD_LOG": ln(top) - ln(close)}


@op("performance")
def log_return(close, length=1, cumulative=False):
    base = first_value(close) if cumulative else lag(close, length)
    return {f"{'CUM' if cumulative else ''}LOGRET_{length}": ln(close / base)}


@op("performance")
def percent_return(close, length=1, cumulative=False):
    base = first_value(close) if cumulative else lag(close, length)
    return {f"{'CUM' if cumulative else ''}PCTRET_{length}": close / base - 1}


CYC = "cycles"


@op(CYC)
def dsp(close, length=14):
    return {f"DSP_{length}": close - c.ema(close, length)}


@op(CYC)
def ebsw(close, length=40, bars=10):
    n = length if length >= 39 else 40
    return {f"EBSW_{n}_{bars}": recursive("even_better_sine", (close,), n=n, bars=bars)}


def _hilbert(close, output, start):
    return recursive("hilbert", (close,), output, start=start)


@op(CYC)
def ht_dcperiod(close):
    return {"HT_DCPERIOD": _hilbert(close, 0, 12)}


@op(CYC)
def ht_dcphase(close):
    return {"HT_DCPHASE": _hilbert(close, 1, 37)}


@op(CYC)
def ht_phasor(close):
    return {"HT_PHASOR_INPHASE": _hilbert(close, 2, 12), "HT_PHASOR_QUAD": _hilbert(close, 3, 12)}


@op(CYC)
def ht_sine(close):
    return {"HT_SINE": _hilbert(close, 4, 37), "HT_LEADSINE": _hilbert(close, 5, 37)}


@op(CYC)
def ht_trendmode(close):
    return {"HT_TRENDMODE": when(row() > 63, _hilbert(close, 7, 37), 0)}


@op(CYC)
def msw(close, period=5):
    p = period
    re = wsum(close, [math.cos(2 * math.pi * (p - 1 - k) / p) for k in range(p)])
    im = wsum(close, [math.sin(2 * math.pi * (p - 1 - k) / p) for k in range(p)])
    phase = when(abs(re) > 0.001, fn("atan", im / re), math.pi * when(im < 0, -1, 1))
    phase = when(re < 0, phase + math.pi, phase) + math.pi / 2
    phase = when(phase < 0, phase + 2 * math.pi, phase)
    phase = when(phase > 2 * math.pi, phase - 2 * math.pi, phase)
    shown = lambda x: when(row() > p, x)
    return {f"MSW_SINE_{p}": shown(fn("sin", phase)), f"MSW_LEAD_{p}": shown(fn("sin", phase + math.pi / 4))}


_ = sqrt
