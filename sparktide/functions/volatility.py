"""Volatility measures and bands."""

from __future__ import annotations

import math

from ..plans.expr import E, cum, greatest, lag, ln, recursive, roll, sqrt, when
from ..plans.registry import op
from . import common as c
from .common import ema, sma
from .momentum import keltner, relative_volatility

CAT = "volatility"


@op(CAT)
def aberration(high, low, close, length=5, atr_length=15):
    zg, a = sma(c.hlc3(high, low, close), length), c.atr(high, low, close, atr_length)
    tail = f"_{length}_{atr_length}"
    return {f"ABER_ZG{tail}": zg, f"ABER_SG{tail}": zg + a, f"ABER_XG{tail}": zg - a, f"ABER_ATR{tail}": a}


@op(CAT)
def accbands(high, low, close, length=20, c_=4, mamode="sma"):
    r = c_ * c.nonzero_range(high, low) / (high + low)
    return {f"ACCBL_{length}": c.ma(mamode, low * (1 - r), length), f"ACCBM_{length}": c.ma(mamode, close, length), f"ACCBU_{length}": c.ma(mamode, high * (1 + r), length)}


@op(CAT)
def atr(high, low, close, length=14, mamode="rma", percent=False, drift=1):
    a = c.atr(high, low, close, length, mamode, drift)
    return {f"ATR{mamode[0]}_{length}{'p' if percent else ''}": a * 100 / close if percent else a}


def _log_return(close):
    return ln(close / lag(close))


@op(CAT)
def avolume(close, length=20):
    return {f"AVOLUME_{length}": roll("stddev_pop", _log_return(close), length) * math.sqrt(252)}


@op(CAT)
def bbands(close, length=5, std=2.0, ddof=0, mamode="sma"):
    mid, band = c.ma(mamode, close, length), std * c.stdev(close, length, ddof)
    lo, hi = mid - band, mid + band
    tail = f"_{length}_{std}"
    return {f"BBL{tail}": lo, f"BBM{tail}": mid, f"BBU{tail}": hi, f"BBB{tail}": 100 * (hi - lo) / mid, f"BBP{tail}": (close - lo) / (hi - lo)}


@op(CAT)
def ce(high, low, close, length=22, multiplier=3.0, mamode="rma"):
    a = multiplier * c.atr(high, low, close, length, mamode or "rma")
    return {f"CE_L_{length}_{multiplier}": roll("max", high, length) - a, f"CE_S_{length}_{multiplier}": roll("min", low, length) + a}


@op(CAT)
def cvi(high, low, length=10):
    e = ema(high - low, length)
    return {f"CVI_{length}": 100 * (e - lag(e, length)) / lag(e, length)}


@op(CAT)
def donchian(high, low, lower_length=20, upper_length=20):
    lo, hi = roll("min", low, lower_length), roll("max", high, upper_length)
    tail = f"_{lower_length}_{upper_length}"
    return {f"DCL{tail}": lo, f"DCM{tail}": (lo + hi) / 2, f"DCU{tail}": hi}


@op(CAT)
def hvol(close, length=20, annualization=252):
    return {f"HVOL_{length}": 100 * roll("stddev_samp", _log_return(close), length) * math.sqrt(annualization)}


@op(CAT)
def hwc(close, na=0.2, nb=0.1, nc=0.1, nd=0.1, scalar=1, channel_eval=False):
    out = {n: recursive("holt_winters_channel", (close,), k, na=na, nb=nb, nc=nc, nd=nd, scalar=float(scalar)) for k, n in enumerate(("HWM", "HWU", "HWL"))}
    if channel_eval:
        out["HWW"] = out["HWU"] - out["HWL"]
        out["HWPCT"] = (close - out["HWL"]) / out["HWW"]
    return out


@op(CAT)
def kc(high, low, close, length=20, scalar=2, mamode="ema", tr=True):
    lo, mid, hi = keltner(high, low, close, length, scalar, mamode, tr)
    tail = f"{mamode[0]}_{length}_{scalar}"
    return {f"KCL{tail}": lo, f"KCB{tail}": mid, f"KCU{tail}": hi}


@op(CAT)
def massi(high, low, fast=9, slow=25):
    e = ema(c.nonzero_range(high, low), fast)
    return {f"MASSI_{fast}_{slow}": roll("sum", e / ema(e, fast), slow)}


@op(CAT)
def natr(high, low, close, length=14, scalar=100, mamode="rma", drift=1):
    return {f"NATR_{length}": scalar / close * c.atr(high, low, close, length, mamode, drift)}


@op(CAT)
def pdist(open_, high, low, close, drift=1):
    return {"PDIST": 2 * c.nonzero_range(high, low) + abs(c.nonzero_range(open_, lag(close, drift))) - abs(c.nonzero_range(close, open_))}


@op(CAT)
def rvi(close, high: E | None = None, low: E | None = None, length=14, scalar=100, refined=False, thirds=False, mamode="ema", drift=1):
    of = lambda x: relative_volatility(x, length, scalar, mamode, drift)
    if refined:
        return {f"RVIr_{length}": (of(high) + of(low)) / 2}
    if thirds:
        return {f"RVIt_{length}": (of(high) + of(low) + of(close)) / 3}
    return {f"RVI_{length}": of(close)}


@op(CAT)
def thermo(high, low, length=20, long=2, short=0.5, mamode="ema", drift=1):
    a, b = abs(lag(low, drift) - low), abs(high - lag(high, drift))
    heat = when(a.notnull(), greatest(a, b))
    mean, tail = c.ma(mamode, heat, length), f"_{length}_{long}_{short}"
    return {f"THERMO{tail}": heat, f"THERMOma{tail}": mean, f"THERMOl{tail}": c.flag(heat < mean * long), f"THERMOs{tail}": c.flag(heat > mean * short)}


@op(CAT)
def true_range(high, low, close, drift=1):
    return {f"TRUERANGE_{drift}": c.true_range(high, low, close, drift)}


@op(CAT)
def ui(close, length=14, scalar=100, everget=False):
    top = roll("max", close, length)
    d = scalar * (close - top) / top
    return {f"UI{'e' if everget else ''}_{length}": sqrt((sma(d * d, length) if everget else roll("sum", d * d, length)) / length)}


_ = cum
