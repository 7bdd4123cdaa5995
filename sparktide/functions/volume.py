"""Volume indicators."""

from __future__ import annotations

from ..plans.expr import E, coalesce, cum, lag, least, linear, roll, row, sign, when
from ..plans.registry import op
from . import common as c
from .common import ema, nonzero_range, sma
from .trend import falling_run, rising_run

CAT = "volume"


def accumulation(high, low, close, volume, open_=None):
    move = nonzero_range(close, open_) if open_ is not None else 2 * close - high - low
    return move / nonzero_range(high, low) * volume


@op(CAT)
def ad(high, low, close, volume, open_: E | None = None):
    return {"AD" if open_ is None else "ADo": cum("sum", accumulation(high, low, close, volume, open_))}


@op(CAT)
def adosc(high, low, close, volume, open_: E | None = None, fast=3, slow=10):
    line = cum("sum", accumulation(high, low, close, volume, open_))
    return {f"ADOSC_{fast}_{slow}": when(row() >= slow, ema(line, fast, False) - ema(line, slow, False))}


def on_balance(close, volume):
    return cum("sum", volume * coalesce(sign(close.diff()), 1))


@op(CAT)
def aobv(close, volume, fast=4, slow=12, max_lookback=2, min_lookback=2, mamode="ema", run_length=2):
    line = on_balance(close, volume)
    f, s = c.ma(mamode, line, fast), c.ma(mamode, line, slow)
    return {
        "OBV": line, f"OBV_min_{min_lookback}": roll("min", line, min_lookback), f"OBV_max_{max_lookback}": roll("max", line, max_lookback),
        f"OBV{mamode[0]}_{fast}": f, f"OBV{mamode[0]}_{slow}": s, f"AOBV_LR_{run_length}": rising_run(f, s, run_length), f"AOBV_SR_{run_length}": falling_run(f, s, run_length),
    }


@op(CAT)
def cmf(high, low, close, volume, open_: E | None = None, length=20):
    return {f"CMF_{length}": roll("sum", accumulation(high, low, close, volume, open_), length) / roll("sum", volume, length)}


@op(CAT)
def efi(close, volume, length=13, mamode="ema", drift=1):
    return {f"EFI_{length}": c.ma(mamode, close.diff(drift) * volume, length)}


@op(CAT)
def emv(high, low, volume, divisor=10000, drift=1):
    return {"EMV": c.hl2(high, low).diff(drift) / ((volume / divisor) / nonzero_range(high, low))}


@op(CAT)
def eom(high, low, close, volume, length=14, divisor=100000000, drift=1):
    return {f"EOM_{length}_{divisor}": sma(c.hl2(high, low).diff(drift) / ((volume / divisor) / nonzero_range(high, low)), length)}


@op(CAT)
def kvo(high, low, close, volume, fast=34, slow=55, signal=13, mamode="ema"):
    flow = volume * c.signed(c.hlc3(high, low, close), 1)
    value = c.ma(mamode, flow, fast) - c.ma(mamode, flow, slow)
    return {f"KVO_{fast}_{slow}_{signal}": value, f"KVOs_{fast}_{slow}_{signal}": c.ma(mamode, value, signal)}


@op(CAT)
def marketfi(high, low, volume):
    return {"MARKETFI": (high - low) / volume}


@op(CAT)
def mfi(high, low, close, volume, length=14, drift=1):
    tp = c.hlc3(high, low, close)
    d, raw = tp.diff(drift), tp * volume
    up, down = roll("sum", when(d > 0, raw, when(d.notnull(), 0)), length), roll("sum", when(d < 0, raw, when(d.notnull(), 0)), length)
    return {f"MFI_{length}": 100 * up / (up + down)}


def _index(close, volume, length, initial, rose):
    roc = 100 * close.diff(length) / lag(close, length)
    d = volume.diff(length)
    return cum("sum", when(row().eq(1), initial, coalesce(when((d > 0) if rose else (d < 0), roc, 0), 0)))


@op(CAT)
def nvi(close, volume, length=1, initial=1000):
    return {f"NVI_{length}": _index(close, volume, length, initial, False)}


@op(CAT)
def pvi(close, volume, length=1, initial=1000):
    return {f"PVI_{length}": _index(close, volume, length, initial, True)}


@op(CAT)
def obv(close, volume):
    return {"OBV": on_balance(close, volume)}


@op(CAT)
def pvol(close, volume, signed=False):
    value = close * volume
    return {"PVOL": value * coalesce(sign(close.diff()), 1) if signed else value}


@op(CAT)
def pvr(close, volume):
    dc, dv = coalesce(close.diff(), 0), coalesce(volume.diff(), 0)
    return {"PVR": when((dc >= 0) & (dv >= 0), 1, when((dc >= 0) & (dv < 0), 2, when((dc < 0) & (dv >= 0), 3, 4)))}


@op(CAT)
def pvt(close, volume, drift=1):
    return {"PVT": cum("sum", 100 * close.diff(drift) / lag(close, drift) * volume)}


@op(CAT)
def vfi(close, volume, length=130, coef=0.2, vcoef=2.5, mamode="ema"):
    mean = sma(volume, length)
    usual = lag(mean)
    d = close.diff()
    flow = when(abs(d) > coef * close, least(volume, vcoef * usual) * d, when(usual.notnull(), 0))
    return {f"VFI_{length}": c.ma(mamode, roll("sum", flow, length) / sma(mean, length), 3)}


@op(CAT)
def vosc(volume, fast=14, slow=28):
    base = sma(volume, slow)
    return {f"VOSC_{fast}_{slow}": 100 * (sma(volume, fast) - base) / base}


@op(CAT)
def wad(high, low, close):
    prev = lag(close)
    step = when(close > prev, close - least(low, prev), when(close < prev, close - when(high > prev, high, prev), 0))
    return {"WAD": cum("sum", step)}


_ = linear
