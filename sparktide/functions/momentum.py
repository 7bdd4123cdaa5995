"""Oscillators and rates of change."""

from __future__ import annotations

import math

from ..plans.expr import E, coalesce, cum, fn, greatest, lag, last_value, least, linear, nonzero, prior, recursive, roll, row, sign, sqrt, when
from ..plans.registry import op
from . import common as c
from .common import ema, flag, nonzero_range, rma, sma

CAT = "momentum"


@op(CAT)
def ao(high, low, fast=5, slow=34):
    mid = c.hl2(high, low)
    return {f"AO_{fast}_{slow}": sma(mid, fast) - sma(mid, slow)}


@op(CAT)
def apo(close, fast=12, slow=26, mamode="sma"):
    fast, slow = sorted((fast, slow))
    return {f"APO_{fast}_{slow}": c.ma(mamode, close, fast) - c.ma(mamode, close, slow)}


@op(CAT)
def bias(close, length=26, mamode="sma"):
    return {f"BIAS_{c.label(mamode)}_{length}": close / c.ma(mamode, close, length) - 1}


@op(CAT)
def bop(open_, high, low, close, scalar=1):
    return {"BOP": scalar * nonzero_range(close, open_) / nonzero_range(high, low)}


@op(CAT)
def brar(open_, high, low, close, length=26, scalar=100, drift=1):
    prev = lag(close, drift)
    up, down = nonzero_range(high, prev), nonzero_range(prev, low)
    return {
        f"AR_{length}": scalar * roll("sum", nonzero_range(high, open_), length) / roll("sum", nonzero_range(open_, low), length),
        f"BR_{length}": scalar * roll("sum", c.positive(up), length) / roll("sum", c.positive(down), length),
    }


@op(CAT)
def cci(high, low, close, length=14, c_=0.015):
    tp = c.hlc3(high, low, close)
    return {f"CCI_{length}_{c_}": (tp - sma(tp, length)) / (c_ * c.mad(tp, length))}


@op(CAT)
def cfo(close, length=9, scalar=100):
    return {f"CFO_{length}": scalar * (close - c.linreg(close, length, length)) / close}


@op(CAT)
def cg(close, length=10):
    return {f"CG_{length}": -c.wsum(close, range(length, 0, -1)) / roll("sum", close, length)}


@op(CAT)
def cmo(close, length=14, scalar=100, drift=1):
    return {f"CMO_{length}": c.cmo(close, length, scalar, drift)}


def _roc(x, n, scalar=100):
    return scalar * x.diff(n) / lag(x, n)


@op(CAT)
def coppock(close, length=10, fast=11, slow=14):
    return {f"COPC_{fast}_{slow}_{length}": c.wma(_roc(close, fast) + _roc(close, slow), length)}


@op(CAT)
def cti(close, length=12):
    return {f"CTI_{length}": c.regression_r(close, length)}


def directional(high, low, drift=1):
    up, dn = high.diff(drift), lag(low, drift) - low
    return when(up.notnull(), when((up > dn) & (up > 0), up, 0)), when(dn.notnull(), when((dn > up) & (dn > 0), dn, 0))


@op(CAT)
def dm(high, low, length=14, mamode="rma", drift=1):
    pos, neg = directional(high, low, drift)
    if mamode == "rma":
        return {f"DMP_{length}": c.wilder_sum(pos, length), f"DMN_{length}": c.wilder_sum(neg, length)}
    return {f"DMP_{length}": c.ma(mamode, pos, length), f"DMN_{length}": c.ma(mamode, neg, length)}


@op(CAT)
def er(close, length=10, drift=1):
    return {f"ER_{length}": abs(close.diff(length)) / roll("sum", abs(close.diff(drift)), length)}


@op(CAT)
def eri(high, low, close, length=13):
    mid = ema(close, length)
    return {f"BULLP_{length}": high - mid, f"BEARP_{length}": low - mid}


@op(CAT)
def fisher(high, low, length=9, signal=1):
    mid = c.hl2(high, low)
    lo = roll("min", mid, length)
    span = greatest(roll("max", mid, length) - lo, 0.001)
    out = recursive("fisher", ((mid - lo) / span - 0.5,), n=length)
    return {f"FISHERT_{length}_{signal}": out, f"FISHERTs_{length}_{signal}": lag(out, signal)}


@op(CAT)
def fosc(close, length=14):
    return {f"FOSC_{length}": 100 * (close - c.linreg(close, length, length)) / close}


def relative_volatility(x, length=14, scalar=100, mamode="ema", drift=1):
    d, sd = x.diff(drift), c.stdev(x, length)
    up, down = c.ma(mamode, when(d > 0, sd, when(sd.notnull(), 0)), length), c.ma(mamode, when(d < 0, sd, when(sd.notnull(), 0)), length)
    return scalar * up / (up + down)


@op(CAT)
def inertia(close, high: E | None = None, low: E | None = None, length=20, rvi_length=14, scalar=100, refined=False, thirds=False, mamode="ema"):
    args = (rvi_length, scalar, mamode)
    if refined:
        mode, value = "r", (relative_volatility(high, *args) + relative_volatility(low, *args)) / 2
    elif thirds:
        mode, value = "t", (relative_volatility(high, *args) + relative_volatility(low, *args) + relative_volatility(close, *args)) / 3
    else:
        mode, value = "", relative_volatility(close, *args)
    return {f"INERTIA{mode}_{length}_{rvi_length}": c.linreg(value, length)}


@op(CAT)
def kdj(high, low, close, length=9, signal=3):
    lo = roll("min", low, length)
    fast = 100 * (close - lo) / nonzero_range(roll("max", high, length), lo)
    k = rma(fast, signal)
    d = rma(k, signal)
    return {f"K_{length}_{signal}": k, f"D_{length}_{signal}": d, f"J_{length}_{signal}": 3 * k - 2 * d}


@op(CAT)
def kst(close, roc1=10, roc2=15, roc3=20, roc4=30, sma1=10, sma2=10, sma3=10, sma4=15, signal=9):
    total = None
    for k, (r, s) in enumerate(((roc1, sma1), (roc2, sma2), (roc3, sma3), (roc4, sma4)), 1):
        part = k * sma(_roc(close, r, 1), s)
        total = part if total is None else total + part
    total = 100 * total
    return {f"KST_{roc1}_{roc2}_{roc3}_{roc4}_{sma1}_{sma2}_{sma3}_{sma4}": total, f"KSTs_{signal}": sma(total, signal)}


@op(CAT)
def lrsi(close, length=14, gamma=0.5):
    return {f"LRSI_{length}": recursive("laguerre", (close,), gamma=gamma)}


def _macd(close, fast, slow, signal):
    fast, slow = sorted((fast, slow))
    value = ema(close, fast) - ema(close, slow)
    return value, ema(value, signal)


@op(CAT)
def macd(close, fast=12, slow=26, signal=9, asmode=False):
    fast, slow = sorted((fast, slow))
    value, sig = _macd(close, fast, slow, signal)
    mode = ""
    if asmode:
        mode, value = "AS", value - sig
        sig = ema(value, signal)
    tail = f"_{fast}_{slow}_{signal}"
    return {f"MACD{mode}{tail}": value, f"MACD{mode}h{tail}": value - sig, f"MACD{mode}s{tail}": sig}


#: Average by type code; 6 and 7 have no such average and fall back.
MATYPES = {0: "sma", 1: "ema", 2: "wma", 3: "dema", 4: "tema", 5: "trima", 6: "ema", 7: "ema", 8: "t3"}


@op(CAT)
def macdext(close, fast=12, slow=26, signal=9, fastmatype=1, slowmatype=1, signalmatype=1):
    value = c.ma(MATYPES[fastmatype], close, fast) - c.ma(MATYPES[slowmatype], close, slow)
    sig, tail = c.ma(MATYPES[signalmatype], value, signal), f"_{fast}_{slow}_{signal}"
    return {f"MACDEXT{tail}": value, f"MACDEXTs{tail}": sig, f"MACDEXTh{tail}": value - sig}


@op(CAT)
def macdfix(close, signal=9):
    value, sig = _macd(close, 12, 26, signal)
    tail = f"_{signal}_{signal}"
    return {f"MACDFIX{tail}": value, f"MACDFIXh{tail}": value - sig, f"MACDFIXs{tail}": sig}


@op(CAT)
def mom(close, length=10):
    return {f"MOM_{length}": close.diff(length)}


@op(CAT)
def pgo(high, low, close, length=14):
    return {f"PGO_{length}": (close - sma(close, length)) / ema(c.atr(high, low, close, length), length)}


@op(CAT)
def po(close, length=14):
    line = c.linreg(close, length)
    return {f"PO_{length}": 100 * (close - line) / line}


@op(CAT)
def ppo(close, fast=12, slow=26, signal=9, scalar=100, mamode="sma"):
    fast, slow = sorted((fast, slow))
    base = c.ma(mamode, close, slow)
    value = scalar * (c.ma(mamode, close, fast) - base) / base
    sig, tail = ema(value, signal), f"_{fast}_{slow}_{signal}"
    return {f"PPO{tail}": value, f"PPOh{tail}": value - sig, f"PPOs{tail}": sig}


@op(CAT)
def psl(close, open_: E | None = None, length=12, scalar=100, drift=1):
    d = close - open_ if open_ is not None else close.diff(drift)
    return {f"PSL_{length}": scalar * roll("sum", when(d > 0, 1, 0), length) / length}


@op(CAT)
def pvo(volume, fast=12, slow=26, signal=9, scalar=100):
    return {k.replace("PPO", "PVO"): v for k, v in ppo(volume, fast, slow, signal, scalar, "ema").items()}


def relative_strength(x, length=14, scalar=100, drift=1):
    d = x.diff(drift)
    up, down = rma(c.positive(d), length), rma(c.positive(-d), length)
    return scalar * up / (up + down)


@op(CAT)
def qqe(close, length=14, smooth=5, factor=4.236, mamode="ema", drift=1):
    wilder = 2 * length - 1
    r = c.ma(mamode, relative_strength(close, length, 100, drift), smooth)
    band = factor * ema(ema(abs(r.diff(drift)), wilder), wilder)
    mode = "" if mamode == "ema" else mamode[0]
    tail = f"{mode}_{length}_{smooth}_{factor}"
    out = lambda k: recursive("qqe", (r, band), k)
    return {f"QQE{tail}": out(0), f"QQE{tail}_RSI{mode.upper()}MA": r, f"QQEl{tail}": out(1), f"QQEs{tail}": out(2), f"QQEb_l{tail}": out(3), f"QQEb_s{tail}": out(4), f"QQEd{tail}": out(5)}


@op(CAT)
def roc(close, length=10, scalar=100):
    return {f"ROC_{length}": _roc(close, length, scalar)}


@op(CAT)
def rocp(close, length=10):
    return {f"ROCP_{length}": _roc(close, length, 1)}


@op(CAT)
def rocr(close, length=10):
    return {f"ROCR_{length}": close / lag(close, length)}


@op(CAT)
def rocr100(close, length=10):
    return {f"ROCR100_{length}": 100 * close / lag(close, length)}


@op(CAT)
def rsi(close, length=14, scalar=100, drift=1):
    return {f"RSI_{length}": relative_strength(close, length, scalar, drift)}


@op(CAT)
def rsx(close, length=14):
    return {f"RSX_{length}": recursive("rsx", (close,), n=length)}


@op(CAT)
def rvgi(open_, high, low, close, length=14, swma_length=4):
    w = c.triangle(swma_length)
    value = roll("sum", c.weighted(nonzero_range(close, open_), w), length) / roll("sum", c.weighted(nonzero_range(high, low), w), length)
    sig, tail = c.weighted(value, w), f"_{length}_{swma_length}"
    return {f"RVGI{tail}": value, f"RVGIs{tail}": sig, f"RVGIh{tail}": value - sig}


@op(CAT)
def slope(close, length=1, as_angle=None, to_degrees=None):
    s = close.diff(length) / length
    if not isinstance(as_angle, bool):
        return {f"SLOPE_{length}": s}
    degrees = isinstance(to_degrees, bool)
    a = fn("atan", s)
    return {f"ANGLE{'d' if degrees else 'r'}_{length}": fn("degrees", a) if degrees else a}


@op(CAT)
def smc_sweep(open_, high, low, close, length=15, wick_mult=1.5):
    top, bottom = prior("max", high, -length, -1, length), prior("min", low, -length, -1, length)
    body = abs(close - open_)
    up = (low < bottom) & (close > bottom) & (close > open_) & (least(open_, close) - low > wick_mult * body)
    down = (high > top) & (close < top) & (close < open_) & (high - greatest(open_, close) > wick_mult * body)
    return {f"SMC_SWEEP_{length}_{round(wick_mult, 4)}": when(up, 1, when(down, -1, 0))}


def strength_index(x, fast=13, slow=25, signal=13, scalar=100, mamode="ema", drift=1):
    d = x.diff(drift)
    value = scalar * ema(ema(d, slow), fast) / ema(ema(abs(d), slow), fast)
    return value, c.ma(mamode, value, signal)


@op(CAT)
def smi(close, fast=5, slow=20, signal=5, scalar=1):
    value, sig = strength_index(close, fast, slow, signal, scalar)
    tail = f"_{fast}_{slow}_{signal}" + (f"_{scalar}" if scalar != 1 else "")
    return {f"SMI{tail}": value, f"SMIs{tail}": sig, f"SMIo{tail}": value - sig}


def keltner(high, low, close, length, scalar, mamode="ema", tr=True):
    span = c.true_range(high, low, close) if tr else nonzero_range(high, low)
    mid, band = c.ma(mamode, close, length), c.ma(mamode, span, length)
    return mid - scalar * band, mid, mid + scalar * band


def _squeeze_momentum(high, low, close, length, smooth, mamode, lazybear, kc):
    if lazybear:
        return c.linreg(close - (0.25 * (roll("max", high, length) + roll("min", low, length)) + 0.5 * kc[1]), length)
    return c.ma(mamode, close.diff(length), smooth)


def _details(name, m):
    """Momentum where it rises or falls, and by sign; null elsewhere."""
    up, down = m.diff() > 0, m.diff() < 0
    shown = lambda cond: when(cond & m.ne(0), m)
    return {f"{name}_INC": shown(up), f"{name}_DEC": shown(down), f"{name}_PINC": shown(up & (m >= 0)), f"{name}_PDEC": shown(down & (m >= 0)), f"{name}_NDEC": shown(down & (m < 0)), f"{name}_NINC": shown(up & (m < 0))}


@op(CAT)
def squeeze(high, low, close, bb_length=20, bb_std=2.0, kc_length=20, kc_scalar=1.5, mom_length=12, mom_smooth=6, use_tr=True, mamode="sma", lazybear=False, detailed=False):
    mid, sd = sma(close, bb_length), c.stdev(close, bb_length)
    lo, hi = mid - bb_std * sd, mid + bb_std * sd
    kc = keltner(high, low, close, kc_length, kc_scalar, mamode, use_tr)
    m = _squeeze_momentum(high, low, close, kc_length if lazybear else mom_length, mom_smooth, mamode, lazybear, kc)
    on, off = (lo > kc[0]) & (hi < kc[2]), (lo < kc[0]) & (hi > kc[2])
    name = f"SQZ{'' if use_tr else 'hlr'}_{bb_length}_{bb_std}_{kc_length}_{kc_scalar}{'_LB' if lazybear else ''}"
    out = {name: m, "SQZ_ON": flag(on), "SQZ_OFF": flag(off), "SQZ_NO": when(on, 0, when(off, 0, 1))}
    return out | (_details("SQZ", m) if detailed else {})


@op(CAT)
def squeeze_pro(high, low, close, bb_length=20, bb_std=2.0, kc_length=20, kc_scalar_wide=2, kc_scalar_normal=1.5, kc_scalar_narrow=1, mom_length=12, mom_smooth=6, use_tr=True, mamode="sma", detailed=False):
    if not kc_scalar_wide > kc_scalar_normal > kc_scalar_narrow:
        raise ValueError("the scalars must fall from wide to narrow")
    mid, sd = sma(close, bb_length), c.stdev(close, bb_length)
    lo, hi = mid - bb_std * sd, mid + bb_std * sd
    wide, normal, narrow = (keltner(high, low, close, kc_length, s, mamode, use_tr) for s in (kc_scalar_wide, kc_scalar_normal, kc_scalar_narrow))
    inside = lambda k: (lo > k[0]) & (hi < k[2])
    off = (lo < wide[0]) & (hi > wide[2])
    m = _squeeze_momentum(high, low, close, mom_length, mom_smooth, mamode, False, wide)
    name = f"SQZPRO{'' if use_tr else 'hlr'}_{bb_length}_{bb_std}_{kc_length}_{kc_scalar_wide}_{kc_scalar_normal}_{kc_scalar_narrow}"
    out = {name: m, "SQZPRO_ON_WIDE": flag(inside(wide)), "SQZPRO_ON_NORMAL": flag(inside(normal)), "SQZPRO_ON_NARROW": flag(inside(narrow)), "SQZPRO_OFF": flag(off), "SQZPRO_NO": when(inside(wide), 0, when(off, 0, 1))}
    return out | (_details("SQZPRO", m) if detailed else {})


@op(CAT)
def stc(close, tclength=10, fast=12, slow=26, factor=0.5):
    value = ema(close, fast) - ema(close, slow)
    lo = roll("min", value, tclength)
    span = nonzero(roll("max", value, tclength) - lo)
    first = recursive("stochastic_pass", (value, lo, span, lo), factor=factor)
    lo2 = roll("min", first, tclength)
    span2 = nonzero(roll("max", first, tclength) - lo2)
    tail = f"_{tclength}_{fast}_{slow}_{factor}"
    return {f"STC{tail}": recursive("stochastic_pass", (first, lo2, span2, span2), factor=factor), f"STCmacd{tail}": value, f"STCstoch{tail}": first}


def _trimmed_ma(mode, x, n):
    """Average over the rows from the first value on (also of one seeded by row)."""
    if mode == "rma":
        x_, count = x, cum("count", x)
        return linear(1 - 1 / n, x_ / n, when(count.eq(n) & x_.notnull(), cum("sum", x_) / count))
    return c.ma(mode, x, n)


@op(CAT)
def stoch(high, low, close, k=14, d=3, smooth_k=3, mamode="sma"):
    lo = roll("min", low, k)
    raw = 100 * (close - lo) / nonzero_range(roll("max", high, k), lo)
    main = _trimmed_ma(mamode, raw, smooth_k)
    return {f"STOCHk_{k}_{d}_{smooth_k}": main, f"STOCHd_{k}_{d}_{smooth_k}": _trimmed_ma(mamode, main, d)}


@op(CAT)
def stochf(high, low, close, fastk=5, fastd=3, mamode="sma"):
    lo = roll("min", low, fastk)
    raw = 100 * (close - lo) / nonzero_range(roll("max", high, fastk), lo)
    return {f"STOCHFk_{fastk}_{fastd}": raw, f"STOCHFd_{fastk}_{fastd}": _trimmed_ma(mamode, raw, fastd)}


@op(CAT)
def stochrsi(close, length=14, rsi_length=14, k=3, d=3, mamode="sma"):
    r = relative_strength(close, rsi_length)
    lo = roll("min", r, length)
    main = _trimmed_ma(mamode, 100 * (r - lo) / nonzero_range(roll("max", r, length), lo), k)
    tail = f"_{length}_{rsi_length}_{k}_{d}"
    return {f"STOCHRSIk{tail}": main, f"STOCHRSId{tail}": _trimmed_ma(mamode, main, d)}


def run_length(cond: E) -> E:
    """Rows in a row for which the condition holds."""
    start = last_value(when(cond, None, row()))
    return when(cond, row() - coalesce(start, 0), 0)


@op(CAT)
def td_seq(close, asint=False, show_all=True):
    up, down = least(run_length(close.diff(4) > 0), 13), least(run_length(close.diff(4) < 0), 13)
    if show_all:
        return {"TD_SEQ_UPa": when(up.ne(0), up), "TD_SEQ_DNa": when(down.ne(0), down)}
    return {"TD_SEQ_UP": when((up >= 6) & (up <= 9), up), "TD_SEQ_DN": when((down >= 6) & (down <= 9), down)}


def _trix(close, length, signal, scalar, drift):
    e = ema(ema(ema(close, length), length), length)
    value = scalar * (e / lag(e, drift) - 1)
    return value, sma(value, signal)


@op(CAT)
def trix(close, length=30, signal=9, scalar=100, drift=1):
    value, sig = _trix(close, length, signal, scalar, drift)
    return {f"TRIX_{length}_{signal}": value, f"TRIXs_{length}_{signal}": sig}


@op(CAT)
def trixh(close, length=18, signal=9, scalar=100):
    value, sig = _trix(close, length, signal, scalar, 1)
    return {f"TRIX_{length}_{signal}": value, f"TRIXs_{length}_{signal}": sig, f"TRIXh_{length}_{signal}": value - sig}


@op(CAT)
def tsi(close, fast=13, slow=25, signal=13, scalar=100, mamode="ema", drift=1):
    value, sig = strength_index(close, fast, slow, signal, scalar, mamode, drift)
    return {f"TSI_{fast}_{slow}_{signal}": value, f"TSIs_{fast}_{slow}_{signal}": sig}


@op(CAT)
def uo(high, low, close, fast=7, medium=14, slow=28, fast_w=4.0, medium_w=2.0, slow_w=1.0, drift=1):
    prev = lag(close, drift)
    floor = least(low, prev)
    bp, tr = when(prev.notnull(), close - floor), when(prev.notnull(), greatest(high, prev) - floor)
    part = lambda n: roll("sum", bp, n) / roll("sum", tr, n)
    return {f"UO_{fast}_{medium}_{slow}": 100 * (fast_w * part(fast) + medium_w * part(medium) + slow_w * part(slow)) / (fast_w + medium_w + slow_w)}


@op(CAT)
def vwmacd(close, volume, fast=12, slow=26, signal=9):
    vw = lambda x, n: sma(x * volume, n) / sma(volume, n)
    value = vw(close, fast) - vw(close, slow)
    sig, tail = vw(value, signal), f"_{fast}_{slow}_{signal}"
    return {f"VWMACD{tail}": value, f"VWMACDs{tail}": sig, f"VWMACDh{tail}": value - sig}


@op(CAT)
def willr(high, low, close, length=14):
    lo = roll("min", low, length)
    return {f"WILLR_{length}": 100 * ((close - lo) / (roll("max", high, length) - lo) - 1)}


_ = (math, sign, sqrt)
