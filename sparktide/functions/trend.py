"""Trend direction and strength."""

from __future__ import annotations

import math

from ..plans.expr import E, coalesce, fn, greatest, lag, last_value, ln, log10, prior, recursive, roll, row, since, when
from ..plans.registry import op
from . import common as c
from .common import flag, rma, sma
from .momentum import directional

CAT = "trend"


def _dmi(high, low, close, length, scalar, mamode, drift):
    pos, neg = directional(high, low, drift)
    k = scalar / c.atr(high, low, close, length, mamode, drift)
    return k * c.ma(mamode, pos, length), k * c.ma(mamode, neg, length)


def _dx(p, n, scalar):
    return scalar * abs(p - n) / (p + n)


@op(CAT)
def adx(high, low, close, length=14, lensig=None, scalar=100, mamode="rma", drift=1):
    lensig = lensig or length
    p, n = _dmi(high, low, close, length, scalar, mamode, drift)
    return {f"ADX_{lensig}": c.ma(mamode, _dx(p, n, scalar), lensig), f"DMP_{length}": p, f"DMN_{length}": n}


@op(CAT)
def adxr(high, low, close, length=14, lensig=None, scalar=100, mamode="rma"):
    lensig = lensig or length
    p, n = _dmi(high, low, close, length, scalar, mamode, 1)
    a = c.ma(mamode, _dx(p, n, scalar), lensig)
    return {f"ADXR_{lensig}": (a + lag(a, length - 1)) / 2, f"DMP_{length}": p, f"DMN_{length}": n}


def rising_run(fast, slow, n):
    return flag(((fast.diff(n) > 0) & (slow.diff(n) < 0)) | ((fast.diff(n) > 0) & (slow.diff(n) > 0)))


def falling_run(fast, slow, n):
    return flag(((fast.diff(n) < 0) & (slow.diff(n) > 0)) | ((fast.diff(n) < 0) & (slow.diff(n) < 0)))


@op(CAT)
def amat(close, fast=8, slow=21, lookback=2, mamode="ema"):
    f, s = c.ma(mamode, close, fast), c.ma(mamode, close, slow)
    tail = f"_{fast}_{slow}_{lookback}"
    return {f"AMAT{mamode[0]}_LR{tail}": rising_run(f, s, lookback), f"AMAT{mamode[0]}_SR{tail}": falling_run(f, s, lookback)}


@op(CAT)
def aroon(high, low, length=14, scalar=100):
    up = scalar * (1 - since(high, length + 1, "max") / length)
    down = scalar * (1 - since(low, length + 1, "min") / length)
    return {f"AROONU_{length}": up, f"AROOND_{length}": down, f"AROONOSC_{length}": up - down}


@op(CAT)
def chop(high, low, close, length=14, atr_length=1, ln_=False, scalar=100):
    log = ln if ln_ else log10
    total = roll("sum", c.atr(high, low, close, atr_length), length)
    span = roll("max", high, length) - roll("min", low, length)
    return {f"CHOP{'ln' if ln_ else ''}_{length}_{atr_length}_{scalar}": scalar * (log(total) - log(span)) / (math.log(length) if ln_ else math.log10(length))}


@op(CAT)
def cksp(high, low, close, p=10, x=3, q=20, tvmode=True):
    a = c.atr(high, low, close, p, "rma" if tvmode else "sma")
    return {f"CKSPl_{p}_{x}_{q}": roll("max", roll("max", high, p) - x * a, q), f"CKSPs_{p}_{x}_{q}": roll("min", roll("min", low, p) + x * a, q)}


@op(CAT)
def decay(close, length=5, mode="linear"):
    exponential = mode.lower().startswith("exp")
    step = math.exp(-length) if exponential else 1 / length
    return {f"{'EXP' if exponential else 'L'}DECAY_{length}": greatest(close, lag(close) - step, 0)}


def _monotone(close, length, strict, asint, percent, up):
    if strict:
        step = None
        for k in range(length):
            a, b = lag(close, k), lag(close, k + 1)
            one = (a > b) if up else (a < b)
            step = one if step is None else step & one
    elif percent:
        bound = lag(close, length) * (1 + percent / 100 if up else 1 - percent / 100)
        step = (close > bound) if up else (close < bound)
    else:
        step = (close.diff(length) > 0) if up else (close.diff(length) < 0)
    return flag(step)


@op(CAT)
def decreasing(close, length=1, strict=False, asint=True, percent=None):
    name = f"{'S' if strict else ''}DEC{'p' if percent else ''}_{length}" + (f"_{percent}" if percent else "")
    return {name: _monotone(close, length, strict, asint, percent, False)}


@op(CAT)
def increasing(close, length=1, strict=False, asint=True, percent=None):
    name = f"{'S' if strict else ''}INC{'p' if percent else ''}_{length}" + (f"_{percent}" if percent else "")
    return {name: _monotone(close, length, strict, asint, percent, True)}


@op(CAT)
def dpo(close, length=20, centered=True, lookahead=True):
    t = length // 2 + 1
    mid = sma(close, length)
    return {f"DPO_{length}": lag(lag(close, t) - mid, -t) if centered and lookahead else close - lag(mid, t)}


@op(CAT)
def dx(high, low, close, length=14, scalar=100, mamode="rma", drift=1):
    p, n = _dmi(high, low, close, length, scalar, mamode, drift)
    return {f"DX_{length}": _dx(p, n, scalar)}


@op(CAT)
def edecay(close, length=5):
    """Running maximum of the logarithm plus the rows' share of the decay."""
    from ..plans.expr import cum

    at = row() / length
    return {f"EDECAY_{length}": fn("exp", cum("max", ln(close) + at) - at)}


@op(CAT)
def long_run(fast: E, slow: E, length=2):
    return {f"LR_{length}": rising_run(fast, slow, length)}


@op(CAT)
def short_run(fast: E, slow: E, length=2):
    return {f"SR_{length}": falling_run(fast, slow, length)}


@op(CAT)
def minus_dm(high, low, length=14, drift=1):
    return {f"MINUS_DM_{length}": length * rma(directional(high, low, drift)[1], length)}


@op(CAT)
def plus_dm(high, low, length=14, drift=1):
    return {f"PLUS_DM_{length}": length * rma(directional(high, low, drift)[0], length)}


@op(CAT)
def pmax(high, low, close, length=10, multiplier=3.0, mamode="ema"):
    both = (c.ma(mamode, close, length), multiplier * c.atr(high, low, close, length), close)
    return {f"PMAX_{mamode[0].upper()}_{length}_{multiplier}": recursive("pmax", both)}


@op(CAT)
def psar(high, low, close, af0=0.02, af=0.02, max_af=0.2):
    return {f"{n}_{af0}_{max_af}": recursive("parabolic", (high, low, close), k, af0=af0, af=af, max_af=max_af) for k, n in enumerate(("PSARl", "PSARs", "PSARaf", "PSARr"))}


@op(CAT)
def qstick(open_, close, length=10, ma="sma"):
    return {f"QS_{length}": c.ma(ma, c.nonzero_range(close, open_), length)}


@op(CAT)
def sarext(high, low, startvalue=0.0, offsetonreverse=0.0, accelerationinitlong=0.02, accelerationlong=0.02, accelerationmaxlong=0.2, accelerationinitshort=0.02, accelerationshort=0.02, accelerationmaxshort=0.2):
    params = {"start": startvalue, "offset": offsetonreverse, "init_long": accelerationinitlong, "step_long": accelerationlong, "max_long": accelerationmaxlong, "init_short": accelerationinitshort, "step_short": accelerationshort, "max_short": accelerationmaxshort}
    return {"SAREXT": recursive("parabolic_extended", (high, low), **params)}


def trade_signals(trend, trade_offset=0, trend_reset=0):
    trades = lag(coalesce(trend.diff(), 0), trade_offset)
    return {"TS_Trends": trend, "TS_Trades": trades, "TS_Entries": flag(trades > 0), "TS_Exits": flag(trades < 0)}


@op(CAT)
def tsignals(trend: E, asbool=False, trend_reset=0, trade_offset=0):
    return trade_signals(when(trend > trend_reset, 1, 0), trade_offset)


@op(CAT)
def ttm_trend(high, low, close, length=6):
    # Rows before the first mean count as below it.
    return {f"TTM_TRND_{length}": when(close > sma(c.hl2(high, low), length), 1, -1)}


@op(CAT)
def vhf(close, length=28, drift=1):
    return {f"VHF_{length}": abs(roll("max", close, length) - roll("min", close, length)) / roll("sum", abs(close.diff(drift)), length)}


@op(CAT)
def vortex(high, low, close, length=14, drift=1):
    tr = roll("sum", c.true_range(high, low, close), length)
    return {f"VTXP_{length}": roll("sum", abs(high - lag(low, drift)), length) / tr, f"VTXM_{length}": roll("sum", abs(low - lag(high, drift)), length) / tr}


@op(CAT)
def xsignals(signal: E, xa=80, xb=20, above=True, long=True, trade_offset=0):
    """Enters where the signal crosses xa, leaves where it crosses xb back."""
    over = lambda v: (signal > v) & (lag(signal) < v)
    under = lambda v: (signal < v) & (lag(signal) > v)
    enter, leave = (over(xa), under(xb)) if above else (under(xa), over(xb))
    state = coalesce(last_value(when(enter, 1, when(leave, 0))), 0)
    return trade_signals(state if long else 1 - state, trade_offset)


def pivot_levels(method, o, h, low, c_):
    """Central pivot range and levels from the previous period's bar."""
    p = (h + low + 2 * c_) / 4 if method == "woodie" else (h + low + c_) / 3
    bc = (h + low) / 2
    out = {"CPR_TC": 2 * p - bc, "CPR_PIVOT": p, "CPR_BC": bc}
    r = h - low
    if method == "camarilla":
        levels = [(c_ + r * 1.1 / d, c_ - r * 1.1 / d) for d in (12, 6, 4, 2)]
    elif method == "fibonacci":
        levels = [(p + r * f, p - r * f) for f in (0.382, 0.618, 1.0)]
    else:
        levels = [(2 * p - low, 2 * p - h), (p + r, p - r)]
        if method == "classic":
            levels += [(h + 2 * (p - low), low - 2 * (h - p)), (h + 3 * (p - low), low - 3 * (h - p))]
    for k, (up, down) in enumerate(levels, 1):
        out |= {f"CPR_R{k}": up, f"CPR_S{k}": down}
    return out


@op(CAT)
def cpr(open_, high, low, close, method="classic", levels="standard", width_analysis=True, price_position=True, virgin_cpr=False, lookforward=5):
    """Of daily bars: the period before is the row before. For longer periods see ``operators.cpr``."""
    out = pivot_levels(method, lag(open_), lag(high), lag(low), lag(close))
    top, bottom, pivot = out["CPR_TC"], out["CPR_BC"], out["CPR_PIVOT"]
    if width_analysis:
        pct = 100 * abs(top - bottom) / pivot
        out |= {"CPR_WIDTH": top - bottom, "CPR_WIDTH_PCT": pct, "CPR_WIDTH_CLASS": when(pct < 0.5, -1, when(pct > 1.5, 1, 0))}
    hi, lo = greatest(top, bottom), -greatest(-top, -bottom)
    if price_position:
        out["CPR_POSITION"] = when(close > hi, 1, when(close < lo, -1, 0))
    if virgin_cpr:
        touched = [(lag(high, -k) >= lo) & (lag(low, -k) <= hi) for k in range(1, lookforward + 1)]
        whole = prior("count", close, 1, lookforward, lookforward).notnull() & pivot.notnull()
        any_ = touched[0]
        for t in touched[1:]:
            any_ = any_ | t
        out["CPR_VIRGIN"] = flag(whole & ~any_)
    return out
