"""Arithmetic and elementary functions."""

from __future__ import annotations

from ..plans.expr import E, fn, ln as _ln, log10 as _log10, roll, since, sqrt as _sqrt, when
from ..plans.registry import op, register

CAT = "math"
PLAIN = {"atan": "ATAN", "ceil": "CEIL", "cos": "COS", "cosh": "COSH", "exp": "EXP", "floor": "FLOOR", "sin": "SIN", "sinh": "SINH", "tan": "TAN", "tanh": "TANH", "todeg": "TODEG", "torad": "TORAD", "npround": "ROUND"}
RENAMED = {"todeg": "degrees", "torad": "radians", "npround": "rint"}

for _name, _shown in PLAIN.items():
    register(_name, CAT, lambda close, _n=_name, _s=_shown: {_s: fn(RENAMED.get(_n, _n), close)})


def _inside(x: E, f: str) -> E:
    return when((x >= -1) & (x <= 1), fn(f, when((x >= -1) & (x <= 1), x)))


@op(CAT)
def acos(close):
    return {"ACOS": _inside(close, "acos")}


@op(CAT)
def asin(close):
    return {"ASIN": _inside(close, "asin")}


@op(CAT)
def ln(close):
    return {"LN": _ln(close)}


@op(CAT)
def log10(close):
    return {"LOG10": _log10(close)}


@op(CAT)
def sqrt(close):
    return {"SQRT": _sqrt(close)}


@op(CAT)
def npabs(close):
    return {"ABS": abs(close)}


@op(CAT)
def trunc(close):
    return {"TRUNC": when(close < 0, fn("ceil", close), fn("floor", close))}


@op(CAT)
def add(series_a: E, series_b: E):
    return {"ADD": series_a + series_b}


@op(CAT)
def sub(series_a: E, series_b: E):
    return {"SUB": series_a - series_b}


@op(CAT)
def mult(series_a: E, series_b: E):
    return {"MULT": series_a * series_b}


@op(CAT)
def div(series_a: E, series_b: E):
    return {"DIV": series_a / series_b}


def _place(x: E, n: int, kind: str) -> E:
    """Place in the window, 0 for the oldest row; of equal values the oldest."""
    return n - 1 - since(x, n, kind, recent=False)


@op(CAT)
def maxindex(close, length=30):
    return {f"MAXINDEX_{length}": _place(close, length, "max")}


@op(CAT)
def minindex(close, length=30):
    return {f"MININDEX_{length}": _place(close, length, "min")}


@op(CAT)
def minmax(close, length=30):
    return {f"MIN_{length}": roll("min", close, length), f"MAX_{length}": roll("max", close, length)}


@op(CAT)
def minmaxindex(close, length=30):
    return {f"MINIDX_{length}": _place(close, length, "min"), f"MAXIDX_{length}": _place(close, length, "max")}


def _checked(length):
    if length <= 0:
        raise ValueError("length must be positive")
    return length


@op(CAT)
def rolling_max(close, length=30):
    return {f"MAX_{length}": roll("max", close, _checked(length))}


@op(CAT)
def rolling_min(close, length=30):
    return {f"MIN_{length}": roll("min", close, _checked(length))}


@op(CAT)
def rolling_sum(close, length=30):
    return {f"SUM_{length}": roll("sum", close, _checked(length))}


for _alias, _of in {"max": rolling_max, "min": rolling_min, "sum": rolling_sum}.items():
    register(_alias, "math aliases", _of)
