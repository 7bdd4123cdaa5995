"""Comparisons, crossings and signal bundles as expressions."""

from __future__ import annotations

from ..plans.expr import EPS, E, coalesce, lag, when, wrap


def zero(x: E) -> E:
    """x, or 0 if it is smaller than the machine epsilon."""
    return when(abs(x) < EPS, 0, x)


def _flag(cond: E, asint: bool) -> E:
    return when(cond, 1, 0) if asint else coalesce(cond, E("false"))


def _name(x) -> str:
    return f"{x}".replace(".", "_")


def above(a: E, b: E, names: tuple[str, str] = ("a", "b"), asint: bool = True) -> dict[str, E]:
    """Where a is not below b."""
    return {f"{names[0]}_A_{names[1]}": _flag(zero(a) >= zero(b), asint)}


def below(a: E, b: E, names: tuple[str, str] = ("a", "b"), asint: bool = True) -> dict[str, E]:
    return {f"{names[0]}_B_{names[1]}": _flag(zero(a) <= zero(b), asint)}


def above_value(a: E, value: float, name: str = "a", asint: bool = True) -> dict[str, E]:
    return above(a, wrap(value), (name, _name(value)), asint)


def below_value(a: E, value: float, name: str = "a", asint: bool = True) -> dict[str, E]:
    return below(a, wrap(value), (name, _name(value)), asint)


def crosses(a: E, b: E, up: bool = True) -> E:
    """Up: a above b now and below it one row before; else: neither of these two."""
    false = E("false")
    now, before = coalesce(zero(a) > zero(b), false), coalesce(lag(zero(a)) < lag(zero(b)), false)
    return now & before if up else ~now & ~before


def cross(a: E, b: E, up: bool = True, names: tuple[str, str] = ("a", "b"), asint: bool = True) -> dict[str, E]:
    return {f"{names[0]}_{'XA' if up else 'XB'}_{names[1]}": _flag(crosses(a, b, up), asint)}


def cross_value(a: E, value: float, up: bool = True, name: str = "a", asint: bool = True) -> dict[str, E]:
    return cross(a, wrap(value), up, (name, _name(value)), asint)


def signals(x: E, name: str, xa: float | None = None, xb: float | None = None, cross_values: bool = False, other: E | None = None, other_name: str = "b", cross_series: bool = False) -> dict[str, E]:
    """The usual columns about thresholds and a second series. Crossings of a
    threshold are told in both directions."""
    out: dict[str, E] = {}
    for value, side in ((xa, above_value), (xb, below_value)):
        if value is not None:
            out |= cross_value(x, value, True, name) | cross_value(x, value, False, name) if cross_values else side(x, value, name)
    if other is not None:
        names = (name, other_name)
        out |= cross(x, other, True, names) | cross(x, other, False, names) if cross_series else above(x, other, names) | below(x, other, names)
    return out


def candle_color(open_: E, close: E) -> E:
    return when(close >= open_, 1, -1)
