"""Recursive kernels as SQL: what a row's state is, given the row's inputs
``i.x0, i.x1, ...`` and the state ``q.*`` of the row before.

These are for comparison on an engine with recursive common table expressions.
A kernel yields first-row expressions, then-row expressions (in order: a later
one may use an earlier one by its name with ``n_`` before) and its outputs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

Recursion = tuple[dict[str, str], dict[str, str], list[str]]
NULL = "CAST(NULL AS DOUBLE)"


def mcginley(n: float, c: float) -> Recursion:
    step = f"CASE WHEN q.y IS NULL OR q.y = 0 THEN i.x0 ELSE q.y + (i.x0 - q.y) / greatest({c * n!r} * pow(i.x0 / q.y, 4), 1e-10) END"
    return {"y": "i.x0"}, {"y": step}, ["y"]


def _winters(na: float, nb: float, nc: float) -> tuple[dict[str, str], dict[str, str]]:
    def steps(f: str, v: str, a: str) -> dict[str, str]:
        return {
            "f": f"{1 - na!r} * ({f} + {v} + 0.5 * {a}) + {na!r} * i.x0", "v": f"{1 - nb!r} * ({v} + {a}) + {nb!r} * (n_f - {f})",
            "a": f"{1 - nc!r} * {a} + {nc!r} * (n_v - {v})", "y": "n_f + n_v + 0.5 * n_a",
        }

    return steps("i.x0", "0.0", "0.0"), steps("q.f", "q.v", "q.a")


def holt_winters(na: float, nb: float, nc: float) -> Recursion:
    return *_winters(na, nb, nc), ["y"]


def holt_winters_channel(na: float, nb: float, nc: float, nd: float, scalar: float) -> Recursion:
    first, then = _winters(na, nb, nc)
    band = lambda s: f"n_y {s} {scalar!r} * sqrt(n_w)"
    rest = {"up": band("+"), "low": band("-"), "x": "i.x0"}
    # w: the variance before this row, var: with the row before taken in
    return first | {"var": "0.0::DOUBLE", "w": "0.0::DOUBLE"} | rest, then | {"w": "q.var", "var": f"{1 - nd!r} * q.var + {nd!r} * pow(q.x - q.y, 2)"} | rest, ["y", "up", "low"]


def super_smoother(n: int, poles: int) -> Recursion | None:
    if poles != 2:
        return None
    x0 = math.pi * math.sqrt(2) / n
    a = math.exp(-x0)
    b = 2 * a * math.cos(x0)
    then = {"y": f"CASE WHEN q.z IS NULL THEN i.x0 ELSE {1 - b + a * a!r} * i.x0 + {b!r} * q.y - {a * a!r} * q.z END", "z": "q.y"}
    return {"y": "i.x0", "z": NULL}, then, ["y"]


def laguerre(gamma: float) -> Recursion:
    up = lambda a, b: f"greatest(n_{a} - n_{b}, 0)"
    total = {"u": " + ".join((up("l0", "l1"), up("l1", "l2"), up("l2", "l3"))), "d": " + ".join((up("l1", "l0"), up("l2", "l1"), up("l3", "l2"))), "y": "CASE WHEN n_u + n_d <> 0 THEN 100 * n_u / (n_u + n_d) ELSE 100 * n_u END"}
    g = repr(gamma)
    then = {"l0": f"{1 - gamma!r} * i.x0 + {g} * q.l0", "l1": f"-{g} * n_l0 + q.l0 + {g} * q.l1", "l2": f"-{g} * n_l1 + q.l1 + {g} * q.l2", "l3": f"-{g} * n_l2 + q.l2 + {g} * q.l3"}
    return {f"l{k}": "i.x0" for k in range(4)} | total, then | total, ["y"]


def fisher(n: int) -> Recursion:
    raw = f"CASE WHEN i.r > {n} THEN 0.66 * i.x0 + 0.67 * q.v ELSE 0 END"
    clip = "CASE WHEN n_w > 0.99 THEN 0.999 WHEN n_w < -0.99 THEN -0.999 ELSE n_w END"
    then = {"w": raw, "v": clip, "y": f"CASE WHEN i.r = {n} THEN 0 WHEN i.r > {n} THEN 0.5 * (ln((1 + n_v) / (1 - n_v)) + q.y) END"}
    return {"w": "0.0::DOUBLE", "v": "0.0::DOUBLE", "y": NULL}, then, ["y"]


def stochastic_pass(factor: float) -> Recursion:
    then = {"s": "CASE WHEN i.x3 > 0 AND i.x0 IS NOT NULL THEN 100 * (i.x0 - i.x1) / i.x2 ELSE q.s END", "y": f"round(q.y + {factor!r} * (n_s - q.y), 8)"}
    return {"s": "0.0::DOUBLE", "y": "0.0::DOUBLE"}, then, ["y"]


def supertrend() -> Recursion:
    up, low = "i.x0 + i.x1", "i.x0 - i.x1"
    then = {
        "f": "CASE WHEN i.x2 > q.up OR i.x2 < q.low THEN 1 ELSE 0 END", "d": "CASE WHEN i.x2 > q.up THEN 1.0 WHEN i.x2 < q.low THEN -1.0 ELSE q.d END",
        "low": f"CASE WHEN n_f = 0 AND n_d > 0 AND {low} < q.low THEN q.low ELSE {low} END", "up": f"CASE WHEN n_f = 0 AND n_d < 0 AND {up} > q.up THEN q.up ELSE {up} END",
        "long": "CASE WHEN n_d > 0 THEN n_low END", "short": "CASE WHEN n_d > 0 THEN NULL ELSE n_up END", "y": "coalesce(n_long, n_short)",
    }
    return {"f": "0", "d": "1.0::DOUBLE", "low": low, "up": up, "long": NULL, "short": NULL, "y": "0.0::DOUBLE"}, then, ["y", "d", "long", "short"]


def pmax() -> Recursion:
    up, down = "i.x0 - i.x1", "i.x0 + i.x1"
    then = {
        "up": f"CASE WHEN q.c > q.up AND q.up > {up} THEN q.up ELSE {up} END", "down": f"CASE WHEN q.c < q.down AND q.down < {down} THEN q.down ELSE {down} END",
        "d": "CASE WHEN i.x2 > q.down THEN 1 WHEN i.x2 < q.up THEN -1 ELSE q.d END", "c": "i.x2", "y": "CASE WHEN n_d = 1 THEN n_up ELSE n_down END",
    }
    return {"up": up, "down": down, "d": "1", "c": "i.x2", "y": NULL}, then, ["y"]


def hilo() -> Recursion:
    then = {
        "side": "CASE WHEN i.x0 > q.hi THEN 1 WHEN i.x0 < q.lo THEN -1 ELSE 0 END", "y": "CASE n_side WHEN 1 THEN i.x2 WHEN -1 THEN i.x1 ELSE q.y END",
        "long": "CASE WHEN n_side >= 0 THEN n_y END", "short": "CASE WHEN n_side <= 0 THEN n_y END", "hi": "i.x1", "lo": "i.x2",
    }
    return {"side": "0", "y": NULL, "long": NULL, "short": NULL, "hi": "i.x1", "lo": "i.x2"}, then, ["y", "long", "short"]


def even_better_sine(n: int, bars: int) -> Recursion:
    angle = 360 / n
    alpha = (1 - math.sin(angle)) / math.cos(angle)
    a = math.exp(-math.sqrt(2) * math.pi / bars)
    b = 2 * a * math.cos(math.sqrt(2) * 180 / bars)
    c1 = 1 - b + a * a
    on = f"i.r > {n}"
    then = {
        "hp": f"CASE WHEN {on} THEN {0.5 * (1 + alpha)!r} * (i.x0 - q.x) + {alpha!r} * q.hp ELSE 0 END", "f": f"CASE WHEN {on} THEN {c1!r} * (n_hp + q.hp) / 2 + {b!r} * q.f - {a * a!r} * q.g ELSE 0 END",
        "g": "q.f", "x": f"CASE WHEN {on} THEN i.x0 ELSE 0 END", "p": "(n_f * n_f + q.f * q.f + q.g * q.g) / 3",
        "y": f"CASE WHEN i.r = {n} THEN 0 WHEN {on} THEN CASE WHEN n_p > 0 THEN (n_f + q.f + q.g) / 3 / sqrt(n_p) ELSE 0 END END",
    }
    zero = "0.0::DOUBLE"
    return {"hp": zero, "f": zero, "g": zero, "x": zero, "p": zero, "y": NULL}, then, ["y"]


def parabolic(af0: float, af: float, max_af: float) -> Recursion:
    h, lo = "i.x0", "i.x1"
    first = {"fall": "0", "s": "i.x2", "e": NULL, "a": f"{af0!r}::DOUBLE", "rev": "0", "y": NULL, "h1": h, "l1": lo, "h2": h, "l2": lo}
    # At the second row the side and the extreme follow from the first two rows.
    then = {
        "fall0": f"CASE WHEN i.r = 2 THEN CASE WHEN q.l1 - {lo} > {h} - q.h1 AND q.l1 - {lo} > 0 THEN 1 ELSE 0 END ELSE q.fall END",
        "e0": f"CASE WHEN i.r = 2 THEN CASE WHEN n_fall0 = 1 THEN {lo} ELSE {h} END ELSE q.e END",
        "raw": "q.s + q.a * (n_e0 - q.s)", "new": f"CASE WHEN n_fall0 = 1 THEN {lo} < n_e0 ELSE {h} > n_e0 END",
        "e1": f"CASE WHEN n_new THEN CASE WHEN n_fall0 = 1 THEN {lo} ELSE {h} END ELSE n_e0 END", "a1": f"CASE WHEN n_new THEN least(q.a + {af0!r}, {max_af!r}) ELSE q.a END",
        "bound": "CASE WHEN n_fall0 = 1 THEN greatest(q.h1, q.h2, n_raw) ELSE least(q.l1, q.l2, n_raw) END", "rev": f"CASE WHEN n_fall0 = 1 THEN CAST({h} > n_bound AS INT) ELSE CAST({lo} < n_bound AS INT) END",
        "s": "CASE WHEN n_rev = 1 THEN n_e1 ELSE n_bound END", "a": f"CASE WHEN n_rev = 1 THEN {af0!r} ELSE n_a1 END", "fall": "CASE WHEN n_rev = 1 THEN 1 - n_fall0 ELSE n_fall0 END",
        "e": f"CASE WHEN n_rev = 1 THEN CASE WHEN n_fall = 1 THEN {lo} ELSE {h} END ELSE n_e1 END", "y": "n_s", "h1": h, "l1": lo, "h2": "q.h1", "l2": "q.l1",
    }
    del af
    first |= {k: NULL for k in ("fall0", "e0", "raw", "e1", "a1", "bound")} | {"new": "FALSE"}
    first |= {"long": NULL, "short": NULL}
    then |= {"long": "CASE WHEN n_y < i.x2 THEN n_y END", "short": "CASE WHEN n_y >= i.x2 THEN n_y END"}
    return first, then, ["long", "short", "a", "rev"]


def qqe() -> Recursion:
    ub, lb = "i.x0 + i.x1", "i.x0 - i.x1"
    zero = "0.0::DOUBLE"
    then = {
        "long": f"CASE WHEN q.z > q.long AND i.x0 > q.long THEN CASE WHEN {lb} > q.long THEN {lb} ELSE q.long END ELSE {lb} END",
        "short": f"CASE WHEN q.z < q.short AND i.x0 < q.short THEN CASE WHEN {ub} < q.short THEN {ub} ELSE q.short END ELSE {ub} END",
        "up": "(i.x0 > q.short AND q.z < q.short1) OR (i.x0 <= q.short AND q.z >= q.short1)", "down": "(i.x0 > q.long AND q.z < q.long1) OR (i.x0 <= q.long AND q.z >= q.long1)",
        "trend": "CASE WHEN n_up THEN 1.0 WHEN n_down THEN -1.0 ELSE q.trend END", "lo": "CASE WHEN n_trend = 1 THEN n_long END", "hi": "CASE WHEN n_trend = 1 THEN NULL ELSE n_short END",
        "y": "CASE WHEN n_trend = 1 THEN n_long ELSE n_short END", "z": "i.x0", "long1": "q.long", "short1": "q.short",
    }
    first = {"long": zero, "short": zero, "up": "FALSE", "down": "FALSE", "trend": "1.0::DOUBLE", "lo": NULL, "hi": NULL, "y": "i.x0", "z": "i.x0", "long1": zero, "short1": zero}
    return first, then, ["y", "lo", "hi", "long", "short", "trend"]


def hikkake() -> Recursion:
    """Inputs: high, low, close, sign of a setup."""
    setup = "i.x3 IS NOT NULL AND i.x3 <> 0"
    first = {"sign": "0.0::DOUBLE", "at": "-10", "hh": NULL, "ll": NULL, "hit": "FALSE", "y": "0.0::DOUBLE", "h1": "i.x0", "l1": "i.x1"}
    then = {
        "hit": f"NOT ({setup}) AND q.sign <> 0 AND i.r <= q.at + 3 AND ((q.sign > 0 AND i.x2 > q.hh) OR (q.sign < 0 AND i.x2 < q.ll))",
        "y": f"CASE WHEN {setup} THEN 100 * i.x3 WHEN n_hit THEN 200 * q.sign ELSE 0 END", "sign": f"CASE WHEN {setup} THEN i.x3 WHEN n_hit THEN 0 ELSE q.sign END",
        "at": f"CASE WHEN {setup} THEN i.r ELSE q.at END", "hh": f"CASE WHEN {setup} THEN q.h1 ELSE q.hh END", "ll": f"CASE WHEN {setup} THEN q.l1 ELSE q.ll END", "h1": "i.x0", "l1": "i.x1",
    }
    return first, then, ["y"]


def rsx(n: int) -> Recursion:
    on, f88, f18 = f"i.r > {n}", float(max(n - 1, 5)), 3.0 / (n + 2.0)
    f20 = 1 - f18
    then = {"go": f"{on} AND q.f90 = 0", "f90a": f"CASE WHEN NOT ({on}) THEN 0 WHEN n_go THEN 1 WHEN {f88} <= q.f90 THEN {f88 + 1} ELSE q.f90 + 1 END", "f8": "100 * i.x0"}
    kept = lambda name, value: f"CASE WHEN {on} AND NOT n_go THEN {value} ELSE q.{name} END"
    for side, value in (("a", "(n_f8 - q.f8)"), ("b", "abs(n_f8 - q.f8)")):
        for k in range(3):
            p, r = f"{side}{2 * k}", f"{side}{2 * k + 1}"
            then[p] = kept(p, f"{f20!r} * q.{p} + {f18!r} * {value}")
            then[r] = kept(r, f"{f18!r} * n_{p} + {f20!r} * q.{r}")
            value = f"(1.5 * n_{p} - 0.5 * n_{r})"
        then[f"v{side}"] = kept(f"v{side}", value)
    then["f0"] = f"CASE WHEN NOT ({on}) OR n_go THEN 0 WHEN {f88} >= n_f90a AND n_f8 <> q.f8 THEN 1 ELSE q.f0 END"
    then["f90"] = f"CASE WHEN {on} AND NOT n_go AND {f88} = n_f90a AND n_f0 = 0 THEN 0 ELSE n_f90a END"
    then["y"] = f"CASE WHEN i.r = {n} THEN 0 WHEN {on} THEN CASE WHEN {f88} < n_f90 AND n_vb > 1e-10 THEN least(greatest(50 * (n_va / n_vb + 1), 0), 100) ELSE 50 END END"
    first = {k: "0.0::DOUBLE" for k in then} | {"go": "FALSE", "y": NULL, "f8": "100 * i.x0"}
    return first, then, ["y"]


def parabolic_extended(start: float, offset: float, init_long: float, step_long: float, max_long: float, init_short: float, step_short: float, max_short: float) -> Recursion:
    h, lo = "i.x0", "i.x1"
    by_side = lambda short, long: f"CASE WHEN n_fall0 = 1 THEN {short} ELSE {long} END"
    s0 = repr(start) if start else "CASE WHEN n_fall0 = 1 THEN q.h1 ELSE q.l1 END"
    second = lambda value, other: f"CASE WHEN i.r = 2 THEN {value} ELSE {other} END"
    then = {
        "fall0": second(f"CASE WHEN q.l1 - {lo} > {h} - q.h1 AND q.l1 - {lo} > 0 THEN 1 ELSE 0 END", "q.fall"), "s0": second(s0, "q.s"), "e0": second(by_side(lo, h), "q.e"),
        "a0": second(by_side(repr(init_short), repr(init_long)), "q.a"), "raw": "n_s0 + n_a0 * (n_e0 - n_s0)", "turn": by_side(f"CAST({h} > n_raw AS INT)", f"CAST({lo} < n_raw AS INT)"),
        "new": by_side(f"{lo} < n_e0", f"{h} > n_e0"), "e1": f"CASE WHEN n_new THEN {by_side(lo, h)} ELSE n_e0 END",
        "a1": f"CASE WHEN n_new THEN {by_side(f'least(n_a0 + {step_short!r}, {max_short!r})', f'least(n_a0 + {step_long!r}, {max_long!r})')} ELSE n_a0 END",
        "bound": by_side("greatest(q.h1, q.h2, n_raw)", "least(q.l1, q.l2, n_raw)"), "s": f"CASE WHEN n_turn = 1 THEN n_bound * (1 + {by_side(repr(offset), repr(-offset))}) ELSE n_bound END",
        "fall": "CASE WHEN n_turn = 1 THEN 1 - n_fall0 ELSE n_fall0 END", "e": f"CASE WHEN n_turn = 1 THEN CASE WHEN n_fall = 1 THEN {lo} ELSE {h} END ELSE n_e1 END",
        "a": f"CASE WHEN n_turn = 1 THEN CASE WHEN n_fall = 1 THEN {init_short!r} ELSE {init_long!r} END ELSE n_a1 END", "y": "CASE WHEN n_fall = 1 THEN -n_s ELSE n_s END",
        "h1": h, "l1": lo, "h2": "q.h1", "l2": "q.l1",
    }
    first = {k: NULL for k in then} | {"new": "FALSE", "turn": "0", "fall": "0", "fall0": "0", "h1": h, "l1": lo, "h2": h, "l2": lo}
    return first, then, ["y"]


RECURSIONS: dict[str, Callable[..., Recursion | None]] = {
    f.__name__: f for f in (mcginley, holt_winters, holt_winters_channel, super_smoother, laguerre, fisher, stochastic_pass, supertrend, pmax, hilo, even_better_sine, parabolic, qqe, hikkake, rsx, parabolic_extended)
}
