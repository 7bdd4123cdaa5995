"""Candle patterns and candle transforms.

A pattern is a few statements about a few bars. ``Bar`` gives a bar's shape
relative to what was usual before it; the patterns read like their published
definitions.
"""

from __future__ import annotations

from ..plans.expr import E, coalesce, greatest, lag, least, prior, recursive, roll, row, when, wrap
from ..plans.expr import linear as _linear
from ..plans.registry import op, register
from . import common as c

CAT = "candles"

#: Usual sizes (fixed values): of what, over how many bars before, by what factor.
SIZES = {
    "BL": ("rb", 10, 1.0), "BS": ("rb", 10, 1.0), "BD": ("hl", 10, 0.1), "SL": ("rb", 0, 1.0), "SVL": ("rb", 0, 2.0), "SS": ("shadows", 10, 0.5),
    "SVS": ("hl", 10, 0.1), "NR": ("hl", 5, 0.2), "FR": ("hl", 5, 0.6), "EQ": ("hl", 5, 0.05),
}


class Candle:
    """Derived series of the bars, each built once per request."""

    def __init__(self, o: E, h: E, low: E, close: E):
        bh, bl = when(close >= o, close, o), when(close >= o, o, close)
        self.series = {"O": o, "H": h, "L": low, "C": close, "rb": abs(close - o), "bh": bh, "bl": bl, "us": h - bh, "ls": bl - low, "col": when(close >= o, 1, -1), "hl": h - low, "shadows": (h - bh) + (bl - low)}

    def at(self, name: str, k: int = 0) -> E:
        return lag(self.series[name], -k)

    def avg(self, size: str, k: int = 0) -> E:
        of, n, factor = SIZES[size]
        return factor * self.at(of, k) if n == 0 else prior("sum", self.series[of], k - n, k - 1, n) * (factor / n)

    def bars(self, n: int) -> list[Bar]:
        """The last n bars, the oldest first."""
        return [Bar(self, k) for k in range(1 - n, 1)]


class Bar:
    """The bar at k: prices, shape, and how it compares with the usual sizes."""

    def __init__(self, candle: Candle, k: int):
        self.candle, self.k = candle, k
        at = candle.at
        self.open, self.high, self.low, self.close = (at(n, k) for n in "OHLC")
        self.body, self.top, self.bottom, self.upper, self.lower, self.color, self.range = (at(n, k) for n in ("rb", "bh", "bl", "us", "ls", "col", "hl"))

    def usual(self, size: str) -> E:
        return self.candle.avg(size, self.k)

    white = property(lambda b: b.color.eq(1))
    black = property(lambda b: b.color.eq(-1))
    long = property(lambda b: b.body > b.usual("BL"))
    short = property(lambda b: b.body < b.usual("BS"))
    not_long = property(lambda b: b.body <= b.usual("BS"))
    not_short = property(lambda b: b.body > b.usual("BS"))
    doji = property(lambda b: b.body <= b.usual("BD"))
    no_upper = property(lambda b: b.upper < b.usual("SVS"))
    no_lower = property(lambda b: b.lower < b.usual("SVS"))
    some_upper = property(lambda b: b.upper > b.usual("SVS"))
    some_lower = property(lambda b: b.lower > b.usual("SVS"))
    long_upper = property(lambda b: b.upper > b.usual("SL"))
    long_lower = property(lambda b: b.lower > b.usual("SL"))
    huge_upper = property(lambda b: b.upper > b.usual("SVL"))
    huge_lower = property(lambda b: b.lower > b.usual("SVL"))

    def same_color(self, o: Bar) -> E:
        return self.color.eq(o.color)

    def other_color(self, o: Bar) -> E:
        return self.color.eq(-o.color)

    def gaps_above(self, o: Bar) -> E:
        """Its body lies above the other's."""
        return self.bottom > o.top

    def gaps_below(self, o: Bar) -> E:
        return self.top < o.bottom

    def within(self, x: E, size: str, of: E) -> E:
        """x is as close to ``of`` as this bar's usual size."""
        d = self.usual(size)
        return (x <= of + d) & (x >= of - d)


def both(*conditions: E) -> E:
    out = conditions[0]
    for cond in conditions[1:]:
        out = out & cond
    return out


def result(name: str, first: int, value: E, scalar: float) -> dict[str, E]:
    """Nothing before the first bar that has enough before it."""
    return {f"CDL_{name.upper()}": when(row() > first, coalesce(value, 0) * (scalar / 100), 0)}


def pattern(first: int, bars: int, value=100, depth: float | None = None):
    """Registers a pattern. The function gets its bars, the oldest first, and
    returns a condition, or (condition, value)."""

    def add(fn):
        name = fn.__name__.strip("_")

        def build(candle, scalar, *more):
            found = fn(*candle.bars(bars), *more)
            cond, size = found if isinstance(found, tuple) else (found, wrap(value))
            return result(name, first, when(cond, size, 0), scalar)

        def plain(open_, high, low, close, scalar=100):
            return build(Candle(open_, high, low, close), scalar)

        def deep(open_, high, low, close, penetration=depth, scalar=100):
            return build(Candle(open_, high, low, close), scalar, penetration)

        register(f"cdl_{name}", CAT, plain if depth is None else deep)
        return fn

    return add


# --- one bar ---


@pattern(10, 1)
def belthold(a):
    return a.long & ((a.white & a.no_lower) | (a.black & a.no_upper)), a.color * 100


@pattern(10, 1)
def closingmarubozu(a):
    return a.long & ((a.white & a.no_upper) | (a.black & a.no_lower)), a.color * 100


@pattern(10, 1)
def dragonflydoji(a):
    return both(a.doji, a.no_upper, a.some_lower)


@pattern(10, 1)
def gravestonedoji(a):
    return both(a.doji, a.no_lower, a.some_upper)


@pattern(10, 1)
def highwave(a):
    return both(a.short, a.huge_upper, a.huge_lower), a.color * 100


@pattern(10, 1)
def longleggeddoji(a):
    return a.doji & (a.long_lower | a.long_upper)


@pattern(10, 1)
def longline(a):
    usual = a.usual("SS")
    return both(a.long, a.upper < usual, a.lower < usual), a.color * 100


@pattern(10, 1)
def shortline(a):
    usual = a.usual("SS")
    return both(a.short, a.upper < usual, a.lower < usual), a.color * 100


@pattern(10, 1)
def marubozu(a):
    return both(a.long, a.no_upper, a.no_lower), a.color * 100


@pattern(10, 1)
def rickshawman(a):
    middle, near = a.low + a.range / 2, a.usual("NR")
    return both(a.doji, a.long_lower, a.long_upper, a.bottom <= middle + near, a.top >= middle - near)


@pattern(10, 1)
def spinningtop(a):
    return both(a.short, a.upper > a.body, a.lower > a.body), a.color * 100


@pattern(10, 1)
def takuri(a):
    return both(a.doji, a.no_upper, a.huge_lower)


# --- two bars ---


@pattern(11, 2)
def counterattack(a, b):
    return both(b.other_color(a), a.long, b.long, a.within(b.close, "EQ", a.close)), b.color * 100


@pattern(11, 2, -100, depth=0.5)
def darkcloudcover(a, b, penetration):
    return both(a.white, a.long, b.black, b.open > a.high, b.close > a.open, b.close < a.close - a.body * penetration)


@pattern(11, 2)
def dojistar(a, b):
    return both(a.long, b.doji, (a.white & b.gaps_above(a)) | (a.black & b.gaps_below(a))), -a.color * 100


@pattern(11, 2)
def hammer(a, b):
    return both(b.short, b.long_lower, b.no_upper, b.bottom <= a.low + a.usual("NR"))


@pattern(11, 2, -100)
def hangingman(a, b):
    return both(b.short, b.long_lower, b.no_upper, b.bottom >= a.high - a.usual("NR"))


@pattern(11, 2)
def homingpigeon(a, b):
    return both(a.black, b.black, a.long, b.not_long, b.open < a.open, b.close > a.close)


@pattern(11, 2, -100)
def inneck(a, b):
    return both(a.black, a.long, b.white, b.open < a.low, b.close >= a.close, b.close <= a.close + a.usual("EQ"))


@pattern(11, 2)
def invertedhammer(a, b):
    return both(b.short, b.long_upper, b.no_lower, b.gaps_below(a))


@pattern(11, 2, -100)
def shootingstar(a, b):
    return both(b.short, b.long_upper, b.no_lower, b.gaps_above(a))


def _kicks(a, b):
    bare = [x for bar in (a, b) for x in (bar.long, bar.no_upper, bar.no_lower)]
    return both(b.other_color(a), *bare, (a.black & (b.low > a.high)) | (a.white & (b.high < a.low)))


@pattern(11, 2)
def kicking(a, b):
    return _kicks(a, b), b.color * 100


@pattern(11, 2)
def kickingbylength(a, b):
    return _kicks(a, b), when(b.body > a.body, b.color, a.color) * 100


@pattern(6, 2)
def matchinglow(a, b):
    return both(a.black, b.black, a.within(b.close, "EQ", a.close))


@pattern(11, 2, -100)
def onneck(a, b):
    return both(a.black, a.long, b.white, b.open < a.low, a.within(b.close, "EQ", a.close))


@pattern(11, 2)
def piercing(a, b):
    return both(a.black, a.long, b.white, b.long, b.open < a.low, b.close < a.open, b.close > a.close + a.body / 2)


@pattern(11, 2)
def separatinglines(a, b):
    return both(b.other_color(a), a.within(b.open, "EQ", a.open), b.long, (b.white & b.no_lower) | (b.black & b.no_upper)), b.color * 100


@pattern(11, 2, -100)
def thrusting(a, b):
    return both(a.black, a.long, b.white, b.open < a.low, b.close > a.close + a.usual("EQ"), b.close <= a.open - a.body / 2)


# --- three bars ---


@pattern(12, 3, -100)
def _2crows(a, b, d):
    return both(a.white, a.long, b.black, b.gaps_above(a), d.black, d.open < b.open, d.open > b.close, d.close > a.open, d.close < a.close)


@pattern(12, 3)
def _3inside(a, b, d):
    held = (b.top < a.top) & (b.bottom > a.bottom)
    turn = (a.white & d.black & (d.close < a.open)) | (a.black & d.white & (d.close > a.open))
    return both(a.long, b.not_long, held, turn), -a.color * 100


@pattern(3, 3)
def _3outside(a, b, d):
    up = both(a.black, b.white, b.open < a.close, b.close > a.open, d.close > b.close)
    down = both(a.white, b.black, b.open > a.close, b.close < a.open, d.close < b.close)
    return up | down, b.color * 100


@pattern(12, 3)
def _3starsinsouth(a, b, d):
    first = both(a.black, a.long, a.long_lower)
    second = both(b.black, b.body < a.body, b.open > a.close, b.open <= a.high, b.low < a.close, b.low >= a.low, b.some_lower)
    third = both(d.black, d.short, d.no_lower, d.no_upper, d.low > b.low, d.high < b.high)
    return both(first, second, third)


def _opens_in_or_near(b, a):
    return (b.open > a.open) & (b.open <= a.close + a.usual("NR"))


@pattern(12, 3)
def _3whitesoldiers(a, b, d):
    rise = both(b.close > a.close, d.close > b.close, _opens_in_or_near(b, a), _opens_in_or_near(d, b))
    steady = both(b.body > a.body - a.usual("FR"), d.body > b.body - b.usual("FR"), d.not_short)
    return both(*(x for bar in (a, b, d) for x in (bar.white, bar.no_upper)), rise, steady)


@pattern(12, 3, depth=0.3)
def abandonedbaby(a, b, d, penetration):
    top = both(a.white, d.black, d.close < a.close - a.body * penetration, b.low > a.high, d.high < b.low)
    floor = both(a.black, d.white, d.close > a.close + a.body * penetration, b.high < a.low, d.low > b.high)
    return both(a.long, b.doji, d.not_short, top | floor), d.color * 100


@pattern(12, 3, -100)
def advanceblock(a, b, d):
    rise = both(a.white, b.white, d.white, b.close > a.close, d.close > b.close, _opens_in_or_near(b, a), _opens_in_or_near(d, b))
    sound = a.long & (a.upper < a.usual("SS"))
    shrinks = d.body < b.body
    weak = (
        ((b.body < a.body - a.usual("FR")) & (d.body < b.body + b.usual("NR")))
        | (d.body < b.body - b.usual("FR"))
        | both(shrinks, b.body < a.body, (d.upper > d.usual("SS")) | (b.upper > b.usual("SS")))
        | (shrinks & d.long_upper)
    )
    return both(rise, sound, weak)


def _star(a, b, d, penetration, small, evening):
    if evening:
        return both(a.long, a.white, small, b.gaps_above(a), d.not_short, d.black, d.close < a.close - a.body * penetration)
    return both(a.long, a.black, small, b.gaps_below(a), d.not_short, d.white, d.close > a.close + a.body * penetration)


@pattern(12, 3, -100, depth=0.3)
def eveningdojistar(a, b, d, penetration):
    return _star(a, b, d, penetration, b.doji, True)


@pattern(12, 3, -100, depth=0.3)
def eveningstar(a, b, d, penetration):
    return _star(a, b, d, penetration, b.not_long, True)


@pattern(12, 3, depth=0.3)
def morningdojistar(a, b, d, penetration):
    return _star(a, b, d, penetration, b.doji, False)


@pattern(12, 3, depth=0.3)
def morningstar(a, b, d, penetration):
    return _star(a, b, d, penetration, b.not_long, False)


@pattern(7, 3)
def gapsidesidewhite(a, b, d):
    up, down = b.gaps_above(a) & d.gaps_above(a), b.gaps_below(a) & d.gaps_below(a)
    alike = both(b.white, d.white, b.within(d.body, "NR", b.body), b.within(d.open, "EQ", b.open))
    return (up | down) & alike, when(b.gaps_above(a), 100, -100)


@pattern(12, 3, -100)
def identical3crows(a, b, d):
    alike = both(a.within(b.open, "EQ", a.close), b.within(d.open, "EQ", b.close))
    return both(*(x for bar in (a, b, d) for x in (bar.black, bar.no_lower)), a.close > b.close, b.close > d.close, alike)


@pattern(12, 3, -100)
def stalledpattern(a, b, d):
    rise = both(a.white, b.white, d.white, b.close > a.close, d.close > b.close)
    return both(rise, a.long, b.long, b.no_upper, _opens_in_or_near(b, a), d.short, d.open >= b.close - d.body - b.usual("NR"))


@pattern(7, 3)
def sticksandwich(a, b, d):
    return both(a.black, b.white, d.black, b.low > a.close, a.within(d.close, "EQ", a.close))


@pattern(7, 3)
def tasukigap(a, b, d):
    alike = abs(b.body - d.body) < b.usual("NR")
    up = both(b.gaps_above(a), b.white, d.black, d.open < b.close, d.open > b.open, d.close < b.open, d.close > a.top)
    down = both(b.gaps_below(a), b.black, d.white, d.open < b.open, d.open > b.close, d.close > b.open, d.close < a.bottom)
    return (up | down) & alike, b.color * 100


@pattern(12, 3)
def tristar(a, b, d):
    usual = a.usual("BD")
    dojis = both(a.body <= usual, b.body <= usual, d.body <= usual)
    down = both(b.gaps_above(a), d.top < b.top)
    up = both(b.gaps_below(a), d.bottom > b.bottom)
    return dojis & (up | down), when(up, 100, -100)


@pattern(12, 3)
def unique3river(a, b, d):
    return both(a.long, a.black, b.black, b.close > a.close, b.open <= a.open, b.low < a.low, d.short, d.white, d.open > b.low)


@pattern(12, 3, -100)
def upsidegap2crows(a, b, d):
    return both(a.white, a.long, b.black, b.not_long, b.gaps_above(a), d.black, d.open > b.open, d.close < b.close, d.close > a.close)


@pattern(2, 3)
def xsidegap3methods(a, b, d):
    fills = both(d.open < b.top, d.open > b.bottom, d.close < a.top, d.close > a.bottom)
    gap = (a.white & b.gaps_above(a)) | (a.black & b.gaps_below(a))
    return both(a.same_color(b), d.other_color(b), fills, gap), a.color * 100


# --- four and five bars ---


@pattern(13, 4, -100)
def _3blackcrows(z, a, b, d):
    crows = both(*(x for bar in (a, b, d) for x in (bar.black, bar.no_lower)))
    steps = both(b.open < a.open, b.open > a.close, d.open < b.open, d.open > b.close)
    return both(z.white, crows, steps, z.high > a.close, a.close > b.close, b.close > d.close)


@pattern(8, 4)
def _3linestrike(a, b, d, e):
    opens_near = lambda y, x: (y.open >= x.bottom - x.usual("NR")) & (y.open <= x.top + x.usual("NR"))
    up = both(d.white, d.close > b.close, b.close > a.close, e.open > d.close, e.close < a.open)
    down = both(d.black, d.close < b.close, b.close < a.close, e.open < d.close, e.close > a.open)
    return both(a.same_color(b), b.same_color(d), e.other_color(d), opens_near(b, a), opens_near(d, b), up | down), d.color * 100


@pattern(13, 4)
def concealbabyswall(a, b, d, e):
    bare = [x for bar in (a, b) for x in (bar.no_lower, bar.no_upper)]
    return both(*(x.black for x in (a, b, d, e)), *bare, d.gaps_below(b), d.some_upper, d.high > b.close, e.high > d.high, e.low < d.low)


@pattern(14, 5)
def breakaway(a, b, d, e, f):
    lower = both(d.high < b.high, d.low < b.low, e.high < d.high, e.low < d.low)
    higher = both(d.high > b.high, d.low > b.low, e.high > d.high, e.low > d.low)
    down = both(a.black, b.gaps_below(a), lower, f.close > b.open, f.close < a.close)
    up = both(a.white, b.gaps_above(a), higher, f.close < b.open, f.close > a.close)
    return both(a.long, a.same_color(b), b.same_color(e), e.other_color(f), down | up), f.color * 100


@pattern(14, 5)
def ladderbottom(a, b, d, e, f):
    falls = both(a.open > b.open, b.open > d.open, a.close > b.close, b.close > d.close)
    return both(*(x.black for x in (a, b, d, e)), falls, e.some_upper, f.white, f.open > e.open, f.close > e.high)


@pattern(14, 5, depth=0.5)
def mathold(a, b, d, e, f, penetration):
    floor = a.close - a.body * penetration
    sizes = both(a.long, b.short, d.short, e.short, a.white, b.black, f.white)
    back = both(b.gaps_above(a), *(x for bar in (d, e) for x in (bar.bottom < a.close, bar.bottom > floor)), d.top < b.open, e.top < d.top)
    return both(sizes, back, f.open > e.close, f.close > greatest(b.high, d.high, e.high))


@pattern(14, 5)
def risefall3methods(a, b, d, e, f):
    sizes = both(a.long, b.short, d.short, e.short, f.long)
    colors = both(b.other_color(a), b.same_color(d), d.same_color(e), f.other_color(e))
    held = both(*(x for bar in (b, d, e) for x in (bar.bottom < a.high, bar.top > a.low)))
    s = a.color  # against the first bar, then on beyond it
    back = both(d.close * s < b.close * s, e.close * s < d.close * s, f.open * s > e.close * s, f.close * s > a.close * s)
    return both(sizes, colors, held, back), s * 100


@op(CAT)
def cdl_engulfing(open_, high, low, close, scalar=100):
    k = Candle(open_, high, low, close).at
    bull = k("col").eq(1) & k("col", -1).eq(-1) & (((k("C") >= k("O", -1)) & (k("O") < k("C", -1))) | ((k("C") > k("O", -1)) & (k("O") <= k("C", -1))))
    bear = k("col").eq(-1) & k("col", -1).eq(1) & (((k("O") >= k("C", -1)) & (k("C") < k("O", -1))) | ((k("O") > k("C", -1)) & (k("C") <= k("O", -1))))
    size = when(k("O").ne(k("C", -1)) & k("C").ne(k("O", -1)), 100, 80)
    return result("engulfing", 2, when(bull | bear, k("col") * size, 0), scalar)


def _harami(name, small, candle, scalar):
    k = candle.at
    base = (k("rb", -1) > candle.avg("BL", -1)) & (k("rb") <= candle.avg(small, 0))
    inside = (k("bh") < k("bh", -1)) & (k("bl") > k("bl", -1))
    touching = (k("bh") <= k("bh", -1)) & (k("bl") >= k("bl", -1))
    return result(name, 11, when(base & inside, -k("col", -1) * 100, when(base & touching, -k("col", -1) * 80, 0)), scalar)


@op(CAT)
def cdl_harami(open_, high, low, close, scalar=100):
    return _harami("harami", "BS", Candle(open_, high, low, close), scalar)


@op(CAT)
def cdl_haramicross(open_, high, low, close, scalar=100):
    return _harami("haramicross", "BD", Candle(open_, high, low, close), scalar)


@op(CAT)
def cdl_hikkake(open_, high, low, close, scalar=100):
    h, lo = high, low
    inside = (lag(h) < lag(h, 2)) & (lag(lo) > lag(lo, 2))
    sign = when(inside & (h < lag(h)) & (lo < lag(lo)), 1, when(inside & (h > lag(h)) & (lo > lag(lo)), -1, 0))
    return result("hikkake", 4, recursive("hikkake", (high, low, close, sign)), scalar)


@op(CAT)
def cdl_hikkakemod(open_, high, low, close, scalar=100):
    candle = Candle(open_, high, low, close)
    k, near = candle.at, candle.avg("NR", -2)
    inside = (k("H", -2) < k("H", -3)) & (k("L", -2) > k("L", -3)) & (k("H", -1) < k("H", -2)) & (k("L", -1) > k("L", -2))
    up = inside & (k("H") < k("H", -1)) & (k("L") < k("L", -1)) & (k("C", -2) <= k("L", -2) + near)
    down = inside & (k("H") > k("H", -1)) & (k("L") > k("L", -1)) & (k("C", -2) >= k("H", -2) - near)
    return result("hikkakemod", 9, recursive("hikkake", (high, low, close, when(up, 1, when(down, -1, 0)))), scalar)


@op(CAT)
def cdl_doji(open_, high, low, close, length=10, factor=10, scalar=100):
    body, usual = abs(close - open_), lag(roll("avg", c.nonzero_range(high, low), length))
    return {f"CDL_DOJI_{length}_{0.01 * factor}": when(body < 0.01 * factor * usual, scalar, 0)}


@op(CAT)
def cdl_inside(open_, high, low, close, asbool=False):
    inside = (high < lag(high)) & (low > lag(low))
    return {"CDL_INSIDE": when(inside, 1 if asbool else when(close >= open_, 1, -1), 0)}


@op(CAT)
def cdl_pattern(open_, high, low, close, name="all", scalar=100):
    """Several patterns at once; they share their windows."""
    from ..plans.registry import OPS

    all_ = sorted(n.removeprefix("cdl_") for n in OPS if n.startswith("cdl_") and n not in ("cdl_pattern", "cdl_z"))
    names = all_ if name == "all" else [name] if isinstance(name, str) else list(name)
    out: dict[str, E] = {}
    for n in names:
        out |= OPS[f"cdl_{n}"].build(open_, high, low, close)
    return out


@op(CAT)
def cdl_z(open_, high, low, close, length=30, ddof=1):
    z = lambda x: (x - roll("avg", x, length)) / roll("stddev_samp", x, length)
    return {f"{n}_Z_{length}_{ddof}": z(x) for n, x in (("open", open_), ("high", high), ("low", low), ("close", close))}


@op(CAT)
def ha(open_, high, low, close):
    mid = c.ohlc4(open_, high, low, close)
    first = _linear(0.5, 0.5 * lag(mid), when(row().eq(1), 0.5 * (open_ + close)))
    return {"HA_open": first, "HA_high": greatest(high, first, mid), "HA_low": least(low, first, mid), "HA_close": mid}
