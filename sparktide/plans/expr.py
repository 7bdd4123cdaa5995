"""Expressions over ordered series, and their two renderings.

An indicator is an expression tree over the columns of a bar table. The tree is
rendered as Spark columns (``plan``) and as ANSI SQL (``sql``). Rendering works
by levels: a window or recursive node is computed one level above its inputs.
All window nodes of a level share one select, so that a request of any number of
indicators costs one exchange and one sort by ``(by, ts)``. The recursive nodes
of a level share one grouped map.

Nulls: arithmetic with a null is null, a division by zero is null, conditions
that are null are false. NaN never enters: sources turn it into null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 2.220446049250313e-16
#: Name of the hidden column with a row's number within its key, from 1.
ROW = "_row"


class E:
    """A node: an operator, child nodes and plain parameters."""

    __slots__ = ("op", "args", "params", "key", "level")

    def __init__(self, op: str, args: Iterable[Any] = (), *params: Any):
        self.op, self.params = op, params
        self.args = tuple(wrap(a) for a in args)
        self.key = f"{op}({','.join(a.key for a in self.args)};{params!r})"
        below = max((a.level for a in self.args), default=0)
        self.level = below + 1 if op in WINDOWED or op == "rec" else below

    def __add__(self, o):
        return E("+", (self, o))

    def __radd__(self, o):
        return E("+", (o, self))

    def __sub__(self, o):
        return E("-", (self, o))

    def __rsub__(self, o):
        return E("-", (o, self))

    def __mul__(self, o):
        return E("*", (self, o))

    def __rmul__(self, o):
        return E("*", (o, self))

    def __truediv__(self, o):
        return E("/", (self, o))

    def __rtruediv__(self, o):
        return E("/", (o, self))

    def __neg__(self):
        return E("neg", (self,))

    def __abs__(self):
        return E("abs", (self,))

    def __gt__(self, o):
        return E(">", (self, o))

    def __ge__(self, o):
        return E(">=", (self, o))

    def __lt__(self, o):
        return E("<", (self, o))

    def __le__(self, o):
        return E("<=", (self, o))

    def eq(self, o):
        return E("=", (self, o))

    def ne(self, o):
        return E("<>", (self, o))

    def __and__(self, o):
        return E("and", (self, o))

    def __or__(self, o):
        return E("or", (self, o))

    def __invert__(self):
        return E("not", (E("coalesce", (self, E("false"))),))

    def isnull(self):
        return E("isnull", (self,))

    def notnull(self):
        return E("notnull", (self,))

    def shift(self, n: int = 1):
        return lag(self, n)

    def diff(self, n: int = 1):
        return self - lag(self, n)


WINDOWED = frozenset("lag row roll cum before wsum arg last next first rows".split())


def wrap(x: Any) -> E:
    if isinstance(x, E):
        return x
    if isinstance(x, bool):
        return E("true" if x else "false")
    if x is None:
        return E("null")
    return E("lit", (), float(x))


def col(name: str) -> E:
    return E("col", (), name)


def lag(x: Any, n: int = 1) -> E:
    """n rows earlier; later if n is negative."""
    return wrap(x) if n == 0 else E("lag", (x,), n)


def row() -> E:
    return E("row")


def rows() -> E:
    """Number of rows of the key."""
    return E("rows")


def roll(kind: str, x: Any, n: int, *more: Any, least: int | None = None) -> E:
    """Aggregate of the last n rows; null unless n values (``least``) are there."""
    return E("roll", (x, *(m for m in more if isinstance(m, E))), kind, n, n if least is None else least, *(m for m in more if not isinstance(m, E)))


def prior(kind: str, x: Any, first: int, last: int, least: int = 1) -> E:
    """Aggregate of the rows from ``first`` to ``last`` relative to this one."""
    return E("before", (x,), kind, first, last, least)


def cum(kind: str, x: Any, part: Any = None) -> E:
    """Running aggregate from the key's first row, or the first of its part."""
    return E("cum", (x,) if part is None else (x, part), kind)


def wsum(x: Any, weights: Iterable[float]) -> E:
    """Weighted sum of the last rows; weights from the oldest to the newest."""
    return E("wsum", (x,), tuple(float(w) for w in weights))


def since(x: Any, n: int, kind: str, recent: bool = True) -> E:
    """Rows since the largest or least of the last n values, of equal ones the
    most recent or the oldest."""
    return E("arg", (x, row()), kind, n, recent)


def last_value(x: Any) -> E:
    """The last value so far that is not null."""
    return E("last", (x,))


def next_value(x: Any) -> E:
    """This value, or the next one that is not null."""
    return E("next", (x,))


def first_value(x: Any) -> E:
    """The value of the key's first row."""
    return E("first", (x,))


def when(cond: E, then: Any, other: Any = None) -> E:
    return E("when", (cond, then, other))


def coalesce(*xs: Any) -> E:
    return E("coalesce", xs)


def greatest(*xs: Any) -> E:
    return E("greatest", xs)


def least(*xs: Any) -> E:
    return E("least", xs)


def fn(name: str, *xs: Any) -> E:
    return E("fn", xs, name)


def sqrt(x: Any) -> E:
    return when(wrap(x) >= 0, fn("sqrt", x))


def ln(x: Any) -> E:
    return when(wrap(x) > 0, fn("ln", x))


def log10(x: Any) -> E:
    return when(wrap(x) > 0, fn("log10", x))


def sign(x: Any) -> E:
    x = wrap(x)
    return when(x > 0, 1, when(x < 0, -1, when(x.notnull(), 0)))


def nonzero(x: Any) -> E:
    """A range of which zeros become the machine epsilon."""
    x = wrap(x)
    return when(x.eq(0), EPS, x)


def linear(a: Any, b: Any, seed: Any) -> E:
    """``y = seed`` where that is not null, else ``a * y' + b``; a null b keeps y'."""
    return E("rec", (a, b, seed), "linear", 0)


def recursive(kernel: str, inputs: Iterable[Any], output: int = 0, **params: Any) -> E:
    """An output of a kernel of ``operators.kernels``."""
    return E("rec", inputs, kernel, output, tuple(sorted(params.items())))


def walk(roots: Iterable[E]) -> dict[str, E]:
    """All nodes by key, children first."""
    out: dict[str, E] = {}
    stack = [(r, False) for r in roots]
    while stack:
        node, done = stack.pop()
        if node.key in out:
            continue
        if done:
            out[node.key] = node
        else:
            stack.append((node, True))
            stack.extend((a, False) for a in node.args)
    return out


# --- Spark -----------------------------------------------------------------

SCALAR: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "neg": lambda a: -a, "abs": F.abs,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a, "isnull": lambda a: a.isNull(), "notnull": lambda a: a.isNotNull(),
    "coalesce": F.coalesce, "greatest": F.greatest, "least": F.least, "when": lambda c, a, b: F.when(c, a).otherwise(b),
    "true": lambda: F.lit(True), "false": lambda: F.lit(False), "null": lambda: F.lit(None).cast("double"),
}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{n: getattr(F, n) for n in "sqrt ln log10 exp sin cos tan asin acos atan sinh cosh tanh degrees radians".split()},
    "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "rint": F.rint, "pow": F.pow,
    "round8": lambda x: F.round(x, 8), "day": lambda x: F.date_trunc("day", x), "week": lambda x: F.date_trunc("week", x), "month": lambda x: F.date_trunc("month", x),
}
AGGREGATES: dict[str, Callable[..., Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp, "var_pop": F.var_pop, "var_samp": F.var_samp,
    "count": F.count, "corr": F.corr, "covar_samp": F.covar_samp, "skew": F.skewness, "kurt": F.kurtosis, "quantile": lambda x, q: F.percentile(x, F.lit(q)),
}


class Planner:
    """Renders expressions over ``df``, ordered by ``ts`` within ``by``."""

    def __init__(self, df: DataFrame, by: list[str], ts: list[str]):
        self.df, self.by, self.ts = df, by, ts
        self.names: dict[str, str] = {}

    def spec(self):
        return (Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))).orderBy(*self.ts)

    def column(self, e: E) -> Column:
        if e.key in self.names:
            return F.col(self.names[e.key])
        if e.op == "lit":
            return F.lit(e.params[0])
        if e.op == "col":
            return F.col(f"`{e.params[0]}`")
        args = [self.column(a) for a in e.args]
        return FUNCTIONS[e.params[0]](*args) if e.op == "fn" else SCALAR[e.op](*args)

    def windowed(self, e: E) -> Column:
        w, args = self.spec(), [self.column(a) for a in e.args]
        if e.op == "lag":
            return F.lag(args[0], e.params[0]).over(w) if e.params[0] > 0 else F.lead(args[0], -e.params[0]).over(w)
        if e.op == "row":
            return F.row_number().over(w).cast("double")
        if e.op == "rows":
            return F.count("*").over(Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))).cast("double")
        if e.op == "roll":
            kind, n, floor, *more = e.params
            frame = w.rowsBetween(1 - n, 0)
            own = AGGREGATES[kind](*args, *more).over(frame)
            full = F.count(args[0]).over(frame) >= floor
            for other in args[1:]:
                full = full & (F.count(other).over(frame) >= floor)
            own = own.cast("double")
            if kind in ("corr", "skew", "kurt", "stddev_samp", "stddev_pop", "var_pop", "var_samp", "covar_samp"):
                own = F.nanvl(own, F.lit(None).cast("double"))
            return F.when(full, own)
        if e.op == "before":
            kind, first, last, floor = e.params
            frame = w.rowsBetween(first, last)
            return F.when(F.count(args[0]).over(frame) >= floor, AGGREGATES[kind](args[0]).over(frame).cast("double"))
        if e.op == "cum":
            if len(args) > 1:
                w = Window.partitionBy(*self.by, args[1]).orderBy(*self.ts)
            own = AGGREGATES[e.params[0]](args[0]).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
            return own if e.params[0] == "count" else F.when(args[0].isNotNull(), own)
        if e.op == "wsum":
            weights = e.params[0]
            total = None
            for k, weight in enumerate(weights):
                back = len(weights) - 1 - k
                term = (F.lag(args[0], back).over(w) if back else args[0]) * F.lit(weight)
                total = term if total is None else total + term
            return total
        if e.op == "arg":
            kind, n, recent = e.params
            frame = w.rowsBetween(1 - n, 0)
            x, r = args
            tie = r if recent == (kind == "max") else -r
            best = (F.max if kind == "max" else F.min)(F.when(x.isNotNull(), F.struct(x.alias("x"), tie.alias("r")))).over(frame)
            return F.when(F.count(x).over(frame) == n, r - F.abs(best["r"]))
        if e.op == "last":
            return F.last(args[0], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if e.op == "next":
            return F.first(args[0], ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        if e.op == "first":
            return F.first(args[0]).over(w.rowsBetween(Window.unboundedPreceding, 0))
        raise ValueError(e.op)

    def read(self, roots: Iterable[E]) -> list[E]:
        """The columns, given or computed so far, that the nodes read."""
        out, stack, seen = [], list(roots), set()
        while stack:
            e = stack.pop()
            if e.key in seen:
                continue
            seen.add(e.key)
            if e.key in self.names or e.op == "col":
                out.append(e)
            else:
                stack.extend(e.args)
        return out

    def plan(self, outputs: dict[str, E], keep: list[str]) -> DataFrame:
        """``keep`` and the outputs; one select per level, one grouped map per level with recursions."""
        nodes = walk(outputs.values())
        df = self.df
        for level in range(1, max((e.level for e in outputs.values()), default=0) + 1):
            own = [e for e in nodes.values() if e.level == level and e.key not in self.names]
            windows, recs = [e for e in own if e.op in WINDOWED], [e for e in own if e.op == "rec"]
            if windows:
                new = {f"_w{len(self.names) + i}": self.windowed(e) for i, e in enumerate(windows)}
                df = df.select("*", *(c.alias(n) for n, c in new.items()))
                self.names |= {e.key: n for e, n in zip(windows, new)}
            if recs:
                from ..operators.kernels import grouped

                inputs = {a.key: a for e in recs for a in e.args}
                named = {k: f"_x{len(self.names)}_{i}" for i, k in enumerate(inputs)}
                wide = df.select("*", *(self.column(a).cast("double").alias(named[k]) for k, a in inputs.items()))
                # Only what is still read goes through the map.
                later = [*outputs.values(), *(a for e in nodes.values() if e.level >= level and e not in recs for a in e.args)]
                used = {e.key: e for e in self.read(later)}
                read = {self.names[k] if k in self.names else e.params[0] for k, e in used.items() if k in self.names or e.op == "col"}
                wide = wide.select(*(f"`{c}`" for c in wide.columns if c in read or c in named.values() or c in keep or c in self.by or c in self.ts))
                steps = [(f"_r{len(self.names) + i}", e.params[0], e.params[1], dict(e.params[2]) if len(e.params) > 2 else {}, [named[a.key] for a in e.args]) for i, e in enumerate(recs)]
                df = grouped(wide, self.by, self.ts, steps, list(named.values()))
                self.names |= {e.key: s[0] for e, s in zip(recs, steps)}
        return df.select(*keep, *(self.column(e).alias(n) for n, e in outputs.items()))


# --- SQL -------------------------------------------------------------------


class Unexpressed(Exception):
    """A node without a rendering as SQL."""


def number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)" if not math.isinf(x) else f"CAST('{x}' AS DOUBLE)"


SQL_AGGREGATES = {"skew": "skewness", "kurt": "kurtosis"}
SQL_FUNCTIONS = {"ceil": "ceil", "floor": "floor", "rint": "round_even({}, 0)", "day": "date_trunc('day', {})", "week": "date_trunc('week', {})", "month": "date_trunc('month', {})", "round8": "round({}, 8)"}


class Writer:
    """Renders expressions as one SQL statement over a bar query."""

    def __init__(self, bars: str, by: list[str], ts: list[str]):
        self.bars, self.by, self.ts = bars, by, ts
        self.names: dict[str, str] = {}

    def text(self, e: E) -> str:
        if e.key in self.names:
            return self.names[e.key]
        if e.op == "lit":
            return number(e.params[0])
        if e.op == "col":
            return f'"{e.params[0]}"'
        a = [self.text(x) for x in e.args]
        if e.op in ("+", "-", "*", ">", ">=", "<", "<=", "=", "<>"):
            return f"({a[0]} {e.op} {a[1]})"
        if e.op in ("and", "or"):
            return f"({a[0]} {e.op.upper()} {a[1]})"
        if e.op == "/":
            return f"({a[0]} / nullif({a[1]}, 0))"
        if e.op == "fn":
            form = SQL_FUNCTIONS.get(e.params[0], e.params[0])
            return form.format(*a) if "{" in form else f"{form}({', '.join(a)})"
        return {
            "neg": lambda: f"(-{a[0]})", "abs": lambda: f"abs({a[0]})", "not": lambda: f"(NOT {a[0]})", "isnull": lambda: f"({a[0]} IS NULL)", "notnull": lambda: f"({a[0]} IS NOT NULL)",
            "coalesce": lambda: f"coalesce({', '.join(a)})", "greatest": lambda: f"greatest({', '.join(a)})", "least": lambda: f"least({', '.join(a)})",
            "when": lambda: f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END", "true": lambda: "TRUE", "false": lambda: "FALSE", "null": lambda: "CAST(NULL AS DOUBLE)",
        }[e.op]()

    def over(self, frame: str = "", part: str = "", order: bool = True) -> str:
        by = ", ".join([f'"{b}"' for b in self.by] + ([part] if part else []))
        return f"OVER (PARTITION BY {by or '1'}" + (f" ORDER BY {', '.join(self.ts)}" if order else "") + (f" ROWS BETWEEN {frame}" if frame else "") + ")"

    def windowed(self, e: E) -> str:
        a = [self.text(x) for x in e.args]
        if e.op == "lag":
            return f"{'lag' if e.params[0] > 0 else 'lead'}({a[0]}, {abs(e.params[0])}) {self.over()}"
        if e.op == "row":
            return f"CAST(row_number() {self.over()} AS DOUBLE)"
        if e.op == "rows":
            return f"CAST(count(*) {self.over(order=False)} AS DOUBLE)"
        if e.op == "roll":
            kind, n, floor, *more = e.params
            frame = self.over(f"{n - 1} PRECEDING AND CURRENT ROW")
            if kind in ("skew", "kurt"):  # of the population, from sums of powers about the window's mean
                raise Unexpressed(kind)
            own = f"quantile_cont({a[0]}, {more[0]})" if kind == "quantile" else f"{kind}({', '.join(a)})"
            full = " AND ".join(f"count({x}) {frame} >= {floor}" for x in a)
            return f"CASE WHEN {full} THEN CAST({own} {frame} AS DOUBLE) END"
        if e.op == "before":
            kind, first, last, floor = e.params
            side = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k else "CURRENT ROW"
            frame = self.over(f"{side(first)} AND {side(last)}")
            return f"CASE WHEN count({a[0]}) {frame} >= {floor} THEN CAST({kind}({a[0]}) {frame} AS DOUBLE) END"
        if e.op == "cum":
            frame = self.over("UNBOUNDED PRECEDING AND CURRENT ROW", a[1] if len(a) > 1 else "")
            own = f"CAST({e.params[0]}({a[0]}) {frame} AS DOUBLE)"
            return own if e.params[0] == "count" else f"CASE WHEN {a[0]} IS NOT NULL THEN {own} END"
        if e.op == "wsum":
            weights = e.params[0]
            return " + ".join((f"lag({a[0]}, {len(weights) - 1 - k}) {self.over()}" if k < len(weights) - 1 else a[0]) + f" * {number(w)}" for k, w in enumerate(weights))
        if e.op == "arg":
            kind, n, recent = e.params
            frame = self.over(f"{n - 1} PRECEDING AND CURRENT ROW")
            tie = a[1] if recent == (kind == "max") else f"-{a[1]}"
            return f"CASE WHEN count({a[0]}) {frame} = {n} THEN {a[1]} - abs(({kind}(CASE WHEN {a[0]} IS NOT NULL THEN {{'x': {a[0]}, 'r': {tie}}} END) {frame}).r) END"
        if e.op == "last":
            return f"last_value({a[0]} IGNORE NULLS) {self.over('UNBOUNDED PRECEDING AND CURRENT ROW')}"
        if e.op == "next":
            return f"first_value({a[0]} IGNORE NULLS) {self.over('CURRENT ROW AND UNBOUNDED FOLLOWING')}"
        if e.op == "first":
            return f"first_value({a[0]}) {self.over('UNBOUNDED PRECEDING AND CURRENT ROW')}"
        raise Unexpressed(e.op)

    def recursion(self, e: E, name: str, parts: list[str], at: str) -> str:
        """Adds a kernel's recursion; kernels with equal inputs share one."""
        from .recursions import RECURSIONS

        kind, output, *more = e.params
        form = RECURSIONS[kind](**dict(more[0] if more else ())) if kind in RECURSIONS else None
        if form is None:
            raise Unexpressed(kind)
        first, then, shown = form
        key = f"{kind}{more}{[a.key for a in e.args]}"
        if key not in self.names:
            by = ", ".join(f'"{k}"' for k in self.by)
            mine = ", ".join(f'i."{k}"' for k in self.by)
            on = " AND ".join(f'i."{k}" = q."{k}"' for k in self.by)
            inputs = ", ".join(f"CAST({self.text(a)} AS DOUBLE) AS x{k}" for k, a in enumerate(e.args))
            state = list(dict.fromkeys([*first, *then]))
            row = lambda own: ", ".join(f"{own[s]} AS n_{s}" if s in own else f"NULL AS n_{s}" for s in [*own, *(x for x in state if x not in own)])
            names = ", ".join(f"n_{s} AS {s}" for s in state)
            parts.append(f"{name}i AS MATERIALIZED (SELECT {by}, {ROW} AS r, {inputs} FROM {at})")
            parts.append(
                f"{name} AS (SELECT {by}, r, {names} FROM (SELECT {mine}, i.r, {row(first)} FROM {name}i i WHERE i.r = 1) UNION ALL "
                f"SELECT {by}, r, {names} FROM (SELECT {mine}, i.r, {row(then)} FROM {name} q JOIN {name}i i ON {on} AND i.r = q.r + 1))"
            )
            columns = ", ".join(f"CAST(q.{s} AS DOUBLE) AS {name}_{s}" for s in dict.fromkeys(shown))
            parts.append(f"s{len(parts)} AS MATERIALIZED (SELECT i.*, {columns} FROM {at} i JOIN {name} q ON {on} AND i.{ROW} = q.r)")
            self.names[key], at = name, f"s{len(parts) - 1}"
        self.names[e.key] = f"{self.names[key]}_{shown[output]}"
        return at

    def sql(self, outputs: dict[str, E], keep: list[str], shown: Callable[[str], str] = lambda x: x) -> str:
        nodes = walk(outputs.values())
        row_number = f"row_number() {self.over()}"
        parts, at = [f"s0 AS MATERIALIZED (SELECT *, {row_number} AS {ROW} FROM ({self.bars}))"], "s0"
        for level in range(1, max((e.level for e in outputs.values()), default=0) + 1):
            own = [e for e in nodes.values() if e.level == level]
            windows, recs = [e for e in own if e.op in WINDOWED], [e for e in own if e.op == "rec"]
            if windows:
                new = {f"w{len(self.names) + i}": self.windowed(e) for i, e in enumerate(windows)}
                parts.append(f"s{len(parts)} AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS {n}' for n, x in new.items())} FROM {at})")
                self.names |= {e.key: n for e, n in zip(windows, new)}
                at = f"s{len(parts) - 1}"
            for e in recs:
                name = f"r{len(self.names)}"
                if e.params[0] != "linear":
                    at = self.recursion(e, name, parts, at)
                    continue
                a, b, seed = (self.text(x) for x in e.args)
                by = ", ".join(f'"{k}"' for k in self.by)
                on = " AND ".join(f'i."{k}" = q."{k}"' for k in self.by)
                parts.append(f"{name}i AS MATERIALIZED (SELECT {by}, {ROW}, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, CAST({seed} AS DOUBLE) AS c FROM {at})")
                step = "CASE WHEN i.c IS NOT NULL THEN i.c WHEN i.b IS NULL OR i.a IS NULL THEN q.y ELSE i.a * q.y + i.b END"
                parts.append(f"{name} AS (SELECT {by}, {ROW}, c AS y FROM {name}i WHERE {ROW} = 1 UNION ALL SELECT {', '.join(f'i."{k}"' for k in self.by)}, i.{ROW}, {step} FROM {name} q JOIN {name}i i ON {on} AND i.{ROW} = q.{ROW} + 1)")
                parts.append(f"s{len(parts)} AS MATERIALIZED (SELECT i.*, q.y AS {name}y FROM {at} i JOIN {name} q ON {on} AND i.{ROW} = q.{ROW})")
                self.names[e.key] = f"{name}y"
                at = f"s{len(parts) - 1}"
        columns = [f'"{k}"' for k in keep] + [f'{shown(self.text(e))} AS "{n}"' for n, e in outputs.items()]
        return f"WITH RECURSIVE {', '.join(parts)} SELECT {', '.join(columns)} FROM {at}"
