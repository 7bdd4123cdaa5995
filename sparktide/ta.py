"""The user's entry: indicators, strategies and chains over a bar table."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as _functions  # noqa: F401  # registers the indicators
from .operators import signals
from .plans.expr import E, Planner, Writer, coalesce, col, lag, last_value, next_value
from .plans.registry import OPS, Op, categories

#: Inputs by name where the bar table has another name for them.
ROLES = {"open_": "open", "ts": None}
#: Not part of the "all" and category strategies: they need further inputs or return other rows.
NOT_IN_STRATEGIES = frozenset("long_run short_run tsignals xsignals beta correl add sub mult div mavp td_seq ma".split())
#: Calls that take ``signal_indicators=True``: beginnings of the names of the results
#: that signals are about, and the usual thresholds.
OSCILLATOR = {"xa": 80, "xb": 20, "cross_values": False}
WITH_SIGNALS: dict[str, dict[str, dict[str, Any]]] = {
    "rsi": {"RSI_": OSCILLATOR}, "rsx": {"RSX_": OSCILLATOR}, "er": {"ER_": OSCILLATOR},
    "macd": {"MACDh_": {"xa": 0, "xb": None, "cross_values": True}, "MACD_": {"xa": 0, "xb": None, "cross_values": False}},
}
SIGNAL_PARAMETERS = ("signal_indicators", "xa", "xb", "xserie", "xserie_a", "xserie_b", "cross_values", "cross_series")


@dataclass
class Strategy:
    """A named list of indicator calls, each with ``kind`` and parameters."""

    name: str
    ta: list[dict[str, Any]] = field(default_factory=list)
    description: str = ""
    created: str = field(default_factory=lambda: time.strftime("%Y-%m-%d %H:%M:%S"))

    def __post_init__(self):
        if not isinstance(self.name, str) or not self.name:
            raise ValueError("a strategy needs a name")
        if any("kind" not in call for call in self.ta):
            raise ValueError("every call of a strategy needs a kind")


ALL_STRATEGY = Strategy("All", description="All indicators with their defaults")
COMMON_STRATEGY = Strategy("Common Price and Volume SMAs", [*({"kind": "sma", "length": n} for n in (10, 20, 50, 200)), {"kind": "sma", "close": "volume", "length": 20, "prefix": "VOL"}], "Common simple averages")


@dataclass(frozen=True)
class TA:
    """Indicators over ``df``: keys ``by``, order ``ts`` within a key.

    Without ``by`` the whole table is one key in one task. Methods return new
    objects: ``append=True`` adds columns, else the result has keys and outputs.
    """

    df: DataFrame
    by: tuple[str, ...] = ()
    ts: tuple[str, ...] = ("ts",)
    adjusted: str | None = None
    pending: tuple[tuple[str, E], ...] = ()

    def __post_init__(self):
        for name in ("by", "ts"):
            value = getattr(self, name)
            object.__setattr__(self, name, (value,) if isinstance(value, str) else tuple(value))

    # --- inputs ---

    def column(self, name: Any) -> E:
        """A column by exact name, else the first whose name starts so."""
        if isinstance(name, E):
            return name
        known = dict(self.pending)
        if name in known:
            return known[name]
        if name == "close" and self.adjusted:
            name = self.adjusted
        if name in self.df.columns:
            return col(name)
        for c in self.df.columns:
            if c.lower().startswith(str(name).lower()):
                return col(c)
        raise ValueError(f"no column like {name!r}")

    def outputs(self, kind: str, **params: Any) -> dict[str, E]:
        """Expressions of a call, by output name, with offset, fills and names."""
        kind = kind.lower()
        if kind not in OPS:
            raise ValueError(f"unknown indicator {kind!r}")
        op = OPS[kind]
        post = {k: params.pop(k) for k in ("offset", "fillna", "fill_method", "prefix", "suffix", "delimiter", "col_names", "col_numbers") if k in params}
        given: dict[str, Any] = {}
        for name in op.columns:
            default = ROLES.get(name, name)
            given[name] = self.column(params.pop(name, self.ts[0] if default is None else default))
        for name in op.optional:
            if params.get(name) is not None:
                given[name] = self.column(params.pop(name))
            params.pop(name, None)
            if name not in given and name in ("high", "low") and any(params.get(x) for x in ("refined", "thirds")):
                given[name] = self.column(name)
        asked = {k: params.pop(k) for k in SIGNAL_PARAMETERS if k in params} if kind in WITH_SIGNALS else {}
        unknown = set(params) - set(op.defaults)
        if unknown:
            raise TypeError(f"{kind}: unknown parameters {sorted(unknown)}")
        out = op.build(**given, **params)
        if asked.pop("signal_indicators", False):
            shift = {k: post.pop(k) for k in ("offset", "fillna", "fill_method") if k in post}
            out = finished(out, **shift)
            out |= self._signals(kind, out, shift.get("offset", 0), **asked)
        return finished(out, **post)

    def _signals(self, kind: str, out: dict[str, E], offset: int, xserie: Any = None, xserie_a: Any = None, xserie_b: Any = None, cross_series: bool = True, **asked: Any) -> dict[str, E]:
        """Signal columns about a call's results: thresholds, and series if given. They
        are told from the shifted results and shifted by the offset once more."""
        found: dict[str, E] = {}
        for nth, (start, usual) in enumerate(WITH_SIGNALS[kind].items()):
            name = next(n for n in out if n.replace("MACDAS", "MACD").startswith(start))
            own = usual | (asked if nth == 0 else {})  # thresholds given are those of the first
            found |= signals.signals(out[name], name, **own)
            for other, up in ((xserie if xserie_a is None else xserie_a, True), (xserie if xserie_b is None else xserie_b, False)):
                if other is not None and nth == 0:
                    names, series = (name, other if isinstance(other, str) else "series"), self.column(other)
                    side = signals.above if up else signals.below
                    found |= signals.cross(out[name], series, up, names) if cross_series else side(out[name], series, names)
        return {n: lag(e, offset) if offset else e for n, e in found.items()}

    # --- results ---

    def _planned(self, outputs: dict[str, E], keep: Iterable[str]) -> DataFrame:
        return Planner(self.df, list(self.by), list(self.ts)).plan(outputs, list(keep))

    def call(self, kind: str, append: bool = False, **params: Any) -> Any:
        out = self.outputs(kind, **params)
        return self.appended(out) if append else self._planned(out, [*self.by, *self.ts])

    __call__ = call

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in OPS:
            raise AttributeError(name)
        return lambda *args, **kw: self.call(name, **(dict(zip(OPS[name].defaults, args)) | kw))

    def appended(self, outputs: dict[str, E]) -> TA:
        """Adds columns; nothing is computed until ``frame`` is asked for."""
        clash = dict(self.pending)
        clash.update(outputs)
        return TA(self.df, self.by, self.ts, self.adjusted, tuple(clash.items()))

    @property
    def frame(self) -> DataFrame:
        """The table with all appended columns, from one plan."""
        names = dict(self.pending)
        return self._planned(names, [c for c in self.df.columns if c not in names]) if names else self.df

    def strategy(self, what: str | Strategy = "all", exclude: Iterable[str] = (), **shared: Any) -> TA:
        """All indicators, those of a category, or a strategy's calls; a call
        may use columns that an earlier one has added. One plan for all."""
        if isinstance(what, Strategy) and what.ta:
            calls = what.ta
        else:
            name = (what.name if isinstance(what, Strategy) else what).lower()
            if name != "all" and name not in categories():
                raise ValueError(f"no strategy {name!r}")
            names = [n for n, o in OPS.items() if name in ("all", o.category) and o.category != "math aliases"]
            calls = [{"kind": n} for n in names if n not in NOT_IN_STRATEGIES and n != "cdl_pattern"]
        now = self
        for call in calls:
            if call["kind"] not in set(exclude):
                params = {k: v for k, v in call.items() if k not in ("kind", "params")}
                now = now.appended(now.outputs(call["kind"], **(shared | params)))
        return now

    # --- information ---

    @staticmethod
    def indicators(exclude: Iterable[str] = ()) -> list[str]:
        return sorted(n for n in OPS if n not in set(exclude))

    @property
    def categories(self) -> list[str]:
        return list(categories())

    @property
    def datetime_ordered(self) -> bool:
        first = self.df.agg(F.min(self.ts[0]).alias("a"), F.max(self.ts[0]).alias("b")).first()
        return first["a"] is not None and first["a"] < first["b"]

    @property
    def reverse(self) -> DataFrame:
        return self.df.orderBy(*(F.desc(c) for c in (*self.by, *self.ts)))

    def constants(self, values: Iterable[float], append: bool = True) -> TA:
        """Adds a literal column for each value, or drops them again."""
        values = list(values)
        df = self.df.withColumns({f"{v}": F.lit(v) for v in values}) if append else self.df.drop(*(f"{v}" for v in values))
        return TA(df, self.by, self.ts, self.adjusted, self.pending)

    def to_utc(self, zone: str) -> TA:
        return TA(self.df.withColumns({c: F.to_utc_timestamp(c, zone) for c in self.ts}), self.by, self.ts, self.adjusted, self.pending)

    def help(self, kind: str | None = None) -> str:
        return ", ".join(self.indicators()) if kind is None else f"{kind}: inputs {OPS[kind].columns}, parameters {OPS[kind].defaults}"

    def sql(self, bars: str, kind: str, **params: Any) -> str:
        """The same call as ANSI SQL over a bar query, where SQL has it."""
        return Writer(bars, list(self.by), list(self.ts)).sql(self.outputs(kind, **params), [*self.by, *self.ts])


def finished(out: dict[str, E], offset: int = 0, fillna: float | None = None, fill_method: str | None = None, prefix: str = "", suffix: str = "", delimiter: str = "_", col_names: Any = None, col_numbers: Any = None) -> dict[str, E]:
    """Results after offset, fills, choice and renaming."""
    done = {}
    for name, e in out.items():
        e = lag(e, offset) if offset else e
        if fillna is not None:
            e = coalesce(e, fillna)
        if fill_method in ("ffill", "bfill"):
            e = last_value(e) if fill_method == "ffill" else next_value(e)
        done[delimiter.join(x for x in (prefix, name, suffix) if x)] = e
    if col_numbers is not None:
        names = list(done)
        done = {names[k]: done[names[k]] for k in col_numbers}
    if col_names is not None:
        names = [col_names] if isinstance(col_names, str) else list(col_names)
        if len(names) < len(done):
            raise ValueError("fewer names than results")
        done = dict(zip(names, done.values()))
    return done


def custom(name: str, build, category: str = "custom") -> Op:
    """Registers an indicator of one's own."""
    from .plans.registry import register

    register(name, category, build)
    return OPS[name]
