"""Small driver-side helpers: weights, codes of averages, clocks."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from ..plans.expr import EPS
from .momentum import MATYPES

#: Hours from UTC (fixed values).
EXCHANGE_TZ = {
    "NZSX": 12, "ASX": 11, "TSE": 9, "HKE": 8, "SSE": 8, "SGX": 8, "NSE": 5.5, "DIFX": 4, "RTS": 3, "JSE": 2, "FWB": 1, "LSE": 1, "BMF": -2, "NYSE": -4, "TSX": -4,
}
#: Trading calendar (fixed values).
RATE = {
    "DAYS_PER_MONTH": 21, "MINUTES_PER_HOUR": 60, "MONTHS_PER_YEAR": 12, "QUARTERS_PER_YEAR": 4, "TRADING_DAYS_PER_YEAR": 252, "TRADING_HOURS_PER_DAY": 6.5, "WEEKS_PER_YEAR": 52, "YEARLY": 1,
}
#: Code of an average by name.
MA_CODES = {"sma": 0, "ema": 1, "wma": 2, "dema": 3, "tema": 4, "trima": 5, "kama": 6, "mama": 7, "t3": 8}


def ma_code(name: str) -> int:
    if not isinstance(name, str):
        raise TypeError("the name of an average is a string")
    if name.lower() not in MA_CODES:
        raise ValueError(f"no average {name!r}")
    return MA_CODES[name.lower()]


def combination(n: int = 1, r: int = 0, repetition: bool = False) -> int:
    n, r = abs(int(n)), abs(int(r))
    return math.comb(n + r - 1 if repetition else n, r)


def _shares(values: Sequence[float]) -> list[float]:
    total = sum(values)
    return [v / total for v in values] if total else list(values)


def fibonacci(n: int = 2, zero: bool = False, weighted: bool = False) -> list[float]:
    """The first n numbers from 1, or n + 1 from 0."""
    out, a, b = [], (0 if zero else 1), 1
    for _ in range(n + 1 if zero else n):
        out.append(a)
        a, b = b, a + b
    return _shares(out) if weighted else out


def pascals_triangle(n: int = 0, weighted: bool = False, inverse: bool = False) -> list[float] | None:
    row = [math.comb(abs(n), k) for k in range(abs(n) + 1)]
    if inverse:
        return [1 - w for w in _shares(row)] if weighted else None
    return _shares(row) if weighted else row


def symmetric_triangle(n: int = 2, weighted: bool = False) -> list[float] | None:
    row = [min(k, n + 1 - k) for k in range(1, abs(n) + 1)] if abs(n) > 1 else None
    return _shares(row) if weighted and row else row


def weights(w: Sequence[float]) -> Callable[[Sequence[float]], float]:
    return lambda x: sum(a * b for a, b in zip(w, x))


def zero(x: float) -> float:
    return 0 if abs(x) < EPS else x


def exchange_time(exchange: str = "NYSE", now: datetime | None = None) -> str:
    """The clock of an exchange as text."""
    now = (now or datetime.now(timezone.utc)).astimezone(timezone.utc) + timedelta(hours=EXCHANGE_TZ[exchange.upper()])
    return f"{now:%A %B} {now.day}, {now.year}, {exchange.upper()}: {now:%H:%M:%S}"


def elapsed(since: float) -> str:
    """Time since a ``time.perf_counter()`` as text."""
    took = time.perf_counter() - since
    return f"{took * 1000:.4f} ms ({took:.4f} s)"


__all__ = ["EXCHANGE_TZ", "MATYPES", "MA_CODES", "RATE", "combination", "elapsed", "exchange_time", "fibonacci", "ma_code", "pascals_triangle", "symmetric_triangle", "weights", "zero"]
