"""Indicator definitions; importing this package registers them all."""

from . import candles, mathops, momentum, overlap, statistics, trend, volatility, volume  # noqa: F401
