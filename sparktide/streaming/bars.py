"""Bars and indicators over streams of ticks.

Bars close behind a watermark. Recursive averages keep their few scalars per
key in a state store; row windows keep the last bars of a key, since ordered
row frames do not exist on streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_bars(ticks: DataFrame, by: list[str], ts: str, price: str, volume: str | None = None, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars; a bar is final once the watermark has passed its end."""
    size = F.sum(volume) if volume else F.count("*")
    out = ticks.withWatermark(ts, late).groupBy(*by, F.window(ts, width).alias("w")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), size.cast("double").alias("volume"),
    )
    return out.select(*by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def streaming_averages(bars: DataFrame, by: str, length: int = 10, kind: str = "ema") -> DataFrame:
    """``by, ts, close, value``: a moving average of each key's bars.

    ``ema`` and ``rma`` are seeded by the mean of the first ``length`` closes,
    ``sma`` is the mean of the last ``length``. State: a count, the value and
    for ``sma`` the last closes. Bars of a batch are taken in time order.
    """
    k = 2 / (length + 1) if kind == "ema" else 1 / length

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value, tail = state.get if state.exists else (0, 0.0, [])
        tail = list(tail)
        rows = pd.concat(list(batches)).sort_values("ts")
        out: list[Any] = []
        for x in rows["close"].tolist():
            n += 1
            if kind == "sma":
                tail = [*tail, x][-length:]
                out.append(sum(tail) / length if n >= length else None)
            elif n <= length:
                value += x / length
                out.append(value if n == length else None)
            else:
                value += k * (x - value)
                out.append(value)
        state.update((n, value, tail))
        yield pd.DataFrame({by: key[0], "ts": rows["ts"].to_numpy(), "close": rows["close"].to_numpy(), "value": pd.array(out, "Float64")})

    schema = f"{by} {dict(bars.dtypes)[by]}, ts timestamp, close double, value double"
    return bars.groupBy(by).applyInPandasWithState(step, schema, "n long, value double, tail array<double>", "append", GroupStateTimeout.NoTimeout)
