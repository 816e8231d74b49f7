"""Token buckets: refill by elapsed time up to a burst, a token for each admitted call, in event order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA = "key long, at double, admitted boolean, tokens double"
STATE = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("at", T.DoubleType())])


def refill(tokens: float, elapsed: float, rate: float, burst: float) -> float:
    return min(burst, tokens + max(0.0, elapsed) * rate)


def admit(calls: DataFrame, rate: float, burst: float) -> DataFrame:
    """key, at, admitted, tokens of a stream of calls (key, at seconds); state is one bucket for each key."""

    def step(key, frames: Iterator[pd.DataFrame], state):
        tokens, last = state.get if state.exists else (burst, None)
        for frame in frames:
            rows = []
            for at in sorted(frame["at"]):
                tokens = refill(tokens, 0.0 if last is None else at - last, rate, burst)
                last = at
                ok = tokens >= 1
                tokens -= ok
                rows.append((key[0], at, ok, tokens))
            yield pd.DataFrame(rows, columns=["key", "at", "admitted", "tokens"])
        state.update((tokens, last))

    return calls.groupBy("key").applyInPandasWithState(step, SCHEMA, STATE, "append", "NoTimeout")
