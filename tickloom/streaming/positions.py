"""The persistent-signal position as a stream: one small state a session.

Rows of a session must arrive in order of row_idx across micro-batches (within one they are
sorted); the state is the last signal, so it never grows with the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.quotes import KEY

_OUT = "stock_code string, date string, session int, row_idx long, position int"


def stream_positions(quotes: DataFrame, long_above: float, short_below: float) -> DataFrame:
    """(KEY, row_idx, position) of a streaming frame with KEY, row_idx, pred, ok."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("row_idx", kind="stable")
        usable = rows["ok"].fillna(False).astype(bool) & rows["pred"].notna()
        signal = pd.Series(float("nan"), index=rows.index)
        signal[usable & (rows["pred"] > long_above)] = 1
        signal[usable & (rows["pred"] < short_below)] = -1
        position = signal.ffill().fillna(held).astype("int32")
        state.update((int(position.iloc[-1]),))
        yield pd.DataFrame({**dict(zip(KEY, key, strict=True)), "row_idx": rows["row_idx"].to_numpy(), "position": position.to_numpy()})

    slim = quotes.select(*KEY, "row_idx", "pred", "ok")
    return slim.groupBy(*KEY).applyInPandasWithState(run, _OUT, "held int", "append", GroupStateTimeout.NoTimeout)
