"""Streaming forms: windows over event time, and stateful onset de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(rows: DataFrame, time: str, width: str, keys: list[str], late: str | None = "1 hour", slide: str | None = None, value: str = "value") -> DataFrame:
    """(keys, window, n, mean) per window; late: how long rows may be late in a stream."""
    rows = rows.withWatermark(time, late) if late else rows
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(*keys, w.alias("window")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], late: str | None = "1 hour") -> DataFrame:
    """Segments that end where no row comes for `gap`."""
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(*keys, F.session_window(time, gap).alias("window")).agg(F.count("*").alias("n"))


def min_gap_stream(onsets: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, onset_s) of a stream of (key long, onset_s double): each key's state is the last onset kept.
    Within a micro-batch a key's onsets are sorted; earlier ones than the state are dropped."""

    def keep(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for x in sorted(pd.concat(list(parts))["onset_s"]):
            if last is None or x - last >= gap:
                out.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "onset_s": out})

    return onsets.groupBy(key).applyInPandasWithState(keep, f"{key} long, onset_s double", "last double", "append", GroupStateTimeout.NoTimeout)
