"""Growth series as streams: windowed roll-ups under a watermark, and a carry-forward that keeps state by entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_totals(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "6 hours") -> DataFrame:
    """``start, end, rows, total`` of tumbling windows; rows later than ``late`` no longer count."""
    by = [F.window(time, width).alias("w"), *keys]
    return stream.withWatermark(time, late).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total")).select(*keys, "w.start", "w.end", "rows", "total")


def carried(stream: DataFrame, keys: list[str], order: str, value: str, valid: str) -> DataFrame:
    """``*keys, order, value, carried, status`` of every row: the largest valid value of its entity so far.

    Within a micro-batch rows are taken in order; a row that comes in a later batch than its successors sees their state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{order}` {kinds[order]}", f"`{value}` double", "carried double", "status string"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else 0.0
        for batch in batches:
            batch = batch.sort_values(order)
            out, status = [], []
            for v, ok in zip(batch[value], batch[valid], strict=True):
                if not ok:
                    status.append("frozen")
                elif pd.notna(v) and v > top:
                    top = float(v)
                    status.append("advanced")
                else:
                    status.append("retained")
                out.append(top)
            yield pd.DataFrame({**{k: batch[k] for k in keys}, order: batch[order], value: batch[value].astype(float), "carried": out, "status": status})
        state.update((top,))

    return stream.groupBy(*keys).applyInPandasWithState(step, fields, "top double", "append", GroupStateTimeout.NoTimeout)
