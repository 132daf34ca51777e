"""Keyed state that windows can't express."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def item_counters(stream: DataFrame) -> DataFrame:
    """An item's running views, clicks and purchases with ctr and cvr, one row an event.

    State is three counters an item.  Events of a micro-batch are taken in time order; those of later batches follow.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        views, clicks, purchases = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows["views"] = views + (rows["action"] == "view").cumsum()
        rows["clicks"] = clicks + (rows["action"] == "click").cumsum()
        rows["purchases"] = purchases + (rows["action"] == "purchase").cumsum()
        state.update((int(rows["views"].iloc[-1]), int(rows["clicks"].iloc[-1]), int(rows["purchases"].iloc[-1])))
        rows["item_id"] = key[0]
        rows["ctr"] = (rows["clicks"] / rows["views"].where(rows["views"] > 0)).fillna(0.0)
        rows["cvr"] = (rows["purchases"] / rows["clicks"].where(rows["clicks"] > 0)).fillna(0.0)
        yield rows[["event_id", "item_id", "views", "clicks", "purchases", "ctr", "cvr"]]

    return stream.groupBy("item_id").applyInPandasWithState(
        step, "event_id long, item_id int, views long, clicks long, purchases long, ctr double, cvr double", "views long, clicks long, purchases long", "append", "NoTimeout"
    )
