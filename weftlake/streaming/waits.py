"""Streams of fetches that keep a host's delay: state by host, nothing else held."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_package


def turns(fetches: DataFrame, delay_ms: int = 1000) -> DataFrame:
    """When each of a stream's ``fetches (host string, url string, at bigint)`` may be made: ``host, url, at, due``.

    ``at`` are the milliseconds at which a fetch was asked for.  It is due then,
    or once the delay has gone by since the host's fetch before it was due.
    The last due time of each host is the state; fetches of one batch go in
    order of time and url.  Rows with a null host or time are left out.
    """
    ship_package(fetches.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["at", "url"], na_position="first")
        due = []
        for at in rows["at"]:
            last = int(at) if last is None else max(int(at), last + delay_ms)
            due.append(last)
        state.update((last,))
        yield rows.assign(due=due)[["host", "url", "at", "due"]]

    named = fetches.select("host", "url", "at").where("host is not null and at is not null")
    return named.groupBy("host").applyInPandasWithState(
        run, "host string, url string, at bigint, due bigint", "last bigint", "append", GroupStateTimeout.NoTimeout
    )
