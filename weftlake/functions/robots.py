"""Rules of robots files."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F


class Robots(NamedTuple):
    """Rules in order as (allow, prefix), and the delay between fetches in ms (-1: none)."""

    rules: tuple[tuple[bool, str], ...] = ()
    delay_ms: int = -1

    def allows(self, path: str | None) -> bool:
        """The first rule whose prefix fits decides; none allows."""
        return next((allow for allow, prefix in self.rules if (path or "/").startswith(prefix)), True)


def parse_robots(body: str | None, agent: str) -> Robots:
    """Rules for ``agent``: those of its own group, else of ``*``.

    Of several agent lines in a row only the last one gets the rules; ``#``
    starts a comment; an empty Disallow allows everything from there on; of
    several delays the longest counts.
    """
    groups: dict[str, list[tuple[str, str]]] = {}
    current = None
    for line in (body or "").split("\n"):
        name, colon, value = line.partition("#")[0].strip().partition(":")
        if not colon:
            continue
        name, value = name.lower(), value.strip()
        if name == "user-agent":
            current = groups.setdefault(value.lower(), [])
        elif current is not None:
            current.append((name, value))
    rules, delay = [], -1
    for name, value in groups.get(agent.lower(), groups.get("*", [])):
        if name in ("allow", "disallow"):
            rules.append((name == "allow" or not value, value))
        elif name == "crawl-delay":
            try:
                delay = max(delay, int(float(value) * 1000 + 0.5))
            except (ValueError, OverflowError):
                continue
    return Robots(tuple(rules), delay)


def robots_allow(agent: str):
    """Column function ``(body, path) -> boolean`` for one agent; each distinct body is parsed once a batch."""

    @F.pandas_udf("boolean")
    def allow(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for body, path in pairs:
            parsed = {b: parse_robots(b, agent) for b in body.unique()}
            yield pd.Series([parsed[b].allows(p) for b, p in zip(body, path)])

    return allow


def robots_delay(agent: str):
    """Column function ``body -> bigint``: the delay in ms, -1 without one."""

    @F.pandas_udf("bigint")
    def delay(body: pd.Series) -> pd.Series:
        parsed = {b: parse_robots(b, agent).delay_ms for b in body.unique()}
        return body.map(parsed)

    return delay
