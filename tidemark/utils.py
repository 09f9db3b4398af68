"""Small helpers that run on the driver."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterable
from datetime import date, datetime, timedelta, timezone
from typing import Any

import yaml


class NonRetryable(RuntimeError):
    """A failure that another attempt would meet again."""


class Clock:
    """Timings by name; one for the process through Clock.shared()."""

    _shared: "Clock | None" = None

    def __init__(self) -> None:
        self._timings: dict[str, list[float]] = defaultdict(list)

    @classmethod
    def shared(cls) -> "Clock":
        cls._shared = cls._shared or cls()
        return cls._shared

    def add_timing(self, name: str, timing: float) -> None:
        self._timings[name].append(timing)

    def get_avg(self, name: str, window_size: int = 5) -> float:
        """Mean of the last window_size timings, 0 before any."""
        last = self._timings[name][-window_size:]
        return sum(last) / len(last) if last else 0.0

    def eta(self, name: str, count_remaining: int, window_size: int = 5) -> timedelta:
        return timedelta(seconds=self.get_avg(name, window_size) * count_remaining)


def load_yaml(filename: str) -> Any:
    """A YAML file with ${NAME} taken from the environment."""
    with open(filename, encoding="utf-8") as f:
        return yaml.safe_load(os.path.expandvars(f.read()))


def nested(tree: Any, path: str) -> Any:
    """The section at a dotted path."""
    for k in path.split("."):
        tree = tree[k]
    return tree


def strip_outer_quotes(s: str) -> str:
    """s without one pair of equal quotes around it."""
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"" else s


def is_text_type(t: str) -> bool:
    return t.upper().split("(")[0].strip() in ("CHAR", "VARCHAR", "TEXT", "TINYTEXT", "BLOB")


def as_sql_date(d: date) -> str:
    return d.strftime("%Y-%m-%d")


def as_sql_datetime(d: datetime) -> str:
    return d.strftime("%Y-%m-%d %H:%M:%S.%f")


def smallest_datetime() -> datetime:
    return datetime(1970, 1, 1, 0, 0, 1, tzinfo=timezone.utc)


def flatten_list(items: Iterable[Any]) -> list[Any]:
    """Nested lists as one."""
    out: list[Any] = []
    for x in items:
        out += flatten_list(x) if isinstance(x, (list, tuple)) else [x]
    return out


def utc(t: datetime | None) -> datetime:
    """t in UTC; a naive time is UTC already, None is now."""
    if t is None:
        return datetime.now(timezone.utc)
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
