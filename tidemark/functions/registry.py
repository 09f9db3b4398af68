"""Registries of named functions: transforms of columns and readers of stream payloads."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame, str, list[Any]], DataFrame]
Reader = Callable[[Any, datetime, dict[str, Any]], DataFrame]


class Registry:
    """Functions by name."""

    def __init__(self, kind: str, given: dict[str, Callable] | None = None):
        self.kind, self._functions = kind, dict(given or {})

    def register_function(self, name: str, fn: Callable, allow_overwrite: bool = False) -> None:
        if name in self._functions and not allow_overwrite:
            raise ValueError(f"{self.kind} function {name} is registered already")
        self._functions[name] = fn

    def delete_function(self, name: str) -> None:
        self._functions.pop(name, None)

    def list_functions(self) -> list[str]:
        return list(self._functions)

    def call_function(self, name: str, *args: Any) -> DataFrame:
        if name not in self._functions:
            raise ValueError(f"no {self.kind} function {name}")
        out = self._functions[name](*args)
        if out is None:
            raise ValueError(f"{self.kind} function {name} returned nothing")
        return out


_transforms: Registry | None = None
_readers = Registry("ingest")


def transforms() -> Registry:
    """The transforms: (df, result column, arguments) -> df; the built-in ones are there from the start."""
    global _transforms
    if _transforms is None:
        from tidemark.functions.transforms import BUILT_IN

        _transforms = Registry("transform", BUILT_IN)
    return _transforms


def readers() -> Registry:
    """The payload readers: (payload, time, arguments) -> df with columns __path and __created_at."""
    return _readers
