"""Finding files and when they were made."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone
from fnmatch import fnmatch
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import jpath

FOUND = "__path string, __created_at timestamp"
MAX_DEPTH = 4


def file_time(path: str, spec: Mapping[str, Any], modified: float | None = None) -> datetime:
    """When a file was made, in UTC. spec: method regex (datetime_regex with groups y, m, d and maybe H, M, S, u, matched from the path's
    start), manual (datetime) or mtime (modified, seconds since 1970); source_tz is the zone of the first two."""
    zone = ZoneInfo(spec.get("source_tz") or "UTC")
    method = spec.get("method")
    if method == "mtime":
        return datetime.fromtimestamp(os.stat(path).st_mtime if modified is None else modified, timezone.utc)
    if method == "manual":
        t = spec["datetime"]
        t = datetime.fromisoformat(t) if isinstance(t, str) else t
    elif method == "regex":
        m = re.match(spec["datetime_regex"], path)
        if m is None:
            raise ValueError(f"{path} doesn't match {spec['datetime_regex']}")
        g = m.groupdict()
        t = datetime(*(int(g[k]) for k in "ymd"), *(int(g.get(k) or 0) for k in "HMS"), int((g.get("u") or "0").ljust(6, "0")[:6]))
    else:
        raise ValueError(f"unknown timestamp method {method}")
    return (t if t.tzinfo else t.replace(tzinfo=zone)).astimezone(timezone.utc)


def _entries(spark: SparkSession, folder: str) -> list[tuple[str, str, bool, float]]:
    """(name, path, is a folder, modified) of what is in a folder, of this machine or of any file system Spark knows."""
    if "://" not in folder and not folder.startswith("file:"):
        try:
            return [(e.name, e.path, e.is_dir(), e.stat().st_mtime) for e in os.scandir(folder)]
        except FileNotFoundError:
            return []
    fs, p = jpath(spark, folder)
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getModificationTime() / 1000) for s in fs.listStatus(p)]


def crawl(spark: SparkSession, root: str, file_include: Iterable[str], file_exclude: Iterable[str] = (), dir_include: Iterable[str] = (), dir_exclude: Iterable[str] = (), max_depth: int = MAX_DEPTH) -> list[tuple[str, float]]:
    """(path, modified) of files up to max_depth folders below root whose name fits an include and no exclude pattern; a
    folder that fits dir_exclude isn't entered, and with dir_include only files somewhere in a folder that fits count."""
    out = []
    todo = [(root, 1, not list(dir_include))]
    while todo:
        folder, depth, good = todo.pop()
        for name, path, is_dir, modified in _entries(spark, folder):
            if is_dir:
                if depth < max_depth and not any(fnmatch(name, p) for p in dir_exclude):
                    todo.append((path, depth + 1, good or any(fnmatch(name, p) for p in dir_include)))
            elif good and any(fnmatch(name, p) for p in file_include) and not any(fnmatch(name, p) for p in file_exclude):
                out.append((path, modified))
    return out


def find_files(spark: SparkSession, search_paths: Iterable[Mapping[str, Any]]) -> DataFrame:
    """(__path, __created_at) of the files of all enabled search paths, each once, by time and path."""
    found = set()
    for s in search_paths:
        if not s.get("is_enabled", True):
            continue
        paths = crawl(spark, s["root_path"], s["file_include"], s.get("file_exclude") or (), s.get("dir_include") or (), s.get("dir_exclude") or (), s.get("max_depth") or MAX_DEPTH)
        found |= {(p, file_time(p, s["timestamp"], m)) for p, m in paths}
    return spark.createDataFrame(sorted(found, key=lambda x: (x[1], x[0])), FOUND)
