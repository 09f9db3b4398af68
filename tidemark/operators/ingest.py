"""Steps between a loaded file and a delta: aggregation, bucketing, late data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.delta import dedupe
from tidemark.operators.temporal import moment

BUCKET = "__bucket"
# Units of intervals such as 1d or 2h30m.
UNITS = {"us": "MICROSECOND", "ms": "MILLISECOND", "s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "mo": "MONTH", "q": "QUARTER", "y": "YEAR"}
SECONDS = {"us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def interval_parts(interval: str) -> list[tuple[int, str]]:
    parts = [(int(n), u) for n, u in re.findall(r"(\d+)(us|ms|mo|[smhdwqy])", interval)]
    if not parts or "".join(f"{n}{u}" for n, u in parts) != interval:
        raise ValueError(f"unknown interval {interval}")
    return parts


def truncate(c: Column, interval: str) -> Column:
    """The start of the interval that c is in: fixed lengths count from 1970, weeks begin on Monday, months, quarters
    and years are the calendar's."""
    parts = interval_parts(interval)
    if len(parts) == 1 and parts[0][1] in ("mo", "q", "y"):
        n, unit = parts[0]
        months = n * {"mo": 1, "q": 3, "y": 12}[unit]
        k = (F.year(c) * 12 + F.month(c) - 1) - F.pmod(F.year(c) * 12 + F.month(c) - 1, F.lit(months))
        return F.make_timestamp(F.floor(k / 12).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if any(u in ("mo", "q", "y") for _, u in parts):
        raise ValueError(f"mixed interval {interval}")
    length = round(sum(n * SECONDS[u] for n, u in parts) * 1_000_000)
    shift = 4 * 86_400_000_000 if parts[0][1] == "w" else 0  # 1970 began on a Thursday
    us = F.unix_micros(c)
    return F.timestamp_micros(us - F.pmod(us - F.lit(shift), F.lit(length)))


def offset(c: Column, interval: str, sign: int = 1) -> Column:
    """c moved by the interval."""
    for n, u in interval_parts(interval):
        n, unit = (n * 3, "MONTH") if u == "q" else (n, UNITS[u])
        c = c + F.expr(f"INTERVAL '{sign * n}' {unit}") if unit not in ("WEEK", "MILLISECOND", "MICROSECOND") else c + F.make_dt_interval(
            F.lit(sign * n * 7 if unit == "WEEK" else 0), F.lit(0), F.lit(0), (F.lit(sign * n) / (1000 if unit == "MILLISECOND" else 1_000_000 if unit == "MICROSECOND" else 1) if unit != "WEEK" else F.lit(0)).cast("decimal(18,6)")
        )
    return c


def bucketed(df: DataFrame, time: str, interval: str, keys: Sequence[str], strategy: str = "round_up", keep: str = "last") -> DataFrame:
    """df with BUCKET, one row per keys and bucket: the last or first by time (then by arrival). round_up names a bucket by its end."""
    start = truncate(F.col(time), interval)
    if strategy not in ("round_up", "round_down"):
        raise ValueError(f"unknown bucket strategy {strategy}")
    b = df.withColumn(BUCKET, offset(start, interval) if strategy == "round_up" else start)
    return dedupe(b, [*keys, BUCKET], keep, [time, *(["__ord"] if "__ord" in df.columns else [])])


def drop_past(df: DataFrame, time: str, interval: str, strategy: str, previous: datetime | None) -> tuple[DataFrame, datetime | None]:
    """(rows of a bucketed batch that are not late, the time to pass as previous with the next batch).

    Buckets up to previous go; then previous becomes the newest bucket's start, and only rows after that stay.
    """
    kept = df if previous is None else df.where(F.col(BUCKET) > moment(previous))
    back = offset(F.col(BUCKET), interval, -1) if strategy == "round_up" else F.col(BUCKET)
    us = kept.agg(F.unix_micros(F.max(back))).first()[0]
    if us is None:
        return kept, previous
    from datetime import timedelta, timezone

    newest = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)
    return kept.where(F.col(time) > moment(newest)), newest


def group_sum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns summed over rows alike in all others (null alike null); the order of arrival is the first one's."""
    others = [c for c in df.columns if c not in columns and c != "__ord"]
    aggs = [F.sum(f"`{c}`").cast(df.schema[c].dataType).alias(c) for c in columns]
    return df.groupBy(*(f"`{c}`" for c in others)).agg(*aggs, *([F.min("__ord").alias("__ord")] if "__ord" in df.columns else [])).select(*df.columns)
