"""Time slices of versioned rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.utils import utc

FROM, TO = "__valid_from", "__valid_to"
VALIDITY = (FROM, TO)
#: Fixed value: the open end of a live row's validity.
SENTINEL = datetime(2038, 1, 19, 3, 14, 7, 999999, tzinfo=timezone.utc)


def moment(t: datetime | None) -> Column:
    """A timestamp literal, independent of the session's time zone; None is now."""
    u = utc(t)
    return F.timestamp_micros(F.lit(int((u - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))))


@dataclass(frozen=True)
class TimeSlice:
    """Which versions a read sees.

    none: live rows; all: every version; asof: those valid at asof_utc (from <= t < to); span: those valid at some
    time within history_span before asof_utc (from <= t, to > t - span, so one that ended just then is left out).
    """

    mode: str = "none"
    asof_utc: datetime | None = None
    history_span: timedelta = timedelta(0)

    def __post_init__(self) -> None:
        if self.mode not in ("none", "all", "asof", "span"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode in ("asof", "span") and self.asof_utc is None:
            raise ValueError(f"{self.mode} needs asof_utc")

    def condition(self) -> Column:
        if self.mode == "all":
            return F.lit(True)
        if self.mode == "none":
            return F.col(TO) == moment(SENTINEL)
        t = utc(self.asof_utc)
        if self.mode == "asof":
            return (F.col(FROM) <= moment(t)) & (F.col(TO) > moment(t))
        return (F.col(FROM) <= moment(t)) & (F.col(TO) > moment(t - self.history_span))

    def apply(self, df: DataFrame) -> DataFrame:
        """df's versions in the slice; applied below any join, the comparison reaches the Parquet scan."""
        return df if self.mode == "all" else df.where(self.condition())


def is_temporal(df: DataFrame) -> bool:
    return set(VALIDITY) <= set(df.columns)


def close_rows(df: DataFrame, keys: DataFrame, on: list[str], t: datetime | None) -> DataFrame:
    """df, versioned, with the live rows of keys ended at t; a row that would begin at t or later disappears."""
    end = moment(t)
    gone = keys.select(*on).distinct().withColumn("__gone", F.lit(True))
    out = df.join(gone, on, "left")
    closing = F.col("__gone").isNotNull() & (F.col(TO) == moment(SENTINEL))
    out = out.withColumn(TO, F.when(closing, end).otherwise(F.col(TO)))
    return out.where(~(closing & (F.col(FROM) >= end))).select(*df.columns)
