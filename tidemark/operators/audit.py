"""Which sources have been loaded: operators on audit rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import moment

SCHEMA = "audit_id int, table_name string, data_source_type string, data_source string, data_source_ts timestamp, upload_ts timestamp"


def filter_items(items: DataFrame, log: DataFrame, table_name: str, source: str = "__path", ts: str = "__created_at") -> DataFrame:
    """Items whose source was not loaded into the table and that are no older than the newest one loaded; all of them
    if none was."""
    mine = log.where(F.col("table_name") == table_name)
    newest = _edge(mine, F.max)
    if newest is None:
        return items
    fresh = items.distinct().join(mine.select(F.col("data_source").alias(source)), source, "left_anti").select(*items.columns)
    return fresh.where(F.unix_micros(ts) >= newest)


def unaudited(items: DataFrame, log: DataFrame, table_name: str, source: str = "__path") -> tuple[DataFrame, int | None]:
    """(the distinct items whose source the table's log doesn't have, the newest time it has in microseconds).

    Unlike filter_items nothing is left out for being old: a source that the log lacks was never loaded. A null source is
    one like others.
    """
    mine = log.where(F.col("table_name") == table_name)
    done = mine.select(F.col("data_source").alias("__s"))
    return items.distinct().join(done, F.col(source).eqNullSafe(F.col("__s")), "left_anti"), _edge(mine, F.max)


def _edge(log: DataFrame, pick) -> int | None:
    return log.agg(pick(F.unix_micros("data_source_ts"))).first()[0]


def late_items(items: DataFrame, log: DataFrame, table_name: str, ts: str = "__created_at", strict: bool = False) -> DataFrame:
    """Items no newer than the table's earliest entry, or with strict than its latest."""
    mine = log.where(F.col("table_name") == table_name)
    edge = _edge(mine, F.max if strict else F.min)
    return items.where(F.unix_micros(ts) <= edge) if edge is not None else items.limit(0)


def latest_entries(log: DataFrame, asof: datetime | None = None, table_name: str | None = None, data_source_type: str | None = None) -> DataFrame:
    """The newest row of each table by data_source_ts (then audit_id)."""
    if asof is not None and asof.tzinfo is None:
        raise ValueError("asof must have a time zone")
    if table_name is not None:
        log = log.where(F.col("table_name") == table_name)
    if data_source_type is not None:
        log = log.where(F.col("data_source_type") == data_source_type)
    if asof is not None:
        log = log.where(F.col("data_source_ts") <= moment(asof))
    row = F.struct(*log.columns)
    best = log.groupBy("table_name").agg(F.max_by(row, F.struct("data_source_ts", "audit_id")).alias("__row"))
    return best.select("__row.*")


def purged(log: DataFrame, table_name: str, after: datetime, interval: str = "closed") -> DataFrame:
    """log without the table's rows of after or later (closed) or only later (open)."""
    if interval not in ("open", "closed"):
        raise ValueError(f"unknown interval {interval}")
    t = F.col("data_source_ts")
    gone = (F.col("table_name") == table_name) & ((t >= moment(after)) if interval == "closed" else (t > moment(after)))
    return log.where(~F.coalesce(gone, F.lit(False)))
