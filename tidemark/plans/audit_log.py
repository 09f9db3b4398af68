"""The audit log of a schema, a table like others that changes in the same commits."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame

from tidemark.config.model import TableConfig
from tidemark.operators import audit
from tidemark.store.tables import Database, Transaction
from tidemark.utils import NonRetryable, smallest_datetime, utc

TABLE = "__audit_log"
_UNIQUE = ["source"]


class AuditLog:
    def __init__(self, db: Database, schema: str):
        self.db, self.schema, self.full_name = db, schema, f"{schema}.{TABLE}"
        text = lambda n, size: {"name": n, "data_type": f"VARCHAR({size})", "nullable": False, "unique_constraint": _UNIQUE}
        self.config = TableConfig.of(
            {
                "schema": schema,
                "name": TABLE,
                "primary_keys": ["audit_id"],
                "columns": [
                    {"name": "audit_id", "data_type": "INT", "nullable": False, "autoincrement": True},
                    text("table_name", 64),
                    text("data_source_type", 32),
                    text("data_source", 1023),
                    {"name": "data_source_ts", "data_type": "DATETIME", "nullable": False, "unique_constraint": _UNIQUE},
                    {"name": "upload_ts", "data_type": "DATETIME", "nullable": False},
                ],
            }
        )

    def rows(self, tx: Transaction | None = None) -> DataFrame:
        tx = tx or self.db.begin()
        return tx.live(self.full_name) if tx.exists(self.full_name) else self.db.spark.createDataFrame([], audit.SCHEMA)

    def add_entries(self, entries: Iterable[tuple[str, str, str, datetime]], tx: Transaction, upload_ts: datetime | None = None) -> None:
        """Adds (table, type, source, time with zone) rows to a transaction; ValueError if one is there already."""
        new = sorted(set(entries))
        for e in new:
            if e[3].tzinfo is None:
                raise ValueError("data_source_ts must have a time zone")
        tx.create(self.config)
        e = tx._entry(self.full_name)
        now = utc(upload_ts)
        df = self.db.spark.createDataFrame([(e["high"] + i + 1, *x, now) for i, x in enumerate(new)], audit.SCHEMA)
        cols = ["table_name", "data_source_type", "data_source", "data_source_ts"]
        if self.rows(tx).join(df.select(*cols), cols, "left_semi").limit(1).count():
            raise ValueError("already in the audit log")
        tx.put(self.full_name, append=df, grown=len(new))
        e["high"] += len(new)

    def add_entry(self, data_source_type: str, data_source: str, table_name: str, data_source_ts: datetime) -> None:
        tx = self.db.begin()
        self.add_entries([(table_name, data_source_type, data_source, data_source_ts)], tx)
        tx.commit()

    def filter_items(self, items: DataFrame, table_name: str, source: str = "__path", ts: str = "__created_at") -> DataFrame:
        return audit.filter_items(items, self.rows(), table_name, source, ts)

    def unaudited(self, items: DataFrame, table_name: str) -> tuple[DataFrame, int | None]:
        return audit.unaudited(items, self.rows(), table_name)

    def prevalidate_new_items(self, items: DataFrame, table_name: str, strict: bool = False) -> None:
        """NonRetryable if an item is no newer than the earliest entry (strict: the latest)."""
        late = audit.late_items(items, self.rows(), table_name, strict=strict).limit(1).collect()
        if late:
            raise NonRetryable(f"{table_name}: {late[0]['__path']} is older than what was loaded")

    def get_latest_entry(self, asof: datetime | None = None, table_name: str | None = None, data_source_type: str | None = None) -> DataFrame:
        return audit.latest_entries(self.rows(), asof, table_name, data_source_type)

    def purge_after_timestamp(self, table_name: str, timestamp: datetime, interval: str = "closed") -> int:
        """Deletes the table's entries from timestamp on (closed) or after it (open); returns how many."""
        tx = self.db.begin()
        if not tx.exists(self.full_name):
            return 0
        before = tx.live(self.full_name)
        kept = audit.purged(before, table_name, timestamp, interval)
        n = before.count() - kept.count()
        tx.put(self.full_name, live=kept, grown=kept.count())
        tx.commit()
        return n

    def purge(self, table_name: str) -> int:
        return self.purge_after_timestamp(table_name, smallest_datetime(), "closed")


