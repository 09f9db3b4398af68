"""Tables watched through their audit log."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidemark.plans.audit_log import AuditLog
from tidemark.store.tables import Database

LOG = logging.getLogger(__name__)


class UpdateTracker:
    """Calls back for each table whose newest entry, as of a time, is later than the one seen before."""

    def __init__(self, callback: Callable[[str, str, datetime], None] | None = None):
        self.callback, self.seen = callback, dict[str, datetime]()

    def clear(self) -> None:
        self.seen.clear()

    def check(self, epoch_ms: int, schemas: Iterable[str], db: Database) -> int:
        """How many callbacks were made. One that fails is logged, and counts as seen."""
        if self.callback is None:
            raise ValueError("no callback")
        asof, n = datetime.fromtimestamp(epoch_ms / 1000, timezone.utc), 0
        for schema in schemas:
            for name, us in AuditLog(db, schema).get_latest_entry(asof).select("table_name", F.unix_micros("data_source_ts")).collect():
                t = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)
                key = f"{schema}.{name}"
                if key not in self.seen or t > self.seen[key]:
                    n += 1
                    try:
                        self.callback(schema, name, t)
                    except Exception:
                        LOG.exception("callback for %s failed", key)
                    self.seen[key] = t
        return n
