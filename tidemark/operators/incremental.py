"""Processing only new or changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import fold
from tidemark.operators.skew import lookup_join
from tidemark.store.log import CommitLog
from tidemark.session import stage
from tidemark.store.versioned import CHANGE, FILE, POS, VersionedTable

#: What makes two listings one item.
ITEM = ("table_name", "data_source_type", "data_source", "data_source_ts")


def same_item(df: DataFrame) -> DataFrame:
    """ITEM's columns as they compare: names without case and outer spaces, times in whole seconds."""
    return df.withColumns({"table_name": fold("table_name"), "data_source_ts": F.date_trunc("second", "data_source_ts")})


def listed_items(source_items: DataFrame) -> DataFrame:
    """One row per item: ITEM, its smallest item_id and its latest changed_ts. Null values are values like others."""
    return same_item(source_items).groupBy(*ITEM).agg(F.min("item_id").alias("item_id"), F.max("changed_ts").alias("changed_ts"))


def recorded_items(audit_log: DataFrame, runs: DataFrame, status: str = "committed") -> DataFrame:
    """One row per item that a run of that status recorded: ITEM and the latest upload_ts as recorded_ts."""
    good = runs.where(fold("status") == status).select("run_id").distinct()
    rows = lookup_join(same_item(audit_log), good, ["run_id"], "left_semi")
    return rows.groupBy(*ITEM).agg(F.max("upload_ts").alias("recorded_ts"))


def _consumers(items: VersionedTable, consumer: str, version: int) -> dict:
    return {"consumers": {**items.log.read().get("consumers", {}), f"{items.name}/{consumer}": version}}


def start_from_log(items: VersionedTable, recorded: DataFrame, consumer: str) -> int:
    """The first version of items: what committed runs recorded, each item changed last at its recorded_ts; consumer has
    processed it. Both in one commit, so a run that fails here starts anew."""
    rows = recorded.where("recorded_ts IS NOT NULL").select(*ITEM, F.lit(None).cast("long").alias("item_id"), F.col("recorded_ts").alias("changed_ts"))
    return items.commit(add=rows, also=_consumers(items, consumer, items.log.latest() + 1))


def merge_listing(items: VersionedTable, listed: DataFrame) -> int | None:
    """A version with the listed items that items lacks or has with an earlier change, these in place of what it has; items
    that are not listed stay. None, and no version, if there is nothing to change."""
    now = items.scan().select(FILE, POS, F.col("changed_ts").alias("__was"), *(F.col(c).alias(f"__{c}") for c in ITEM))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ITEM]
    known = F.col(FILE).isNotNull() & F.coalesce(F.col("__was") >= F.col("changed_ts"), F.lit(False))
    plan = stage(listed.join(now, same, "left").where(~known).select(FILE, POS, *ITEM, "item_id", "changed_ts"), "listing")
    n, old = plan.agg(F.count(F.lit(1)), F.count(FILE)).first()
    return items.commit(add=plan.drop(FILE, POS), delete=plan.where(F.col(FILE).isNotNull()) if old else None) if n else None


def pending_items(source_items: DataFrame, audit_log: DataFrame, runs: DataFrame, root: str, consumer: str = "loader") -> DataFrame:
    """One run: items added or changed since the last successful one, as ITEM, item_id, changed_ts.

    root holds a table of items, the output, and consumer's processed version. Where root is empty, the audit log says
    what earlier runs processed: its recorded items are the table's first version, which counts as processed. The
    listing is then merged as the next version, and consume takes the record delta between the processed version and
    that one from the two manifests: the inserts are the run's items, committed to the output together with the version
    now processed. A later run with the same root merges its listing and gets only what is new since; one that failed
    before its commit has processed nothing. An item without any changed_ts is pending in each run that lists it, audit
    rows without upload_ts count for nothing.
    """
    log = CommitLog(source_items.sparkSession, root)
    items, out = VersionedTable(log, "items"), VersionedTable(log, "pending")
    if not items.exists():
        start_from_log(items, recorded_items(audit_log, runs), consumer)
    merge_listing(items, listed_items(source_items))
    before = out._at(None)["files"]
    done = items.consume(consumer, lambda d: d.where(F.col(CHANGE) == "insert").drop(CHANGE, FILE, POS), out)
    if done is None:
        return items.read().limit(0)
    fresh = [f for f in out._at(done)["files"] if f not in set(before)]
    return out._scan(fresh, out.schema()).drop(FILE, POS)
