"""Datasets run: files and messages into tables."""

from __future__ import annotations

import logging
import time as clock
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config.model import DatasetConfig, EngineConfig, IngestColumn, PipelineItem, TableConfig, TableConfigs
from tidemark.functions.registry import transforms
from tidemark.operators import delta as ops
from tidemark.operators.foreign_keys import deduce_keys
from tidemark.operators.ingest import BUCKET, bucketed, drop_past, group_sum
from tidemark.operators.temporal import moment
from tidemark.plans.audit_log import AuditLog
from tidemark.session import scratch_scope, stage
from tidemark.sources.dsv import clean_payload, load_typed_dsv
from tidemark.sources.files import find_files
from tidemark.store.tables import Database, Transaction
from tidemark.types import cast_columns, spark_type
from tidemark.utils import NonRetryable, utc

LOG = logging.getLogger(__name__)
ATTEMPTS, WAIT = 3, 60.0
#: Column with the time of a row's file, where a batch has several.
FILE_TIME = "__file_time"


@dataclass
class Batch:
    """Rows of one file or fetch, typed as loaded: what they are from, when that was made, what follows a commit."""

    rows: DataFrame
    time: datetime
    sources: Sequence[tuple[str, str, datetime]] = ()  # (type, source, time) for the audit log
    done: Callable[[], None] = lambda: None
    failed: Callable[[], None] = lambda: None
    rejects: DataFrame | None = None  # rows that go to the dataset's reject table instead, with __path and __created_at


def apply_transformations(df: DataFrame, columns: Sequence[IngestColumn]) -> DataFrame:
    """Each column's transforms in order, then: columns without target go, sums are made, missing values filled, types
    become the target's. A computed column that is there already is left as it is."""
    for c in columns:
        if not c.transforms or (c.column_type == "computed" and c.name in df.columns):
            continue
        for name, args in c.transforms.items():
            if args is not None:
                df = transforms().call_function(name, df, c.name, args)
        if c.target_data_type:
            df = cast_columns(df, {c.name: spark_type(c.target_data_type)})
    df = df.drop(*(c.name for c in columns if c.column_type == "dsv_only"))
    summed = [c.name for c in columns if c.aggregation and c.name in df.columns]
    if summed:
        df = group_sum(df, summed)
    kinds = {c.name: spark_type(c.target_data_type) for c in columns if c.target_data_type}
    df = cast_columns(df, kinds)
    return ops.fill_defaults(df, {c.name: (c.value_if_missing, kinds[c.name]) for c in columns if c.value_if_missing is not None})


def run_transaction(db: Database, work: Callable[[Transaction], Any], attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] = clock.sleep) -> Any:
    """work in a transaction and its commit, tried again from the start after a failure that isn't NonRetryable. What it
    stages is gone after each attempt."""
    for left in range(attempts - 1, -1, -1):
        try:
            with scratch_scope(db.spark):
                tx = db.begin()
                out = work(tx)
                tx.commit()
                return out
        except NonRetryable:
            raise
        except Exception:
            if not left:
                raise
            LOG.exception("transaction failed, %d attempts left", left)
            sleep(wait)


class DatasetRunner:
    """One dataset's pipeline over batches."""

    def __init__(self, db: Database, dataset: DatasetConfig, tables: TableConfigs):
        self.db, self.dataset, self.tables = db, dataset, tables
        self.columns = dataset.pipeline.resolved(tables)
        self.main = tables[dataset.pipeline.primary.table]
        heads = dataset.pipeline.header_map(self.main.name)
        self.keys = [heads.get(k, k) for k in self.main.primary_keys]
        self.audit = AuditLog(db, dataset.delta_table_schema or self.main.schema)

    def partitioned(self, rows: DataFrame, payload_time: datetime, tx: Transaction) -> DataFrame:
        """rows with BUCKET: the payload's time, or by the dataset's time partition."""
        tp = self.dataset.time_partition
        if tp is None:
            return rows.withColumnRenamed(FILE_TIME, BUCKET) if FILE_TIME in rows.columns else rows.withColumn(BUCKET, moment(payload_time))
        rows = rows.drop(FILE_TIME)
        df = bucketed(rows, tp.column, tp.bucket_interval, self.keys, tp.bucket_strategy, tp.unique_strategy)
        if self.dataset.input_config.filter_past_events:
            seen = tx.state.setdefault("late", {})
            was = seen.get(self.dataset.name)
            df, newest = drop_past(df, tp.column, tp.bucket_interval, tp.bucket_strategy, datetime.fromisoformat(was) if was else None)
            if newest is not None:
                seen[self.dataset.name] = newest.isoformat()
        return df

    def load(self, tx: Transaction, batch: Batch) -> list[str]:
        """A batch into the tables of the pipeline, in its order; returns the tables that changed."""
        policy = self.dataset.delta_config
        rows = apply_transformations(batch.rows, self.columns)
        delta = self.partitioned(rows, batch.time, tx)
        delta = ops.dedupe(delta, [*self.keys, BUCKET])
        if policy.prefill_nulls_with_default:
            known = {s: c for i in self.dataset.pipeline.items for s, t in i.column_map().items() for c in self.tables[i.table].columns if c.name == t}
            delta = ops.fill_defaults(delta, {s: (c.default_value, c.kind) for s, c in known.items() if c.default_value is not None})
        delta = stage(delta, "delta")
        if not self.dataset.is_temporary_table:
            name = f"{self.dataset.delta_table_schema or self.main.schema}.{self.dataset.name}"
            path = f"{self.db.root}/_deltas/{name.replace('.', '/')}/{tx.base + 1:08d}-{uuid.uuid4().hex}"
            delta.write.parquet(path)
            tx.state.setdefault("deltas", {})[name] = path
        changed = []
        for item in self.dataset.pipeline.items:
            table = self.tables[item.table]
            tx.create(table)
            if item.type == "primary":
                delta, counts = self._primary(tx, item, delta)
            else:
                delta, counts = self._extract(tx, item, delta)
            if counts:
                changed.append(table.full_name)
        return list(dict.fromkeys(changed))

    def _primary(self, tx: Transaction, item: PipelineItem, delta: DataFrame) -> tuple[DataFrame, ops.Counts]:
        columns = item.column_map()
        missing = [s for s in columns if s not in delta.columns]
        if missing:
            raise ValueError(f"columns {missing} of {item.table} are not in the data")
        return delta, tx.merge_all(self.tables[item.table].full_name, delta, BUCKET, self.dataset.delta_config, columns)

    def _extract(self, tx: Transaction, item: PipelineItem, delta: DataFrame) -> tuple[DataFrame, ops.Counts]:
        table = self.tables[item.table]
        if table.is_temporal:
            raise NotImplementedError("lookup tables are not temporal")
        lacking = [c.name for c in item.columns if c.required and c.name not in delta.columns]
        if lacking:
            raise NonRetryable(f"required columns {lacking} of {item.table} are not in the data")
        made = 0
        for c in (c for c in item.columns if c.deduce_foreign_key):
            values = {x.name: x.target for x in item.columns if not x.deduce_foreign_key and x.target and x.name in delta.columns}
            entry = tx._entry(table.full_name)
            parent = tx.live(table.full_name)
            high = max(entry["high"], parent.agg(F.max(c.target)).first()[0] or 0)
            delta, added, top = deduce_keys(delta, parent, table.fields, values, (c.name, c.target), high)
            delta = stage(delta, "keyed")
            tx.put(table.full_name, append=added, grown=top - high)
            made, entry["high"] = made + top - high, top
        columns = {s: t for s, t in item.column_map().items() if s in delta.columns}
        counts = tx.merge_all(table.full_name, delta, BUCKET, ops.Policy(on_duplicate_key="take_last", row_finality=self.dataset.delta_config.row_finality), columns)
        return delta, ops.Counts(counts.inserts + made, counts.updates, counts.deletions)

    @property
    def reject_table(self) -> TableConfig:
        """Where rows of late messages go under late_messages: reject, each as JSON with its source."""
        text = lambda n: {"name": n, "data_type": "TEXT"}
        times = [{"name": n, "data_type": "DATETIME"} for n in ("created_at", "rejected_at")]
        return TableConfig.of({"schema": self.audit.schema, "name": f"{self.dataset.name}__late", "primary_keys": [], "columns": [text("path"), times[0], text("row"), times[1]]})

    def reject(self, tx: Transaction, rows: DataFrame) -> int:
        """Adds rows to the reject table in the transaction that records their source; returns how many."""
        config = tx.create(self.reject_table)
        data = [c for c in rows.columns if c not in ("__path", "__created_at")]
        out = stage(rows.select(F.col("__path").alias("path"), F.col("__created_at").alias("created_at"), F.to_json(F.struct(*(f"`{c}`" for c in data))).alias("row"), moment(None).alias("rejected_at")), "late")
        n = out.count()
        if n:
            tx.put(config.full_name, append=out, grown=n)
            LOG.warning("%s: %d rows of late messages went to %s", self.dataset.name, n, config.full_name)
        return n

    def run(self, batches: Iterator[Batch], attempts: int = ATTEMPTS, wait: float = WAIT, capture: list | None = None) -> int:
        """All batches, each one transaction with its audit rows; what follows a commit comes after it."""
        n = 0
        for batch in batches:

            def work(tx: Transaction, batch: Batch = batch) -> None:
                changed = self.load(tx, batch)
                if batch.rejects is not None:
                    self.reject(tx, batch.rejects)
                entries = [(t.split(".", 1)[1], *s) for t in changed for s in batch.sources]
                if entries:
                    self.audit.add_entries(entries, tx)

            try:
                run_transaction(self.db, work, attempts, wait)
            except Exception:
                batch.failed()
                raise
            batch.done()
            if capture is not None:
                capture.append((batch.time, batch.rows))
            n += 1
        return n

    # --- sources

    def file_batches(self) -> Iterator[Batch]:
        """Files of the search paths that the audit log doesn't have, in order of time, files_per_batch at a time."""
        spark, d = self.db.spark, self.dataset
        found = find_files(spark, d.input_config.search_paths)
        todo = self.audit.filter_items(found, self.main.name)
        self.audit.prevalidate_new_items(todo, self.main.name)
        files = sorted(((r["__created_at"], r["__path"]) for r in todo.select("__path", F.unix_micros("__created_at").alias("__created_at")).collect()))
        files = files[: d.scrape_limit] if d.scrape_limit > 0 else files
        size = max(1, d.input_config.files_per_batch)
        if size > 1 and d.delta_config.row_finality == "dropout":
            raise ValueError("with dropout each file is a batch of its own")
        for part in (files[i : i + size] for i in range(0, len(files), size)):
            rows = load_typed_dsv(spark, [path for _, path in part], self.columns, d.input_config.delimiter, d.null_values, with_path="__path")
            if size > 1 and d.time_partition is None:
                times = spark.createDataFrame(part, "us long, __path string").select("__path", F.timestamp_micros("us").alias(FILE_TIME))
                rows = rows.join(F.broadcast(times), "__path")
            yield Batch(rows.drop("__path"), _from_us(part[-1][0]), [("dsv", path, _from_us(us)) for us, path in part])

    def payload_batch(self, payload: str, payload_time: datetime) -> Batch:
        """Delimited text given directly; the audit log isn't asked."""
        rows = load_typed_dsv(self.db.spark, clean_payload(payload).encode(), self.columns, self.dataset.input_config.delimiter, self.dataset.null_values)
        return Batch(rows, utc(payload_time))


def _from_us(us: int) -> datetime:
    from datetime import timedelta, timezone

    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def create_batches(runner: DatasetRunner, client: Any | None = None) -> Iterator[Batch]:
    """The source that a dataset's input names; streams need a client that the caller owns."""
    if runner.dataset.input_config.type == "dsv":
        return runner.file_batches()
    if client is None:
        raise ValueError("a stream needs a client")
    from tidemark.streaming.messages import message_batches

    return message_batches(runner, client)


def run_datasets(config: EngineConfig, db: Database, dataset_name: str | None = None, client: Any | None = None, swallow_errors: bool = False, capture: list | None = None, attempts: int = ATTEMPTS, wait: float = WAIT) -> None:
    """All datasets, or the one named, one after the other; their tables are made first. A failure is raised, or with
    swallow_errors logged and the next dataset run."""
    chosen = [d for d in config.datasets if dataset_name in (None, d.name)]
    if not chosen:
        raise ValueError(f"no dataset {dataset_name}")
    db.create_all(config.tables)
    for d in chosen:
        try:
            runner = DatasetRunner(db, d, config.tables)
            runner.run(create_batches(runner, client), attempts, wait, capture)
        except Exception:
            if not swallow_errors:
                raise
            LOG.exception("dataset %s failed", d.name)
