"""Tables with history on Parquet: one manifest commit is one transaction over all of them."""

from __future__ import annotations

import logging
import re
import time as clock
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config.model import TableConfig, TableConfigs
from tidemark.operators import delta as ops
from tidemark.operators.history import bulk_history
from tidemark.operators.skew import dense_numbers, lookup_join
from tidemark.operators.temporal import FROM, SENTINEL, TO, VALIDITY, TimeSlice, moment
from tidemark.session import stage
from tidemark.store.log import CommitLog
from tidemark.store.rawsql import rewrite
from tidemark.store.deletions import FILE, POS, without, write_vector
from tidemark.types import cast_columns, literal
from tidemark.utils import Clock, utc

LOG = logging.getLogger(__name__)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


#: Dead rows, as part of all live ones, from which a table's live rows are written anew.
DEAD = 0.3
#: Folders of one size that are merged into a larger one.
FOLDERS = 32


class Transaction:
    """Reads see what was committed when it began and its own writes; commit makes all of them visible at once.

    Live rows and ended versions lie in folders of their own that are never rewritten. A change adds a folder of new live
    rows and a deletion vector (file, position) of those that are live no more, so what it writes goes with what it
    changes and not with the table; ended versions are added to those that there are. Once deletion vectors cover DEAD
    of a table its live rows are written anew, and FOLDERS small folders become one, so a row is moved a few times only.
    """

    def __init__(self, db: "Database"):
        self.db, self.spark = db, db.spark
        self.base = db.log.latest()
        self.state: dict[str, Any] = db.log.read(self.base)
        self.state.setdefault("catalog", {})

    # --- metadata

    def exists(self, name: str) -> bool:
        return name in self.state["catalog"]

    def _entry(self, name: str) -> dict[str, Any]:
        try:
            return self.state["catalog"][name]
        except KeyError:
            raise ValueError(f"no table {name}") from None

    def config(self, name: str) -> TableConfig:
        return TableConfig.of(self._entry(name)["config"])

    def create(self, config: TableConfig) -> TableConfig:
        """Nothing if the table exists."""
        if not self.exists(config.full_name):
            self.state["catalog"][config.full_name] = {"config": config.to_dict(), "current": [], "history": [], "dvs": {}, "rows": 0, "dead": 0, "high": 0}
        return self.config(config.full_name)

    def drop(self, name: str) -> None:
        if self.exists(name):
            if self.config(name).forbid_drop_table:
                raise ValueError(f"table {name} must not be dropped")
            del self.state["catalog"][name]

    # --- rows

    def _schema(self, config: TableConfig) -> T.StructType:
        fields = list(config.spark_schema.fields)
        if config.is_temporal:
            fields += [T.StructField(c, T.TimestampType()) for c in VALIDITY]
        return T.StructType(fields)

    def _read(self, config: TableConfig, folders: list[str], dvs: Mapping[str, int] | None = None, located: bool = False) -> DataFrame:
        """dvs: deletion vectors with their numbers of rows."""
        schema = self._schema(config)
        if not folders:
            df = self.spark.createDataFrame([], schema)
            return df.select("*", F.lit("").alias(FILE), F.lit(0).cast("long").alias(POS)) if located else df
        df = self.spark.read.schema(schema).parquet(*folders)
        if not dvs and not located:
            return df
        df = df.select("*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(POS))
        if dvs:
            df = without(df, list(dvs), sum(dvs.values()))
        return df.select(*schema.names, *([FILE, POS] if located else []))

    def live(self, name: str, located: bool = False) -> DataFrame:
        """The live rows; of a temporal table with their validity. located: with FILE and POS."""
        e = self._entry(name)
        return self._read(self.config(name), e["current"], e["dvs"], located)

    def versions(self, name: str, slice_: TimeSlice = TimeSlice()) -> DataFrame:
        """The versions in the slice. Mode none reads live rows only."""
        config, e = self.config(name), self._entry(name)
        if not config.is_temporal or slice_.mode == "none":
            return self.live(name)
        # each part with its own filter, which reaches the scan
        parts = [slice_.apply(self.live(name))]
        return parts[0].unionByName(slice_.apply(self._read(config, e["history"]))) if e["history"] else parts[0]

    def _path(self, name: str, kind: str, level: int = 0) -> str:
        return f"{self.db.root}/{name.replace('.', '/')}/{kind}/{self.base + 1:08d}-{uuid.uuid4().hex}-L{level}"

    def _write(self, name: str, df: DataFrame, kind: str, level: int = 0) -> str:
        path = self._path(name, kind, level)
        df.select(*self._schema(self.config(name)).names).write.parquet(path)
        return path

    def put(self, name: str, live: DataFrame | None = None, ended: DataFrame | None = None, append: DataFrame | None = None, gone: DataFrame | None = None, grown: int = 0, dead: int = 0) -> None:
        """New live rows in place of all; or rows added to them and (FILE, POS) taken from them; versions added to the
        history. grown, dead: by how many the live rows and those under deletion vectors become more."""
        e = self._entry(name)
        if live is not None:
            e |= {"current": [self._write(name, live, "current")], "dvs": {}, "dead": 0, "rows": 0}
        if gone is not None:
            path = self._path(name, "dv")
            e["dvs"] = {**e["dvs"], path: write_vector(gone, path)[0]}
        if append is not None:
            e["current"] = e["current"] + [self._write(name, append, "current")]
        if ended is not None:
            e["history"] = e["history"] + [self._write(name, ended, "history")]
        e["rows"], e["dead"] = e["rows"] + grown, e["dead"] + dead
        if e["dead"] > DEAD * max(e["rows"], 1):
            self.put(name, live=self.live(name), grown=e["rows"])
        for kind in ("current", "history"):
            self._tidy(name, kind)

    def _tidy(self, name: str, kind: str) -> None:
        """FOLDERS folders of one level, the newest, become one of the next level."""
        e, level = self._entry(name), lambda f: int(f.rsplit("-L", 1)[1])
        while (folders := e[kind]) and len(folders) >= FOLDERS and len({level(f) for f in folders[-FOLDERS:]}) == 1:
            merged = self._read(self.config(name), folders[-FOLDERS:], e["dvs"] if kind == "current" else None)
            e[kind] = folders[:-FOLDERS] + [self._write(name, merged, kind, level(folders[-1]) + 1)]

    def truncate(self, name: str) -> None:
        self._entry(name).update({"current": [], "dvs": {}, "rows": 0, "dead": 0})

    def compact(self, name: str) -> None:
        """One folder each of live rows and of ended versions, without deletion vectors."""
        e, config = self._entry(name), self.config(name)
        self.put(name, live=self.live(name), grown=e["rows"])
        if len(e["history"]) > 1:
            e["history"] = [self._write(name, self._read(config, e["history"]), "history", 1)]

    def stamped(self, config: TableConfig, df: DataFrame, at: datetime) -> DataFrame:
        return df.withColumns({FROM: moment(at), TO: moment(SENTINEL)}) if config.is_temporal else df

    def merge(self, name: str, rows: DataFrame, at: datetime, policy: ops.Policy, main: bool = True, columns: Mapping[str, str] | None = None) -> ops.Counts:
        """One delta into a table at one time. columns: delta column -> table column."""
        config = self.config(name)
        rows = rows.select(*(F.col(s).alias(t) for s, t in (columns or {c: c for c in rows.columns if c in config.names}).items() if s in rows.columns), *([ops.ORD] if ops.ORD in rows.columns else []))
        kinds = config.kinds
        if config.collation:
            rows = cast_columns(rows, {n: k for n, k in kinds.items() if isinstance(k, T.StringType)})
        ops.check_types(rows.schema, config.fields, {c: c for c in rows.columns}, kinds)
        if main and policy.drop_unchanged_rows and not set(config.primary_keys) & set(rows.columns):
            raise ValueError("no key among the compared columns")
        m = ops.Merge(config.primary_keys, config.fields, at, policy, main)
        current = self.live(name, located=True)
        if policy.row_finality != "dropout" and self._entry(name)["current"]:  # rows of other keys are read and passed over, not shuffled
            current = lookup_join(current, rows.select(*config.primary_keys).distinct(), config.primary_keys, "left_semi")
        if not config.is_temporal:
            current = current.withColumn(FROM, moment(EPOCH))
        # of the live rows only those that change are written, beside the delta's own
        plan = m.plan(current, rows)
        plan = stage(plan.where((F.col(ops.OP) != ops.KEEP) | F.col("__same")).withColumn("after", F.when(F.col(ops.OP) != ops.KEEP, F.col("after"))), "merge")
        counts = m.counts(plan)
        closed = int(plan.where(F.col(ops.OP) == ops.CLOSE).count()) if policy.row_finality == "dropout" else 0
        dead = counts.updates + closed
        if counts.inserts + dead:
            gone = plan.where(F.col(ops.OP).isin(ops.UPDATE, ops.CLOSE)).select(f"old.{FILE}", f"old.{POS}") if dead else None
            fresh = m.fresh(plan) if counts.inserts + counts.updates else None
            self.put(name, append=fresh, gone=gone, ended=m.closed(plan) if config.is_temporal and dead else None, grown=counts.inserts - closed, dead=dead)
        return counts

    def merge_all(self, name: str, batches: DataFrame, time: str, policy: ops.Policy, columns: Mapping[str, str] | None = None, times: DataFrame | None = None) -> ops.Counts:
        """Many deltas, told apart by column time, into a table in one pass; the same as merging them in that order."""
        config = self.config(name)
        keys = list(config.primary_keys)
        rows = batches.select(*(F.col(s).alias(t) for s, t in (columns or {c: c for c in batches.columns if c in config.names}).items() if s in batches.columns), time, *([ops.ORD] if ops.ORD in batches.columns else []))
        kinds = config.kinds
        if config.collation:
            rows = cast_columns(rows, {n: k for n, k in kinds.items() if isinstance(k, T.StringType)})
        ops.check_types(rows.schema, config.fields, {c: c for c in rows.columns}, kinds)
        every = batches.select(time).distinct()
        times = every if times is None else every.unionByName(times.select(time)).distinct()
        rows = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
        rows = ops.resolve_duplicates(rows, [*keys, time], policy.on_duplicate_key).drop(ops.ORD)
        dropout = policy.row_finality == "dropout"
        current = self.live(name, located=not dropout)
        if not dropout and self._entry(name)["current"]:  # rows of other keys stay where they are
            current = stage(lookup_join(current, rows.select(*keys).distinct(), keys, "left_semi"), "touched")
        was = current if config.is_temporal else current.withColumn(FROM, moment(EPOCH))
        out = stage(bulk_history(was.select(*config.names, FROM), rows, keys, config.fields, time, dropout, times), "history")
        first = times.agg(F.min(time)).first()[0]
        live = F.col(TO) == moment(SENTINEL)
        fresh = F.unix_micros(FROM) >= F.unix_micros(F.lit(first)) if first is not None else F.lit(False)
        n = out.agg(F.count_if(fresh), F.count_if(~live), F.count_if(live)).first()
        ended = out.where(~live) if config.is_temporal and n[1] else None
        if dropout:
            self.put(name, live=out.where(live), ended=ended, grown=n[2])
        elif n[0] or n[1]:
            dead = current.count() if self._entry(name)["current"] else 0
            self.put(name, append=out.where(live), gone=current if dead else None, ended=ended, grown=n[2] - dead, dead=dead)
        return ops.Counts(inserts=n[0], deletions=n[1])

    def check(self, name: str, rows: DataFrame, added: bool = False) -> None:
        """ValueError if rows break the table's constraints: nulls, repeated keys, unknown parents, texts too long.
        added: the rows come to those that are there, of which only the keys are read and looked up."""
        config = self.config(name)
        needed = [f.name for f in config.fields if not f.nullable and f.name in rows.columns]
        if needed:
            r = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in needed)).first()
            bad = [c for c in needed if r[c]]
            if bad:
                raise ValueError(f"{name}: nulls in {bad}")
        long_ = ops.too_long(rows, config.fields) if any(ops.text_length(c.data_type) for c in config.columns if c.name in rows.columns) else None
        if long_ is not None:
            bad = [c for c, v in long_.first().asDict().items() if v]
            if bad:
                raise ValueError(f"{name}: texts too long in {bad}")
        for cols in [list(config.primary_keys), *config.unique_sets]:
            if cols and set(cols) <= set(rows.columns):
                twice = rows.dropna(subset=cols).groupBy(*cols).count().where("count > 1").limit(1).collect()
                if not twice and added and self._entry(name)["current"]:
                    twice = self.live(name).select(*cols).join(rows.select(*cols), cols, "left_semi").limit(1).collect()
                if twice:
                    raise ValueError(f"{name}: duplicate {cols}: {[twice[0][c] for c in cols]}")
        for fk in config.foreign_keys:
            parent = f"{fk.schema}.{fk.table}"
            if fk.name in rows.columns and self.exists(parent):
                mine = rows.select(F.col(fk.name).alias("k")).where("k IS NOT NULL").distinct()
                lost = mine.join(self.live(parent).select(F.col(fk.column).alias("k")), "k", "left_anti").limit(1).collect()
                if lost:
                    raise ValueError(f"{name}: no row {fk.column} = {lost[0][0]} in {parent}")

    def commit(self) -> int:
        """Makes it all visible; CommitConflict if another transaction was committed since this one began."""
        return self.db.log.commit(self.base + 1, self.state)


class Database:
    """Schemas of tables below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root)

    def begin(self) -> Transaction:
        return Transaction(self)

    def timed(self, description: str, action):
        """The result of action; how long it took goes to the shared clock and the log."""
        began = clock.perf_counter()
        out = action()
        took = clock.perf_counter() - began
        Clock.shared().add_timing(description, took)
        LOG.info("%s: %.3f s", description, took)
        return out

    # --- definition

    def create_schema(self, schema: str) -> None:
        """Nothing if the schema exists. Tables of schemas that were not made are taken too."""
        tx = self.begin()
        if schema not in tx.state.setdefault("schemas", []):
            tx.state["schemas"] = sorted([*tx.state["schemas"], schema])
            tx.commit()

    def schemas(self) -> list[str]:
        """Schemas made and those of the tables there are."""
        state = self.begin().state
        return sorted({*state.get("schemas", ()), *(n.split(".", 1)[0] for n in state["catalog"])})

    def create(self, config: TableConfig) -> None:
        self.create_all(TableConfigs([config]))

    def create_all(self, configs: TableConfigs) -> None:
        tx = self.begin()
        if any(not tx.exists(c.full_name) for c in configs.items):
            for c in configs.ordered():
                tx.create(c)
            tx.commit()

    def drop(self, schema: str, name: str) -> None:
        tx = self.begin()
        tx.drop(f"{schema}.{name}")
        tx.commit()

    def drop_all(self, configs: TableConfigs) -> None:
        """Children before their parents."""
        tx = self.begin()
        for c in reversed(configs.ordered()):
            tx.drop(c.full_name)
        tx.commit()

    def table_exists(self, schema: str, name: str) -> bool:
        return self.begin().exists(f"{schema}.{name}")

    def table_config(self, schema: str, name: str) -> TableConfig:
        return self.begin().config(f"{schema}.{name}")

    def primary_keys(self, schema: str, name: str, include_temporal: bool = False) -> list[str]:
        c = self.table_config(schema, name)
        return [*c.primary_keys, *(VALIDITY[1:] if include_temporal and c.is_temporal else ())]

    def column_intersection(self, schema: str, name: str, columns: Sequence[str] | None) -> list[str]:
        names = self.table_config(schema, name).names
        return names if columns is None else [n for n in names if n in set(columns)]

    def has_all_columns(self, schema: str, name: str, columns: Sequence[str]) -> bool:
        return set(columns) <= set(self.table_config(schema, name).names)

    def is_temporal(self, schema: str, name: str) -> bool:
        return self.table_config(schema, name).is_temporal

    def variables(self, like: str | None = None) -> DataFrame:
        """One row of the session's settings, those whose name matches an SQL pattern."""
        pattern = None if like is None else re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in like))
        found = sorted((r.key, r.value) for r in self.spark.sql("SET").collect() if pattern is None or pattern.fullmatch(r.key))
        if not found:
            return self.spark.createDataFrame([], T.StructType([]))
        return self.spark.createDataFrame([tuple(v for _, v in found)], T.StructType([T.StructField(k, T.StringType()) for k, _ in found]))

    # --- reading

    def from_table(self, schema: str, name: str, time_slice: TimeSlice | None = None) -> DataFrame:
        return self.begin().versions(f"{schema}.{name}", time_slice or TimeSlice())

    def from_selectable(self, query: DataFrame, schema_overrides: Mapping[str, T.DataType] | None = None) -> DataFrame:
        return cast_columns(query, dict(schema_overrides or {}))

    def from_raw_sql(self, query: str, schema_overrides: Mapping[str, T.DataType] | None = None) -> DataFrame:
        """SQL over tables named schema.table. Validity columns show only if the query names them; a table may be
        followed by FOR SYSTEM_TIME ALL or FOR SYSTEM_TIME AS OF 'time'. Only names where a table stands, and those that
        qualify a column, are read as tables: literals, comments and other names stay as they are."""
        tx = self.begin()
        text, tables, names = rewrite(query, tx.state["catalog"])
        wants, tag = any(n.startswith("__valid_") for n in names), uuid.uuid4().hex[:12]
        views = {v: f"{v}_{tag}" for v in tables}
        try:
            for v, (full, at) in tables.items():
                df = tx.versions(full, at)
                (df if wants else df.drop(*VALIDITY)).createOrReplaceTempView(views[v])
            return self.from_selectable(self.spark.sql(text.format_map(views)), schema_overrides)
        finally:
            for v in views.values():
                self.spark.catalog.dropTempView(v)

    def table_query(self, schema: str, name: str, query_df: DataFrame, column_selection: Sequence[str] | None = None, time_slice: TimeSlice = TimeSlice()) -> DataFrame:
        """The table's rows, in the slice, whose values equal those of some row of query_df in all of its columns. Nulls
        equal nothing. Whether the lookup is broadcast is Spark's choice by its size."""
        rows = self.from_table(schema, name, time_slice)
        out = rows.join(query_df.distinct(), query_df.columns, "left_semi").select(*rows.columns)
        keep = [c for c in rows.columns if column_selection is None or c in column_selection or c in VALIDITY]
        return out.select(*keep)

    def row_count(self, schema: str, name: str) -> int:
        return self.from_table(schema, name).count()

    # --- writing

    def table_create(self, schema: str, name: str, df: DataFrame, primary_keys: Sequence[str] = (), tbl_for_types: tuple[str, str] | None = None, is_temporary_table: bool = False) -> None:
        types = {c.name: c.data_type for c in self.table_config(*tbl_for_types).columns} if tbl_for_types else None
        config = TableConfig.from_dataframe(df, schema, name, primary_keys, types=types)
        if is_temporary_table:
            cast_columns(df, {c.name: c.kind for c in config.columns}).createOrReplaceTempView(name)
        else:
            self.create(config)

    def table_insert(self, df: DataFrame, schema: str, name: str, uniqueness_col_set: Sequence[str] = (), prefill_nulls_with_default: bool = False, clear_table_first: bool = False, update_time: datetime | None = None, validate: bool = True) -> int:
        """Adds rows, of those alike in uniqueness_col_set the last; with clear_table_first in place of all others, even
        if there are none. Returns how many."""
        full, tx = f"{schema}.{name}", self.begin()
        config = tx.config(full)
        rows = df.select(*(c for c in df.columns if c in config.names), *([ops.ORD] if ops.ORD in df.columns else []))
        kinds = config.kinds
        rows = cast_columns(rows, kinds)
        defaults = {c.name: (c.default_value, c.kind) for c in config.columns if c.default_value is not None}
        if prefill_nulls_with_default:
            rows = ops.fill_defaults(rows, defaults)
        rows = ops.dedupe(rows, uniqueness_col_set).drop(ops.ORD) if uniqueness_col_set else rows.drop(ops.ORD)
        auto = next((c for c in config.columns if c.autoincrement and c.name not in rows.columns), None)
        if auto is not None:
            high = max(tx._entry(full)["high"], tx.live(full).agg(F.max(auto.name)).first()[0] or 0)
            rows = dense_numbers(rows.withColumn("__row", F.monotonically_increasing_id()), [*rows.columns, "__row"], auto.name, high + 1).withColumn(auto.name, F.col(auto.name).cast(auto.kind)).drop("__row")
        rows = rows.withColumns({c.name: literal(c.default_value, c.kind) if c.default_value is not None else F.lit(None).cast(c.kind) for c in config.columns if c.name not in rows.columns})
        rows = stage(tx.stamped(config, rows.select(*config.names), utc(update_time)), "insert")
        if clear_table_first:
            tx.truncate(full)
        if validate:
            tx.check(full, rows.select(*config.names), added=not clear_table_first)
        n = rows.count()
        if n:
            tx.put(full, append=rows, grown=n)
        if auto is not None and n:
            tx._entry(full)["high"] = rows.agg(F.max(auto.name)).first()[0]
        tx.commit()
        return n

    def table_update(self, df: DataFrame, schema: str, name: str, primary_keys_override: Sequence[str] | None = None, update_time: datetime | None = None) -> None:
        """Sets the columns that df and the table share where the keys match."""
        full, tx = f"{schema}.{name}", self.begin()
        config = tx.config(full)
        keys = list(primary_keys_override or config.primary_keys)
        rows = ops.dedupe(cast_columns(df.select(*(c for c in df.columns if c in config.names)), config.kinds), keys)
        fields = [ops.Field(f.name, f.data_type) for f in config.fields]
        hit = tx.live(full, located=True).join(rows.select(*keys).distinct(), keys, "left_semi")
        new = ops.update_matched(hit.withColumn("__was", F.struct(*config.names)), rows, keys, fields)
        alike = reduce(lambda a, b: a & b, (F.col(f"__was.{c}").eqNullSafe(F.col(c)) for c in config.names))
        changed = stage(new.where(~alike), "changed")
        n, t = changed.count(), moment(utc(update_time))
        if n:
            old = changed.select(*(F.col(f"__was.{c}").alias(c) for c in config.names), *([FROM, t.alias(TO)] if config.is_temporal else []))
            append = changed.withColumn(FROM, t) if config.is_temporal else changed
            tx.put(full, append=append, gone=changed, ended=old.where(F.col(FROM) < F.col(TO)) if config.is_temporal else None, dead=n)
            tx.commit()

    def table_delete_rows(self, df: DataFrame, schema: str, name: str) -> int:
        return self.table_delete_rows_temporal(df, schema, name, None)

    def table_delete_rows_temporal(self, df: DataFrame, schema: str, name: str, update_time: datetime | None = None) -> int:
        """Deletes, from a temporal table ends, the rows with df's keys, a part of the primary key. Returns how many."""
        full, tx = f"{schema}.{name}", self.begin()
        config = tx.config(full)
        if not set(df.columns) <= set(config.primary_keys) or not df.columns:
            raise ValueError("all columns must belong to the primary key")
        live = tx.live(full, located=True)
        gone = stage(live.join(df.distinct(), df.columns, "left_semi").select(*live.columns), "gone")
        n = gone.count()
        if n:
            t = moment(utc(update_time))
            ended = gone.withColumn(TO, t).where(F.col(FROM) < F.col(TO)) if config.is_temporal else None
            tx.put(full, gone=gone, ended=ended, grown=-n, dead=n)
            tx.commit()
        return n

    def table_upsert_temporal(self, df: DataFrame, schema: str, name: str, policy: ops.Policy, update_time: datetime | None = None, src_tgt_colname_map: Mapping[str, str] | None = None) -> ops.Counts:
        """Merges df into the table at update_time (now if None)."""
        full, tx = f"{schema}.{name}", self.begin()
        config = tx.config(full)
        columns = {c: (src_tgt_colname_map or {}).get(c, c) for c in df.columns}
        columns = {s: t for s, t in columns.items() if t in config.names}
        if not columns:
            raise ValueError("no columns in common")
        kinds = config.kinds
        rows = cast_columns(df, {s: kinds[t] for s, t in columns.items()})
        if policy.prefill_nulls_with_default:
            rows = ops.fill_defaults(rows, {s: (c.default_value, c.kind) for s, t in columns.items() for c in config.columns if c.name == t and c.default_value is not None})
        counts = tx.merge(full, rows, utc(update_time), policy, True, columns)
        tx.commit()
        return counts
