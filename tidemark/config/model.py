"""What tables and datasets are, from YAML."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.operators.delta import Field, Policy
from tidemark.types import spark_type, sql_type
from tidemark.utils import load_yaml, nested


@dataclass(frozen=True)
class ColumnConfig:
    name: str
    data_type: str
    default_value: str | None = None
    autoincrement: bool = False
    nullable: bool = True
    unique_constraint: tuple[str, ...] = ()

    @property
    def kind(self) -> T.DataType:
        return spark_type(self.data_type)


@dataclass(frozen=True)
class ForeignKey:
    """Column name of this table refers to a column of another one."""

    name: str
    schema: str
    table: str
    column: str

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> "ForeignKey":
        r = d["references"]
        return cls(d["name"], r["schema"], r["table"] if isinstance(r["table"], str) else r["table"].name, r["column"])


@dataclass(frozen=True)
class TableConfig:
    schema: str
    name: str
    columns: tuple[ColumnConfig, ...]
    primary_keys: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    is_temporal: bool = False
    forbid_drop_table: bool = False
    collation: str | None = None

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> "TableConfig":
        cols = tuple(c if isinstance(c, ColumnConfig) else ColumnConfig(**{**c, "unique_constraint": tuple(c.get("unique_constraint") or ()), "default_value": None if c.get("default_value") is None else str(c["default_value"])}) for c in d["columns"])
        fks = tuple(f if isinstance(f, ForeignKey) else ForeignKey.of(f) for f in d.get("foreign_keys") or ())
        out = cls(d["schema"], d["name"], cols, tuple(d.get("primary_keys") or ()), fks, bool(d.get("is_temporal")), bool(d.get("forbid_drop_table")), d.get("collation"))
        missing = {*out.primary_keys, *(f.name for f in fks)} - {c.name for c in cols}
        if missing:
            raise ValueError(f"{out.full_name}: unknown key columns {sorted(missing)}")
        return out

    @classmethod
    def from_yaml(cls, path: str) -> "TableConfig":
        return cls.of(load_yaml(path))

    @classmethod
    def from_dataframe(cls, df: DataFrame, schema: str, name: str, primary_keys: Sequence[str] = (), varchar_length: int = 255, types: Mapping[str, str] | None = None) -> "TableConfig":
        cols = tuple(ColumnConfig(f.name, (types or {}).get(f.name) or sql_type(f.dataType, varchar_length), nullable=f.name not in primary_keys) for f in df.schema.fields)
        return cls(schema, name, cols, tuple(primary_keys))

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def fields(self) -> list[Field]:
        keys = set(self.primary_keys)
        return [Field(c.name, c.data_type, c.nullable and c.name not in keys, c.default_value, c.autoincrement) for c in self.columns]

    @property
    def kinds(self) -> dict[str, T.DataType]:
        """Column types; texts compare by the table's collation, such as UNICODE_CI, or else by their bytes."""
        text = T.StringType(self.collation) if self.collation else None
        return {c.name: text if text is not None and isinstance(c.kind, T.StringType) else c.kind for c in self.columns}

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, k) for n, k in self.kinds.items()])

    @property
    def unique_sets(self) -> list[list[str]]:
        """Columns that must be unique together, by constraint name."""
        by: dict[str, list[str]] = {}
        for c in self.columns:
            for u in c.unique_constraint:
                by.setdefault(u, []).append(c.name)
        return list(by.values())

    def table_dependencies(self) -> list[str]:
        return [f.table for f in self.foreign_keys]

    def delta(self, name: str) -> "TableConfig":
        """The staging table for this one: no constraints, nulls everywhere but in the key."""
        cols = tuple(replace(c, nullable=c.name not in self.primary_keys, unique_constraint=(), autoincrement=False) for c in self.columns)
        return replace(self, name=name, columns=cols, foreign_keys=(), is_temporal=False)

    def to_dict(self) -> dict[str, Any]:
        return {
            "schema": self.schema,
            "name": self.name,
            "columns": [dict(c.__dict__, unique_constraint=list(c.unique_constraint)) for c in self.columns],
            "primary_keys": list(self.primary_keys),
            "foreign_keys": [{"name": f.name, "references": {"schema": f.schema, "table": f.table, "column": f.column}} for f in self.foreign_keys],
            "is_temporal": self.is_temporal,
            "forbid_drop_table": self.forbid_drop_table,
            "collation": self.collation,
        }


class TableConfigs:
    """Tables by name, parents before their children."""

    def __init__(self, items: Iterable[TableConfig | Mapping[str, Any]]):
        self.items = [t if isinstance(t, TableConfig) else TableConfig.of(t) for t in items]
        by = {t.name: t for t in self.items}
        for t in self.items:
            for f in t.foreign_keys:
                if f.table in by and f.column not in by[f.table].names:
                    raise ValueError(f"{t.full_name}: {f.table} has no column {f.column}")

    @classmethod
    def from_yamls(cls, *paths: str) -> "TableConfigs":
        return cls(TableConfig.from_yaml(p) for p in paths)

    def __getitem__(self, name: str) -> TableConfig:
        for t in self.items:
            if name in (t.name, t.full_name):
                return t
        raise KeyError(name)

    def names(self) -> list[str]:
        return [t.name for t in self.items]

    def schemas(self) -> list[str]:
        return sorted({t.schema for t in self.items})

    def ordered(self) -> list[TableConfig]:
        done: list[TableConfig] = []
        todo = list(self.items)
        while todo:
            ready = [t for t in todo if not ({*t.table_dependencies()} & {x.name for x in todo if x is not t})]
            if not ready:
                raise ValueError("foreign keys form a circle: " + ", ".join(t.name for t in todo))
            done += ready
            todo = [t for t in todo if t not in ready]
        return done


@dataclass(frozen=True)
class IngestColumn:
    """A column of a pipeline item. Its type: data, computed (no source), dsv_only (no target) or time_partition_only."""

    schema: str
    table: str
    source: str | None = None
    target: str | None = None
    column_type: str = "data"
    ingestion_data_type: str | None = None
    target_data_type: str | None = None
    transforms: Mapping[str, Any] = field(default_factory=dict)
    aggregation: str | None = None
    deduce_foreign_key: bool = False
    value_if_missing: str | None = None
    nullable: bool = True
    required: bool = False

    @property
    def name(self) -> str:
        """Its name in the delta."""
        return self.source or self.target or ""


@dataclass(frozen=True)
class PipelineItem:
    schema: str
    table: str
    type: str
    columns: tuple[IngestColumn, ...]

    def column_map(self) -> dict[str, str]:
        """Delta column -> table column of what goes to the table."""
        return {c.name: c.target for c in self.columns if c.target and c.column_type in ("data", "computed")}


@dataclass(frozen=True)
class Pipeline:
    items: tuple[PipelineItem, ...]

    @classmethod
    def of(cls, items: Sequence[Mapping[str, Any]]) -> "Pipeline":
        out = []
        for i in items:
            cols = []
            for c in i["columns"]:
                kind = c.get("column_type") or ("dsv_only" if c.get("target") is None else "computed" if c.get("source") is None else "data")
                missing = c.get("value_if_missing")
                given = {k: v for k, v in c.items() if v is not None and k not in ("column_type", "value_if_missing")}
                cols.append(IngestColumn(i["schema"], i["table"], column_type=kind, value_if_missing=None if missing is None else str(missing), **given))
            out.append(PipelineItem(i["schema"], i["table"], i.get("type") or "extract", tuple(cols)))
        if len({(i.schema, i.table) for i in out if i.type == "primary"}) != 1:
            raise ValueError("a pipeline needs exactly one primary table")
        return cls(tuple(out))

    @property
    def primary(self) -> PipelineItem:
        return next(i for i in self.items if i.type == "primary")

    def table_names(self) -> list[str]:
        return list(dict.fromkeys(i.table for i in self.items))

    def header_map(self, table: str) -> dict[str, str]:
        """Table column -> delta column."""
        return {t: s for i in self.items if i.table == table for s, t in i.column_map().items()}

    def resolved(self, tables: TableConfigs) -> list[IngestColumn]:
        """All columns, each name once, with both types: the target's is what is given, or the table's, or the
        ingestion's; the ingestion's is what is given, or the table's, or the target's. The primary item's definition
        of a name wins; ValueError where no type is known."""
        out: dict[str, IngestColumn] = {}
        for i in sorted(self.items, key=lambda i: i.type != "primary"):
            table = tables[i.table] if i.table in tables.names() else None
            for c in i.columns:
                stored = next((x.data_type for x in table.columns if x.name == c.target), None) if table else None
                target = c.target_data_type or stored or c.ingestion_data_type
                ingestion = c.ingestion_data_type or stored or c.target_data_type
                if target is None or ingestion is None:
                    raise ValueError(f"no type for column {c.name} of {i.table}")
                out.setdefault(c.name, replace(c, target_data_type=target, ingestion_data_type=ingestion))
        order = [c.name for i in self.items for c in i.columns]
        return [out[n] for n in dict.fromkeys(order)]

    def delta_columns(self, tables: TableConfigs) -> list[ColumnConfig]:
        return [ColumnConfig(c.name, c.target_data_type or "") for c in self.resolved(tables) if c.column_type in ("data", "computed")]


@dataclass(frozen=True)
class TimePartition:
    column: str
    bucket_interval: str
    bucket_strategy: str = "round_up"
    unique_strategy: str = "last"


@dataclass(frozen=True)
class InputConfig:
    """Where a dataset comes from: type dsv (search_paths) or nats-jetstream (jetstream, payload_ingest, run_until).
    late_messages: load, or reject for items older than the newest audited one to go to the dataset's reject table. files_per_batch: files loaded in one transaction, each at its own time; not for
    datasets with dropout, where a file ends what it lacks."""

    type: str
    search_paths: tuple[Mapping[str, Any], ...] = ()
    filter_past_events: bool = False
    delimiter: str | None = None
    jetstream: Mapping[str, Any] = field(default_factory=dict)
    payload_ingest: Mapping[str, Any] = field(default_factory=dict)
    run_until: str = "empty"
    late_messages: str = "load"
    files_per_batch: int = 1
    options: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, d: Mapping[str, Any], base: str | None) -> "InputConfig":
        if d.get("type") not in ("dsv", "nats-jetstream"):
            raise ValueError(f"unsupported input type {d.get('type')}")
        if d.get("run_until", "empty") not in ("empty", "forever"):
            raise ValueError(f"unknown run_until {d['run_until']}")
        if d.get("late_messages", "load") not in ("load", "reject"):
            raise ValueError(f"unknown late_messages {d['late_messages']}")
        paths = []
        for p in d.get("search_paths") or ():
            root = p["root_path"]
            if not os.path.isabs(root) and "://" not in root and not root.startswith("file:"):
                root = os.path.abspath(os.path.join(os.path.dirname(base) if base else os.getcwd(), root))
            paths.append({**p, "root_path": root})
        known = {k: d[k] for k in ("filter_past_events", "delimiter", "jetstream", "payload_ingest", "run_until", "late_messages", "files_per_batch") if d.get(k) is not None}
        return cls(d["type"], tuple(paths), options={k: v for k, v in d.items() if k not in known and k not in ("type", "search_paths")}, **known)


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    delta_table_schema: str
    input_config: InputConfig
    pipeline: Pipeline
    scrape_limit: int = -1
    time_partition: TimePartition | None = None
    null_values: tuple[str, ...] | None = None
    delta_config: Policy = field(default_factory=Policy)
    is_temporary_table: bool = True

    @classmethod
    def of(cls, d: Mapping[str, Any], base: str | None = None) -> "DatasetConfig":
        policy = dict(d.get("delta_config") or {})
        temporary = policy.pop("is_temporary_table", True)
        tp = d.get("time_partition")
        return cls(
            d["name"],
            d.get("delta_table_schema", ""),
            d["input_config"] if isinstance(d["input_config"], InputConfig) else InputConfig.of(d["input_config"], base),
            Pipeline.of(d["pipeline"]),
            d.get("scrape_limit") or -1,
            TimePartition(**tp) if tp else None,
            tuple(d["null_values"]) if d.get("null_values") is not None else None,
            Policy(**policy),
            temporary,
        )


@dataclass(frozen=True)
class EngineConfig:
    tables: TableConfigs
    datasets: tuple[DatasetConfig, ...]
    raw: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, filename: str, table_configs_path: str = "table_configs", datasets_path: str = "datasets") -> "EngineConfig":
        tree = load_yaml(filename)
        return cls(TableConfigs(nested(tree, table_configs_path)), tuple(DatasetConfig.of(d, filename) for d in nested(tree, datasets_path)), tree)

    def dataset(self, name: str) -> DatasetConfig | None:
        return next((d for d in self.datasets if d.name == name), None)
