"""The upsert algebra: deltas against a table's live rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.temporal import FROM, SENTINEL, TO, moment
from tidemark.types import literal, text_length

#: Column with the order of arrival; where it is missing rows are ordered by all their columns.
ORD = "__ord"
#: Where a stored row lies: its file and position; merges pass it on.
PLACE = ("__file", "__pos")
#: What becomes of a row in a merge.
OP = "__op"
KEEP, CLOSE, UPDATE, INSERT = "keep", "close", "update", "insert"


@dataclass(frozen=True)
class Field:
    """A target column: SQL type, whether null is allowed, default as text, whether the table numbers it by itself."""

    name: str
    data_type: str
    nullable: bool = True
    default: str | None = None
    autoincrement: bool = False


@dataclass(frozen=True)
class Policy:
    """How deltas are applied. row_finality: disabled and manual never delete, dropout ends what a delta lacks."""

    drop_unchanged_rows: bool = False
    on_duplicate_key: str = "error"
    prefill_nulls_with_default: bool = False
    row_finality: str = "disabled"

    def __post_init__(self) -> None:
        if self.on_duplicate_key not in ("error", "take_last", "take_first"):
            raise ValueError(f"unknown on_duplicate_key {self.on_duplicate_key}")
        if self.row_finality not in ("disabled", "dropout", "manual"):
            raise ValueError(f"unknown row_finality {self.row_finality}")


@dataclass
class Counts:
    inserts: int = 0
    updates: int = 0
    deletions: int = 0

    def __iter__(self):
        return iter((self.inserts, self.updates, self.deletions))

    def __bool__(self) -> bool:
        return any(self)


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Whether two structs agree in columns, null equal to null."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns), F.lit(True))


def dedupe(df: DataFrame, keys: Sequence[str] = (), keep: str = "last", order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the last, the first, or with keep none only rows without a double.

    Keys that df lacks are left out; with none left whole rows are compared. order: by what first and last are told
    apart (ORD if present, then all columns), so that the choice never depends on the partitioning. Null is a key.
    The reduction is an aggregate with map-side combine, so a key with many rows does not reach one task whole.
    """
    cols = [c for c in df.columns if c != ORD]
    keys = [k for k in keys if k in df.columns] or cols
    order = list(order or ([ORD] if ORD in df.columns else [])) + cols
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rank = F.struct(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)))
    pick = F.min_by if keep == "first" else F.max_by
    g = df.groupBy(*(f"`{k}`" for k in keys)).agg(pick(row, rank).alias("__row"), F.count(F.lit(1)).alias("__n"))
    if keep == "none":
        g = g.where("__n = 1")
    return g.select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns))


def resolve_duplicates(delta: DataFrame, keys: Sequence[str], policy: str) -> DataFrame:
    """delta with one row per key. error: equal rows are one, different ones of a key fail the job."""
    if policy != "error":
        return dedupe(delta, keys, "last" if policy == "take_last" else "first")
    cols = [c for c in delta.columns if c != ORD]
    row = F.struct(*(F.col(f"`{c}`") for c in cols))
    g = delta.groupBy(*(f"`{k}`" for k in keys)).agg(F.min(row).alias("__row"), F.max(row).alias("__other"), *([F.max(ORD).alias(ORD)] if ORD in delta.columns else []))
    many = F.raise_error(F.concat(F.lit("duplicate key "), F.to_json(F.struct(*keys)))).cast("boolean")
    g = g.where(F.when(F.col("__row").eqNullSafe(F.col("__other")), True).otherwise(many))
    return g.select(*(F.col(ORD) if c == ORD else F.col(f"__row.`{c}`").alias(c) for c in delta.columns))


def fill_defaults(df: DataFrame, defaults: Mapping[str, tuple[str, T.DataType]]) -> DataFrame:
    """Nulls replaced by defaults written as text."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), literal(v, k)) for c, (v, k) in defaults.items() if c in df.columns})


def new_value(f: Field, kind: T.DataType, source: Column, target: Column) -> Column:
    """What an update writes: null overwrites where the target may be null; else the default stands in for it, or the
    target's value where there is none."""
    if f.nullable:
        return source
    return F.coalesce(source, literal(f.default, kind)) if f.default is not None else F.coalesce(source, target)


def drop_missing(target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target rows whose key the delta lacks; an empty delta lacks all."""
    return target.join(delta.select(*keys), list(keys), "left_anti")


def drop_unchanged(delta: DataFrame, target: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """delta without the rows that target holds alike in columns (null equals null). Columns must hold a key."""
    if not set(keys) & set(columns):
        raise ValueError("no key among the compared columns")
    cond = [delta[c].eqNullSafe(target[c]) for c in columns]
    return delta.join(target.select(*columns), cond, "left_anti")


def update_matched(target: DataFrame, delta: DataFrame, keys: Sequence[str], fields: Sequence[Field]) -> DataFrame:
    """target with the delta's values (one row per key) where a key matches. Null keys never do."""
    kinds = {f.name: f.dataType for f in target.schema.fields}
    values = [f for f in fields if f.name in delta.columns and f.name in kinds and f.name not in keys and not f.autoincrement]
    d = delta.select(*keys, F.struct(*(F.col(f.name) for f in values), F.lit(True).alias("__hit")).alias("__new"))
    out = target.join(d, list(keys), "left")
    hit = F.col("__new").isNotNull()
    changed = {f.name: F.when(hit, new_value(f, kinds[f.name], F.col(f"__new.{f.name}"), F.col(f.name))).otherwise(F.col(f.name)) for f in values}
    return out.withColumns(changed).select(*target.columns)


def insert_new(target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The delta rows whose key the target lacks and is null in no part."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return delta.where(whole).join(target.select(*keys), list(keys), "left_anti")


def check_types(source: T.StructType, target: Sequence[Field], columns: Mapping[str, str], kinds: Mapping[str, T.DataType]) -> None:
    """ValueError if a source column's type isn't that of the target column it goes to; all columns are looked at."""
    have = {f.name: f.dataType for f in source.fields}
    bad = [f"{s} ({have[s].simpleString()}) -> {t} ({kinds[t].simpleString()})" for s, t in columns.items() if s in have and t in kinds and have[s] != kinds[t]]
    if bad:
        raise ValueError("types differ: " + ", ".join(bad))


def too_long(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """One row: per text column with a length how many values are longer than that."""
    limits = {f.name: text_length(f.data_type) for f in fields}
    return df.agg(*(F.count_if(F.length(c) > n).alias(c) for c, n in limits.items() if n is not None and c in df.columns))


@dataclass(frozen=True)
class Merge:
    """A merge of a delta into live rows at one time."""

    keys: Sequence[str]
    fields: Sequence[Field]
    at: datetime
    policy: Policy = field(default_factory=Policy)
    main: bool = True

    def plan(self, current: DataFrame, delta: DataFrame) -> DataFrame:
        """Both joined once by key, each row with OP: keep (live row as it is), close (live row that ends: dropped out),
        update (struct old to history, new live), insert. __same marks delta rows that change nothing.

        current has the fields and FROM, delta any of the fields and maybe ORD. Null keys of the delta are left out. A
        live row that begins after the merge's time and would change fails the job.
        """
        keys, names = list(self.keys), [f.name for f in self.fields]
        kinds = {f.name: f.dataType for f in current.schema.fields}
        d = resolve_duplicates(delta.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))), keys, self.policy.on_duplicate_key).drop(ORD)
        given = [n for n in names if n in d.columns]
        where = [c for c in PLACE if c in current.columns]
        old = current.select(*(F.col(k).alias(f"__o_{k}") for k in keys), F.struct(*names, FROM, *where).alias("old"))
        new = d.select(*(F.col(k).alias(f"__n_{k}") for k in keys), F.struct(*given).alias("new"))
        j = old.join(new, [F.col(f"__o_{k}") == F.col(f"__n_{k}") for k in keys], "full")
        both = F.col("old").isNotNull() & F.col("new").isNotNull()
        after = []
        for f in self.fields:
            src = F.col(f"new.{f.name}") if f.name in given else None
            was = F.col(f"old.{f.name}")
            fresh = literal(f.default, kinds[f.name]) if f.default is not None else F.lit(None).cast(kinds[f.name])
            if f.autoincrement and f.name not in keys:
                src = None
            when_new = src if src is not None else fresh
            when_old = was if src is None or f.name in keys else new_value(f, kinds[f.name], src, was)
            after.append(F.when(both, when_old).otherwise(when_new).alias(f.name))
        j = j.withColumn("after", F.struct(*after))
        raw = reduce(lambda a, b: a & b, (F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in given))
        j = j.withColumn("__same", both & raw).withColumn("__alike", same("old", "after", names))
        t = moment(self.at)
        change = both & ~F.col("__alike")
        if self.main and self.policy.drop_unchanged_rows:
            change = change & ~F.col("__same")
        ends = F.col("new").isNull() & F.lit(self.policy.row_finality == "dropout")
        op = F.when(F.col("old").isNull(), INSERT).when(change, UPDATE).when(ends, CLOSE).otherwise(KEEP)
        late = F.raise_error(F.lit(f"a live row is newer than the update time {self.at}")).cast("string")
        j = j.withColumn(OP, op).withColumn(OP, F.when(F.col(OP).isin(UPDATE, CLOSE) & (F.col(f"old.{FROM}") > t), late).otherwise(F.col(OP)))
        return j.select(OP, "__same", "old", "after")

    def live(self, plan: DataFrame) -> DataFrame:
        """The rows that are live after the merge."""
        names = [f.name for f in self.fields]
        kept = F.col(OP) == KEEP
        return plan.where(F.col(OP) != CLOSE).select(
            *(F.when(kept, F.col(f"old.{n}")).otherwise(F.col(f"after.{n}")).alias(n) for n in names), F.when(kept, F.col(f"old.{FROM}")).otherwise(moment(self.at)).alias(FROM), moment(SENTINEL).alias(TO)
        )

    def fresh(self, plan: DataFrame) -> DataFrame:
        """The live rows that the merge makes."""
        new = plan.where(F.col(OP).isin(UPDATE, INSERT))
        return new.select(*(F.col(f"after.{f.name}").alias(f.name) for f in self.fields), moment(self.at).alias(FROM), moment(SENTINEL).alias(TO))

    def closed(self, plan: DataFrame) -> DataFrame:
        """The versions that the merge ended; one that held for no time leaves no trace."""
        names = [f.name for f in self.fields]
        out = plan.where(F.col(OP).isin(CLOSE, UPDATE)).select(*(F.col(f"old.{n}").alias(n) for n in names), F.col(f"old.{FROM}").alias(FROM), moment(self.at).alias(TO))
        return out.where(F.col(FROM) < F.col(TO))

    def counts(self, plan: DataFrame) -> Counts:
        """Rows inserted, updated, and deleted: ended ones and, for a main table that drops them, unchanged delta rows."""
        r = plan.agg(F.count_if(F.col(OP) == INSERT), F.count_if(F.col(OP) == UPDATE), F.count_if(F.col(OP) == CLOSE), F.count_if("__same")).first()
        return Counts(r[0], r[1], r[2] + (r[3] if self.main and self.policy.drop_unchanged_rows else 0))
