"""Work on keys of which a few may hold a large share of all rows.

A group is never given to one task whole: a hot key's rows are cut into ranges of their order, windows run
within (key, range), and what crosses a border of two ranges is carried over by a table of one row per range.
Which keys are hot, and how many ranges there are, follows from the counted rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage

RANGE = "__range"
#: A key with more rows than this is hot: about what a task sorts in a second.
HOT_ROWS = 500_000
#: A table is broadcast up to this size.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Ranged:
    """Rows of keys that are whole (ranges 0), or of hot keys with RANGE, which grows with their order."""

    df: DataFrame
    keys: tuple[str, ...]
    ranges: int = 0

    @property
    def by(self) -> list[str]:
        """The columns within whose values windows run."""
        return [*self.keys, RANGE] if self.ranges else list(self.keys)

    def on(self, df: DataFrame) -> "Ranged":
        """The same ranges after df was made of the rows, keeping by."""
        return Ranged(df, self.keys, self.ranges)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, about how many bytes they take in memory, nested values by their text); runs df once."""
    per = F.lit(16)
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            per = per + F.coalesce(F.octet_length(f.name), F.lit(0)) + 24
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            per = per + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + 32
        else:
            per = per + 16
    n, size = df.agg(F.count(F.lit(1)), F.sum(per.cast("long"))).first()
    return int(n), int(size or 0)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, row_bytes: int = 64, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int] | None:
    """(table of keys, measured to be small enough to broadcast, number of their rows) of the keys with more than hot_rows
    rows; None if there are none. Counted with map-side aggregation; the driver gets three numbers.

    If there are so many that they, or rows of row_bytes each, would not fit broadcast_bytes, only the larger ones are
    taken: those left whole then have about row_bytes / broadcast_bytes of all rows each, or less.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    n, rows = counts.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if not n:
        return None
    counts, least = stage(counts, "hot"), hot_rows
    _, size = measure(counts)
    while max(size, n * row_bytes) > broadcast_bytes:
        least *= 4
        n, size = measure(counts.where(F.col("__n") > least))
    if least > hot_rows and n:
        rows = counts.where(F.col("__n") > least).agg(F.sum("__n")).first()[0]
    return (counts.where(F.col("__n") > least).select(*keys), int(rows)) if n else None


def matches(df: DataFrame, keys: Sequence[str], table: DataFrame, how: str) -> DataFrame:
    """df's rows whose keys are (left_semi) or aren't (left_anti) in a small table; null equals null."""
    t = table.select(*(F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)))
    return df.join(F.broadcast(t), [F.col(k).eqNullSafe(F.col(f"__hot_{i}")) for i, k in enumerate(keys)], how)


def in_parts(df: DataFrame, keys: Sequence[str], order: str, work: Callable[[Ranged], DataFrame], hot_rows: int = HOT_ROWS, reduce: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """work on the rows of keys that are whole, and on those of hot keys in ranges by order; both results as one.

    df is read once, or three times if there are hot keys: give a staged or plainly read one. The hot keys' rows are
    reduced first, so that no order value has many of them, then partitioned by (keys, order) to half of hot_rows each;
    a partition is a range.
    """
    keys = tuple(keys)
    hot = hot_keys(df, keys, hot_rows)
    # exchanged before any window, as what windows compare would else be worked out and moved as well
    if hot is None:
        return work(Ranged(df.repartition(*keys), keys))
    table, n = hot
    mine = matches(df, keys, table, "left_semi")
    ranges = max(2, math.ceil(2 * n / hot_rows))
    cut = (reduce(mine) if reduce else mine).repartitionByRange(ranges, *keys, order).withColumn(RANGE, F.spark_partition_id())
    cold = matches(df, keys, table, "left_anti").repartition(*keys)
    return work(Ranged(cold, keys)).unionByName(work(Ranged(stage(cut, "ranges"), keys, ranges)))


def _ends(df: DataFrame, rows: Ranged, ends: DataFrame) -> DataFrame:
    """df with __nb_0.. of a table of one row per key and range, which is measured and broadcast if it is small."""
    own = {k: f"__nb_key_{i}" for i, k in enumerate(rows.keys)}
    ends = stage(ends.withColumnsRenamed({**own, RANGE: "__nb_range"}), "ends")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in own.items()] + [F.col(RANGE) == F.col("__nb_range")]
    small = measure(ends)[1] <= BROADCAST_BYTES
    return df.join(F.broadcast(ends) if small else ends.hint("merge"), same, "left").drop("__nb_range", *own.values())


def neighbour(rows: Ranged, order: Sequence[str], values: Mapping[str, Column | str], step: int, name: str) -> Ranged:
    """Adds struct name of values, taken from the next (step 1) or previous (step -1) row of the key in order; null where there is none."""
    return neighbours(rows, order, [(values, step, name)])


def neighbours(rows: Ranged, order: Sequence[str], wanted: Sequence[tuple[Mapping[str, Column | str], int, str]]) -> Ranged:
    """neighbour for several (values, step, name) at once.

    order must be unique within a key. Hot keys: the first (last) row of each range is kept per range and joined to
    where the range before (after) it ends; for that the rows are read once more.
    """
    df, keys = rows.df, rows.keys
    w = Window.partitionBy(*rows.by).orderBy(*order)
    found = [(F.struct(*(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in values.items())), step, name) for values, step, name in wanted]
    out = df.withColumns({name: (F.lead(value) if step > 0 else F.lag(value)).over(w) for value, step, name in found})
    if rows.ranges:
        at = F.struct(*order)
        ends = df.groupBy(*rows.by).agg(*((F.min_by if step > 0 else F.max_by)(value, at).alias(f"__nb_{i}") for i, (value, step, _) in enumerate(found)))
        by = Window.partitionBy(*keys).orderBy(RANGE)
        ends = ends.select(*rows.by, *((F.lead if step > 0 else F.lag)(f"__nb_{i}").over(by).alias(f"__nb_{i}") for i, (_, step, _) in enumerate(found)))
        out = _ends(out, rows, ends).withColumns({name: F.coalesce(name, f"__nb_{i}") for i, (_, _, name) in enumerate(found)})
        out = out.drop(*(f"__nb_{i}" for i in range(len(found))))
    return rows.on(out)


def apart(rows: Ranged) -> Ranged:
    """Rows written once where they are read twice next."""
    return rows.on(stage(rows.df, "ranges")) if rows.ranges else rows


def carried(rows: Ranged, order: Sequence[str], columns: Sequence[str]) -> Ranged:
    """Each of columns with its nulls replaced by the key's last value before, in order. Hot keys: the last value of each
    range goes on to the next ranges by a table of one row per range."""
    if not columns:
        return rows
    df, keys = rows.df, rows.keys
    w = Window.partitionBy(*rows.by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({c: F.last(c, True).over(w) for c in columns})
    if rows.ranges:
        at = F.struct(*order)
        ends = df.groupBy(*rows.by).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"__nb_{i}") for i, c in enumerate(columns)))
        before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*rows.by, *(F.last(f"__nb_{i}", True).over(before).alias(f"__nb_{i}") for i in range(len(columns))))
        out = _ends(out, rows, ends).withColumns({c: F.coalesce(c, f"__nb_{i}") for i, c in enumerate(columns)})
        out = out.drop(*(f"__nb_{i}" for i in range(len(columns))))
    return rows.on(out)


def highest(rows: Ranged, values: Mapping[str, Column], order: Sequence[str] = ()) -> Ranged:
    """Adds each name of values: the key's highest value of the column, nulls left out; with order only of the row itself and
    those after it. Hot keys: the highest of each range goes to the others (with order, to those before) by a table of one
    row per range; for that the rows are read once more."""
    df, keys = rows.df, rows.keys
    w, by = Window.partitionBy(*rows.by), Window.partitionBy(*keys)
    if order:
        w = w.orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        by = by.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({n: F.max(v).over(w) for n, v in values.items()})
    if rows.ranges:
        ends = df.groupBy(*rows.by).agg(*(F.max(v).alias(f"__nb_{i}") for i, v in enumerate(values.values())))
        ends = ends.select(*rows.by, *(F.max(f"__nb_{i}").over(by).alias(f"__nb_{i}") for i in range(len(values))))
        out = _ends(out, rows, ends).withColumns({n: F.greatest(n, f"__nb_{i}") for i, n in enumerate(values)})
        out = out.drop(*(f"__nb_{i}" for i in range(len(values))))
    return rows.on(out)


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined (inner, left, left_semi) to small, unique by on, where one key may hold a large share of big.

    small is written once and measured. Up to broadcast_bytes it is broadcast. Beyond that big's keys are counted: small's
    rows of the hot ones are broadcast, as many as fit, and only the other rows of big are shuffled by key. Null keys
    match nothing.
    """
    on, small = list(on), stage(small, "lookup")
    n, size = measure(small)
    if size <= broadcast_bytes:
        return big.join(F.broadcast(small), on, how)
    hot = hot_keys(big.dropna(subset=on), on, hot_rows, max(64, size // max(n, 1) * 2), broadcast_bytes)
    if hot is None:
        return big.join(small.hint("merge"), on, how)
    mine, rest = matches(big, on, hot[0], "left_semi"), matches(big, on, hot[0], "left_anti")
    return mine.join(F.broadcast(small.join(F.broadcast(hot[0]), on, "left_semi")), on, how).unionByName(rest.join(small.hint("merge"), on, how))


def dense_numbers(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Adds name: start, start + 1, ... in the order of df's rows by order, which must be unique.

    Rows are range-partitioned and numbered within their partition; the driver gets one count per partition.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    kept = stage(sorted_, "numbers")
    counts = sorted((r["__part"], r["n"]) for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], start - 1
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = spark.createDataFrame(offsets, "__part int, __offset long")
    w = Window.partitionBy("__part").orderBy(*order)
    return kept.withColumn(name, F.row_number().over(w)).join(F.broadcast(table), "__part").withColumn(name, F.col(name) + F.col("__offset")).drop("__part", "__offset")
