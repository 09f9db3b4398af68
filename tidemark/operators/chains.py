"""History of changing entity attributes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import HOT_ROWS, Ranged, apart, in_parts, lookup_join, neighbour, neighbours
from tidemark.session import stage
from tidemark.store.deletions import FILE, POS
from tidemark.store.versioned import VersionedTable

#: Open end of a version, 2038-01-19T03:14:07.999999 in microseconds.
OPEN = 2147483647999999


def build_chains(updates: DataFrame, key: str, start: str, end: str, rank: tuple[str, ...], values: Mapping[str, Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, valid_from_us, valid_to_us, values): the versions of each key from its raw updates.

    start and end are timestamps; rows with a null key or start don't count, a null end is OPEN. Of rows with one key
    and start the one highest by rank counts (nulls lowest). A row holds until its end or the next counting row's start
    if that is sooner; a row that holds for no time makes no version but ends the one before. Versions that touch and
    agree in all values (null equals null) are one. No rows give no versions.

    A hot key's rows are worked on in ranges of time, so that no task has the key whole.
    """
    names = list(values)
    r = updates.select(
        F.col(key).alias("k"),
        F.unix_micros(start).alias("at"),
        F.coalesce(F.unix_micros(end), F.lit(OPEN)).alias("end"),
        F.struct(*rank).alias("rank"),
        *(v.alias(f"v{i}") for i, v in enumerate(values.values())),
    ).where("k IS NOT NULL AND at IS NOT NULL")
    cols = [f"v{i}" for i in range(len(names))]
    out = in_parts(r, ["k"], "at", lambda rows: _chains(rows, cols), hot_rows, lambda d: _highest(d, cols))
    return out.select(F.col("k").alias(key), "valid_from_us", "valid_to_us", *(F.col(c).alias(n) for c, n in zip(cols, names)))


def _highest(r: DataFrame, cols: list[str]) -> DataFrame:
    """One row per key and start, by an aggregate with map-side combine."""
    return r.groupBy("k", "at").agg(F.max(F.struct("rank", "end", *cols)).alias("row")).select("k", "at", "row.*").select(*r.columns)


def _chains(rows: Ranged, cols: list[str]) -> DataFrame:
    """All windows have one partitioning and one order, so the rows are exchanged and sorted once."""
    w = Window.partitionBy(*rows.by).orderBy("at", F.desc("rank"), F.desc("end"), *(F.desc(c) for c in cols))
    before = F.lag("at").over(w)
    one = rows.df.withColumn("before", before).where("before IS NULL OR before != at").drop("before", "rank")
    rows = neighbour(apart(rows.on(one)), ["at"], {"at": "at"}, 1, "next")
    held = rows.df.withColumn("to", F.least("end", F.coalesce("next.at", "end"))).drop("next", "end").where("to > at")
    rows = apart(rows.on(held))
    both = {"at": "at", "to": "to", **{c: c for c in cols}}
    rows = neighbours(rows, ["at"], [(both, -1, "before"), (both, 1, "after")])

    def joins(touch: Column, other: str) -> Column:
        for c in cols:
            touch = touch & F.col(f"{other}.{c}").eqNullSafe(F.col(c))
        return F.coalesce(touch, F.lit(False))

    marked = rows.df.select(*rows.by, "at", "to", *cols, (~joins(F.col("before.to") == F.col("at"), "before")).alias("first"), (~joins(F.col("after.at") == F.col("to"), "after")).alias("last"))
    # a version ends where its last row ends: that of its first row, or else of the next row that is first or last
    rows = neighbour(apart(rows.on(marked.where("first OR last"))), ["at"], {"to": "to"}, 1, "next")
    return rows.df.where("first").select("k", F.col("at").alias("valid_from_us"), F.when(F.col("last"), F.col("to")).otherwise(F.col("next.to")).alias("valid_to_us"), *cols)


def rebuild_chains(table: VersionedTable, raw: DataFrame, touched: DataFrame, key: str, hot_rows: int = HOT_ROWS, **how) -> int:
    """Rebuilds the chains of the keys in touched from all their raw updates and replaces them in table, in one commit.

    raw: every update so far, touched: the keys (any repeats) of new, late or corrected ones. Chains of other keys are
    neither rebuilt nor written. how: as of build_chains. A failed rebuild leaves the table as it was. The touched keys
    are broadcast if they are few, so neither raw nor the table is shuffled to find their rows.
    """
    keys = stage(touched.select(key).where(F.col(key).isNotNull()).distinct(), "touched")
    fresh = build_chains(lookup_join(raw, keys, [key], "left_semi", hot_rows=hot_rows), key, hot_rows=hot_rows, **how)
    gone = lookup_join(table.scan().select(FILE, POS, key), keys, [key], "left_semi", hot_rows=hot_rows) if table.exists() else None
    return table.commit(add=fresh, delete=gone)
