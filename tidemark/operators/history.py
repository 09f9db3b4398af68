"""A whole series of deltas as versions, in one pass instead of one merge per delta."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.delta import Field
from tidemark.operators.skew import HOT_ROWS, Ranged, apart, carried, in_parts, neighbour, neighbours
from tidemark.operators.temporal import FROM, SENTINEL, TO, moment
from tidemark.session import stage
from tidemark.types import literal

#: Column by which a key's rows are put in order: times in half microseconds, a live row before a batch of its time.
AT = "__at"


def bulk_history(
    current: DataFrame, batches: DataFrame, keys: Sequence[str], fields: Sequence[Field], time: str, dropout: bool = False, times: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(fields, FROM, TO): the versions of every key of current and batches, as merging the batches one after the other
    would leave them; TO is SENTINEL for live ones. Live rows that end in the batches come with their end.

    current: live rows with FROM; batches: fields and time, one row per key and time, keys not null; columns that
    batches lacks keep their live value. dropout: a key that a batch lacks ends at its time; times (column time) names
    the batches that had no rows at all. Nulls follow the fields: nullable columns take them, a default stands in for
    one, and a column with neither keeps its last value; a new row without such a value fails the job, and so does a
    batch older than a live row of its keys. Versions that hold for no time are left out.

    The rows of a key with more than hot_rows of them are worked on in ranges of time.
    """
    keys, names = list(keys), [f.name for f in fields]
    kinds = {f.name: f.dataType for f in current.schema.fields}
    given = [n for n in names if n in batches.columns]
    data = [n for n in names if n not in keys]
    cur = current.select(*names, F.col(FROM).alias("__t"), F.lit(True).alias("__cur"))
    inp = batches.select(*(F.col(n) if n in given else F.lit(None).cast(kinds[n]).alias(n) for n in names), F.col(time).alias("__t"), F.lit(False).alias("__cur"))
    defaults = {f.name: F.coalesce(F.col(f.name), literal(f.default, kinds[f.name])) for f in fields if f.name in data and f.name in given and not f.nullable and f.default is not None}
    keeps = [f.name for f in fields if f.name in data and (f.name not in given or (not f.nullable and f.default is None))]
    needed = [F.col(n).isNotNull() for n in keeps if n in given]
    rows = cur.unionByName(inp).withColumns({**defaults, "__has": reduce(lambda a, b: a & b, needed, F.lit(True)), AT: F.unix_micros("__t") * 2 + (~F.col("__cur")).cast("long")})
    if dropout:
        rows = _numbered(rows, batches, times, time)
    return in_parts(stage(rows, "batches"), keys, AT, lambda r: _versions(r, names, data, keeps, dropout), hot_rows)


def _versions(r: Ranged, names: Sequence[str], data: Sequence[str], keeps: Sequence[str], dropout: bool) -> DataFrame:
    r = carried(r, [AT], keeps)
    more = {"i": "__i", "nt": "__nt"} if dropout else {}
    value = {**{f"v{n}": c for n, c in enumerate(data)}, **more}
    r = apart(r) if keeps else r
    r = neighbours(r, [AT], [(value, -1, "__before"), (value, 1, "__after")] if dropout else [(value, -1, "__before")])

    def joins(side: str, step: int) -> Column:
        """Whether the row and its neighbour are one version."""
        touch = F.col(side).isNotNull() & (F.col(f"{side}.i") == F.col("__i") + step) if dropout else F.col(side).isNotNull()
        return F.coalesce(reduce(lambda a, b: a & b, (F.col(f"{side}.v{n}").eqNullSafe(F.col(c)) for n, c in enumerate(data)), touch), F.lit(False))

    fresh = F.col("__before").isNull() | (F.coalesce(F.col("__before.i") != F.col("__i") - 1, F.lit(False)) if dropout else F.lit(False))
    what = F.to_json(F.struct(*r.keys))
    bad = F.when(fresh & ~F.col("__has") & ~F.col("__cur"), F.raise_error(F.concat(F.lit("a new row lacks a value: "), what))).when(
        F.col("__cur") & F.col("__before").isNotNull(), F.raise_error(F.concat(F.lit("a live row is newer than its update: "), what))
    )
    df = r.df.where(bad.cast("boolean").isNull()).withColumns({"__first": ~joins("__before", -1), "__last": ~joins("__after", 1) if dropout else F.lit(True)})
    marks = df.where("__first OR __last" if dropout else "__first").select(*names, *r.by[len(r.keys) :], AT, "__t", "__first", "__last", *(["__nt"] if dropout else []))
    r = apart(r.on(marks))
    # a version's end: of dropout, where its last row's batch is followed by the next; else where the next version begins
    r = neighbour(r, [AT], {"end": "__nt" if dropout else "__t"}, 1, "__next")
    end = F.when(F.col("__last"), F.col("__nt")).otherwise(F.col("__next.end")) if dropout else F.col("__next.end")
    out = r.df.where("__first").select(*names, F.col("__t").alias(FROM), F.coalesce(end, moment(SENTINEL)).alias(TO))
    return out.where(F.col(FROM) < F.col(TO))


def _numbered(rows: DataFrame, batches: DataFrame, times: DataFrame | None, time: str) -> DataFrame:
    """rows with the number of their batch and the time of the one after it. Live rows stand for a batch 0 that has no
    time of its own and ends with the first batch. The only window over a whole table has one row per batch."""
    every = batches.select(F.col(time).alias("__k"))
    if times is not None:
        every = every.unionByName(times.select(F.col(time).alias("__k")))
    order = Window.orderBy("__k")
    n = every.distinct().select("__k", F.row_number().over(order).alias("__i"), F.lead("__k").over(order).alias("__nt"))
    n = n.unionByName(n.agg(F.min("__k").alias("__nt")).select(F.lit(None).cast("timestamp").alias("__k"), F.lit(0).alias("__i"), "__nt"))
    rows = rows.withColumn("__b", F.when(~F.col("__cur"), F.col("__t")))
    return rows.join(n, rows["__b"].eqNullSafe(n["__k"]), "left").drop("__b", "__k")
