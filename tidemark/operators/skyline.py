"""Best representative of each group of duplicate records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import HOT_ROWS, Ranged, apart, highest, hot_keys, in_parts
from tidemark.session import stage

NEVER = -(2**63)


def survivors(
    rows: DataFrame,
    group: Sequence[str],
    fields: Mapping[str, Column],
    trust: Column,
    recency: Column,
    row: Column,
    oldest_first: Column | None = None,
    strict: Column | None = None,
    min_rows: int = 2,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One record per group: n_rows, n_skyline (the records of the first layer), n_layers, and per field f the value f and
    the row it comes from, f_row.

    A record's dimensions are completeness (how many fields it holds), trust and recency, the row's number deciding
    between equal times. The first layer is the skyline: the records that no other one of the group equals or beats in
    every dimension. Of its records the policy (trust, recency, row number) takes the first that holds a field. The next
    layer is the skyline of the records left that hold a field which is null so far, or which the policy would prefer
    to where it came from; it fills those, and so on until no such record is left. Of the records left the one that the
    policy prefers is always in the layer, as nothing beats it in trust and recency; so each layer settles a field for
    good, there are no more layers than fields, and each field ends with the policy's first record that holds it.

    trust, recency: numbers, null is least. oldest_first: where true, early and small row numbers come first instead of
    late and large ones. strict: where true and the values of any field disagree within the group, every f is null and
    f_row -1. A field that no record holds is null with f_row 0. Groups of fewer than min_rows rows don't come out;
    null group values are values like others; an empty table gives no rows.

    Of records that hold the same fields with the same trust only the latest can be in a layer that matters, so each
    (group, held fields, trust) is first reduced to it, map-side. A group that still has more than hot_rows records, with
    as many values of trust, is worked on in ranges of (trust, completeness, recency), as what beats a record comes after
    it in that order; its layers are the same ones.
    """
    names, keys = list(fields), [f"g{i}" for i in range(len(group))]
    oldest = F.coalesce(oldest_first, F.lit(False)) if oldest_first is not None else F.lit(False)
    must_agree = F.coalesce(strict, F.lit(False)) if strict is not None else F.lit(False)
    late = F.coalesce(F.when(oldest, -recency).otherwise(recency), F.lit(NEVER))
    cols = [f"v{i}" for i in range(len(names))]
    r = rows.select(
        *(F.col(g).alias(k) for g, k in zip(group, keys)),
        *(v.alias(c) for c, v in zip(cols, fields.values())),
        F.coalesce(trust.cast("long"), F.lit(NEVER)).alias("trust"),
        F.struct(late.alias("t"), F.when(oldest, -row).otherwise(row).alias("r")).alias("late"),
        row.alias("row"),
        must_agree.alias("strict"),
    )
    r = r.withColumn("held", F.concat(*(F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in cols)))
    agree = [a for c in cols for a in (F.min(F.when(F.col("strict"), F.col(c))).alias(f"lo{c}"), F.max(F.when(F.col("strict"), F.col(c))).alias(f"hi{c}"))]
    best = r.groupBy(*keys, "held", "trust").agg(F.max(F.struct("late", "row", *cols)).alias("b"), F.count(F.lit(1)).alias("n"), F.max("strict").alias("strict"), *agree)
    best = best.select(*keys, "held", "trust", "b.*", "n", "strict", *(f"{e}{c}" for c in cols for e in ("lo", "hi")))
    out = _in_layers(best, r, keys, cols, hot_rows).where(F.col("n_rows") >= min_rows)
    clash = F.lit(False)
    for c in cols:
        clash = clash | F.coalesce(F.col(f"lo{c}") != F.col(f"hi{c}"), F.lit(False))
    bad = F.col("strict") & clash
    return out.select(
        *(F.col(k).alias(g) for g, k in zip(group, keys)),
        "n_rows",
        "n_skyline",
        "n_layers",
        *(x for k, c in zip(names, cols) for x in (F.when(~bad, F.col(f"f{c}.v")).alias(k), F.when(bad, F.lit(-1)).otherwise(F.coalesce(F.col(f"f{c}.r"), F.lit(0))).cast("long").alias(f"{k}_row"))),
    )


def _in_layers(best: DataFrame, rows: DataFrame, keys: list[str], cols: list[str], hot_rows: int) -> DataFrame:
    """_layers of best's groups; those of more than hot_rows records in ranges. Only a group of more rows can have so many,
    so that is counted first."""
    if hot_keys(rows, keys, hot_rows) is None:
        # exchanged here, as what windows compare would else be worked out and moved as well
        return _layers(Ranged(best.repartition(*keys), tuple(keys)), cols)
    at = best.withColumn("at", F.struct("trust", _full().alias("full"), "late")).drop("trust", "late")
    return in_parts(stage(at, "candidates"), keys, "at", lambda r: _layers(r.on(r.df.select("*", "at.trust", "at.late").drop("at")), cols), hot_rows)


def _full() -> Column:
    """How many fields a record holds."""
    return F.length(F.replace(F.col("held"), F.lit("0"), F.lit("")))


def _layers(rows: Ranged, cols: list[str]) -> DataFrame:
    """One row per group: n_rows, n_skyline, n_layers, strict, and per field the value and row it gets and its ends."""
    rows, rank = rows.on(rows.df.withColumns({"full": _full(), "layer": F.lit(0)})), F.struct("trust", "late")
    holds = {c: F.substring("held", i + 1, 1) == "1" for i, c in enumerate(cols)}
    alive = F.lit(True)
    for n in range(1, len(cols) + 1):
        # the latest record left of at least this trust and so complete; a record's own level has the record itself
        tops = {f"top{k}": F.when(alive & (F.col("full") >= k), F.col("late")) for k in range(len(cols) + 1)}
        rows = highest(rows, tops, ["trust", "full", "late"])
        own = F.coalesce(*(F.when(F.col("full") == k, F.col(f"top{k}")) for k in range(len(cols) + 1)))
        rows = rows.on(rows.df.withColumn("layer", F.when(alive & (own <= F.col("late")), n).otherwise(F.col("layer"))).drop(*tops))
        if n < len(cols):
            taken = {f"best{c}": F.when((F.col("layer") > 0) & holds[c], rank) for c in cols}
            rows = highest(rows, taken)
            more = F.lit(False)
            for c in cols:
                more = more | (holds[c] & (F.col(f"best{c}").isNull() | (rank > F.col(f"best{c}"))))
            rows = apart(rows.on(rows.df.withColumn(f"alive{n}", (F.col("layer") == 0) & more).drop(*taken)))
            alive = F.col(f"alive{n}")
    return rows.df.groupBy(*rows.keys).agg(
        F.sum("n").alias("n_rows"),
        F.count_if(F.col("layer") == 1).alias("n_skyline"),
        F.max("layer").alias("n_layers"),
        F.max("strict").alias("strict"),
        *(F.max_by(F.struct(F.col(c).alias("v"), F.col("row").alias("r")), F.when((F.col("layer") > 0) & holds[c], rank)).alias(f"f{c}") for c in cols),
        *(pick(f"{e}{c}").alias(f"{e}{c}") for c in cols for e, pick in (("lo", F.min), ("hi", F.max))),
    )
