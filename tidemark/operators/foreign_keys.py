"""Surrogate keys: rows of a delta that name a parent by its values get the parent's key; unknown parents are made."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.delta import Field
from tidemark.operators.skew import dense_numbers, lookup_join
from tidemark.types import literal


def deduce_keys(delta: DataFrame, parent: DataFrame, fields: Sequence[Field], values: Mapping[str, str], key: tuple[str, str], high: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(delta with column key[0] set, new parent rows, highest key) from a parent with key column key[1].

    values: delta column -> parent column. A null in a parent column that has a default and may not be null is compared
    as that default. New parents get the numbers after high (None: the parent's largest key) in the order of their
    values. A row whose values stay unmatched because one is null fails the job.
    """
    source, target = key
    kinds = {f.name: f.dataType for f in parent.schema.fields}
    named = {f.name: f for f in fields}

    def value(s: str, t: str):
        f = named.get(t)
        c = F.col(s)
        return F.coalesce(c, literal(f.default, kinds[t])) if f is not None and not f.nullable and f.default is not None else c

    cols = list(values.values())
    wanted = delta.select(*(value(s, t).alias(t) for s, t in values.items())).distinct()
    known = parent.groupBy(*cols).agg(F.min(target).alias(target))
    fresh = wanted.dropna(how="any").join(known, cols, "left_anti")
    if high is None:
        high = parent.agg(F.max(target)).first()[0] or 0
    numbered = dense_numbers(fresh, cols, target, high + 1)
    numbered = numbered.withColumn(target, F.col(target).cast(kinds[target]))
    top = numbered.agg(F.max(target)).first()[0] or high
    added = numbered.select(*(F.col(c) if c in cols or c == target else (literal(named[c].default, kinds[c]) if named[c].default is not None else F.lit(None).cast(kinds[c])).alias(c) for c in parent.columns if c in named or c in cols or c == target))
    table = known.unionByName(numbered.select(*cols, target)).select(*(F.col(c).alias(f"__p_{c}") for c in cols), F.col(target).alias("__key"))
    d = delta.drop(source).withColumns({f"__p_{t}": value(s, t) for s, t in values.items()})
    joined = lookup_join(d, table, [f"__p_{c}" for c in cols], "left")
    lost = F.raise_error(F.concat(F.lit("no parent for "), F.to_json(F.struct(*(F.col(s) for s in values))))).cast(kinds[target])
    out = joined.withColumn(source, F.coalesce("__key", lost)).drop("__key", *(f"__p_{c}" for c in cols))
    return out, added, int(top)
