"""Differences between two tables, and tables made flat."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage

TOLERANCE = 1e-9


def differing(lhs: DataFrame, rhs: DataFrame, on: Sequence[str], cmp_cols: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_lhs", "_rhs"), tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of a full join by on (null equal to null) in which a compared column differs: on, then c_lhs, c_rhs of
    every one. lhs is cast to rhs's types; fractions differ beyond tolerance, a null differs from a value. A row of one
    side only differs unless its compared columns are all null."""
    a, b = suffixes
    cols = [c for c in sorted(set(lhs.columns) & set(rhs.columns) - set(on)) if cmp_cols is None or c in cmp_cols]
    if not cols:
        raise ValueError("No columns to compare")
    kinds = {f.name: f.dataType for f in rhs.schema.fields}
    left = lhs.select(*(F.col(c).cast(kinds[c]).alias(f"__l_{c}") for c in on), *(F.col(c).cast(kinds[c]).alias(f"{c}{a}") for c in cols))
    right = rhs.select(*(F.col(c).alias(f"__r_{c}") for c in on), *(F.col(c).alias(f"{c}{b}") for c in cols))
    j = left.join(right, [F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")) for c in on], "full")

    def differs(c: str):
        x, y = F.col(f"{c}{a}"), F.col(f"{c}{b}")
        if isinstance(kinds[c], (T.FractionalType, T.DecimalType)):
            far = (F.abs(x - y) > F.lit(tolerance)) & ~x.eqNullSafe(y)
            return F.coalesce(far, F.lit(False)) | (x.isNull() != y.isNull())
        return ~x.eqNullSafe(y)

    j = j.where(reduce(lambda p, q: p | q, map(differs, cols)))
    return j.select(*(F.coalesce(f"__l_{c}", f"__r_{c}").alias(c) for c in on), *(F.col(f"{c}{s}") for c in cols for s in suffixes))


def compare_dataframes(lhs: DataFrame, rhs: DataFrame, on: Sequence[str], cmp_cols: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_lhs", "_rhs")) -> tuple[DataFrame, list[str]]:
    """(differing rows sorted by on, with the columns that differ anywhere; names of columns that a side lacks, as
    missing:c_lhs then missing:c_rhs)."""
    a, b = suffixes
    missing = sorted(f"missing:{c}{a}" for c in set(rhs.columns) - set(lhs.columns)) + sorted(f"missing:{c}{b}" for c in set(lhs.columns) - set(rhs.columns))
    rows = stage(differing(lhs, rhs, on, cmp_cols, suffixes), "differing")
    cols = [c[: -len(a)] for c in rows.columns[len(on) :: 2]]
    kinds = {f.name: f.dataType for f in rhs.schema.fields}

    def any_differs(c: str):
        x, y = F.col(f"{c}{a}"), F.col(f"{c}{b}")
        if isinstance(kinds[c], (T.FractionalType, T.DecimalType)):
            return F.bool_or(F.coalesce((F.abs(x - y) > F.lit(TOLERANCE)) & ~x.eqNullSafe(y), F.lit(False)) | (x.isNull() != y.isNull()))
        return F.bool_or(~x.eqNullSafe(y))

    found = rows.agg(*(any_differs(c).alias(c) for c in cols)).first()
    keep = [c for c in cols if found[c]]
    return rows.select(*on, *(f"{c}{s}" for c in keep for s in suffixes)).orderBy(*on), missing


def flatten(df: DataFrame) -> DataFrame:
    """One step: array columns exploded together, row by row (an empty or null one gives a null), structs replaced by
    their fields, named struct.field."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if arrays:
        others = [F.col(f"`{c}`") for c in df.columns if c not in arrays]
        full = F.greatest(F.lit(1), *(F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) for c in arrays))
        lists = {f"a{i}": F.coalesce(F.col(f"`{c}`"), F.array().cast(df.schema[c].dataType)) for i, c in enumerate(arrays)}
        rows = F.transform(F.sequence(F.lit(0), full - 1), lambda n: F.struct(*(F.get(v, n).alias(k) for k, v in lists.items())))
        row = df.select(*others, F.explode(rows).alias("__row"))
        df = row.select(*(F.col(f"__row.a{arrays.index(c)}").alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns))
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def recursive_flatten(df: DataFrame) -> DataFrame:
    """flatten until no arrays and structs are left."""
    while any(isinstance(f.dataType, (T.ArrayType, T.StructType)) for f in df.schema.fields):
        df = flatten(df)
    return df
