"""SQL column types and Spark types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each SQL type without parameters is stored as. Small ints widen, BIT is a number.
PLAIN: dict[str, T.DataType] = {
    "BIGINT": T.LongType(),
    "BIT": T.IntegerType(),
    "BOOL": T.BooleanType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "MEDIUMINT": T.LongType(),
    "REAL": T.DoubleType(),
    "SMALLINT": T.IntegerType(),
    "TIME": T.TimeType(6),
    "TIMESTAMP": T.TimestampType(),
    "TINYINT": T.IntegerType(),
}
TEXT = ("CHAR", "VARCHAR", "TEXT")
NUMERIC = ("NUMERIC", "DECIMAL", "DEC", "FIXED")
_FORM = re.compile(r"\s*([A-Z]+)\s*(?:\(([^)]*)\))?", re.I)


def parse_sql_type(sql: str) -> tuple[str, list[str], dict[str, str]]:
    """NAME(a, k=v) as (name, [a], {k: v}), name and k in upper case."""
    m = _FORM.match(sql)
    if m is None:
        raise ValueError(f"Unknown SQL data type: {sql}")
    args, named = [], {}
    for p in filter(None, (x.strip() for x in (m.group(2) or "").split(","))):
        k, eq, v = p.partition("=")
        if eq:
            named[k.strip().upper()] = v.strip()
        else:
            args.append(p)
    return m.group(1).upper(), args, named


def spark_type(sql: str) -> T.DataType:
    """The Spark type of an SQL type; ValueError for an unknown one or a decimal without precision and scale."""
    name, args, named = parse_sql_type(sql)
    if name == "TINYINT" and named.get("DISPLAY_WIDTH") == "1":
        return T.BooleanType()
    if name in TEXT:
        return T.StringType()
    if name in NUMERIC:
        p, s = named.get("PRECISION", *args[:1]) if args or named else None, named.get("SCALE", args[1] if len(args) > 1 else None)
        if p is None or s is None:
            raise ValueError(f"precision and scale are needed: {sql}")
        return T.DecimalType(int(p), int(s))
    if name not in PLAIN:
        raise ValueError(f"Unknown SQL data type: {sql}")
    return PLAIN[name]


def text_length(sql: str) -> int | None:
    """The longest text that a column of the type may hold; None if unbounded or no text."""
    name, args, named = parse_sql_type(sql)
    if name not in TEXT:
        return None
    n = named.get("LENGTH", args[0] if args else 1 if name == "CHAR" else None)
    return None if n is None else int(n)


def sql_type(kind: T.DataType, varchar_length: int = 255) -> str:
    """An SQL type that spark_type turns back into kind."""
    if isinstance(kind, T.DecimalType):
        return f"NUMERIC({kind.precision},{kind.scale})"
    if isinstance(kind, T.StringType):
        return f"VARCHAR({varchar_length})"
    names = {"bigint": "BIGINT", "int": "INT", "smallint": "INT", "tinyint": "INT", "boolean": "BOOL", "date": "DATE", "double": "DOUBLE", "float": "FLOAT", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME", "time(6)": "TIME"}
    try:
        return names[kind.simpleString()]
    except KeyError:
        raise ValueError(f"no SQL type for {kind}") from None


# Names of column types as the type-cast transform takes them.
NAMED: dict[str, str] = {
    "Utf8": "string", "String": "string", "Categorical": "string", "Date": "date", "Datetime": "timestamp", "Time": "time", "Boolean": "boolean",
    "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "Float32": "float", "Float64": "double",
}


def cast(c: Column, kind: T.DataType | str) -> Column:
    """c as kind, null where it can't be: straight to the target, without a way through floats. Text is trimmed before
    it becomes anything but text."""
    name = kind if isinstance(kind, str) else kind.simpleString()
    return c.try_cast(name)


def cast_columns(df: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """df with those of its columns in kinds cast, all in one projection; columns of that type already stay as they are."""
    now = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: cast(F.col(f"`{c}`"), k) for c, k in kinds.items() if c in now and now[c] != k})


def failed_casts(df: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """One row: per column how many values can't be cast."""
    return df.agg(*(F.count_if(F.col(f"`{c}`").isNotNull() & cast(F.col(f"`{c}`"), k).isNull()).alias(c) for c, k in kinds.items()))


def literal(value: str | None, kind: T.DataType) -> Column:
    """A column's default, written as text, as a value: true/t/1 and false/f/0 for booleans, lenient dates."""
    return F.lit(value).try_cast(kind.simpleString())
