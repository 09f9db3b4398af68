"""Built-in column transforms: (df, result column, arguments) -> df. All are expressions; none looks at rows in Python."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.types import NAMED

# Strptime fields and what they are in Spark's patterns.
FIELDS = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "y": "yy", "b": "MMM", "B": "MMMM", "f": "SSSSSS", "p": "a", "I": "h", "j": "D", "z": "xx"}


def date_pattern(fmt: str) -> str:
    """A strptime format as a Spark pattern; other letters are quoted."""
    out = []
    for field, letters, other in re.findall(r"%([A-Za-z])|([A-Za-z]+)|([^A-Za-z%]+|%)", fmt):
        if field:
            if field not in FIELDS:
                raise ValueError(f"unknown field %{field} in {fmt}")
            out.append(FIELDS[field])
        else:
            out.append(f"'{letters}'" if letters else other)
    return "".join(out)


def null_if_gte(df: DataFrame, col: str, args: list[Any]) -> DataFrame:
    """Null where the value is args[0] or more."""
    c = F.col(col)
    return df.withColumn(col, F.when(c >= F.lit(args[0]), None).otherwise(c))


def parse_date(df: DataFrame, col: str, args: list[Any]) -> DataFrame:
    """Text as a date by the first of the formats that fits. A text that none fits fails the job."""
    c = F.col(col)
    parsed = F.coalesce(*(F.try_to_timestamp(c, F.lit(date_pattern(f))) for f in args)).cast("date")
    bad = F.raise_error(F.concat(F.lit(f"{col}: no format of {list(args)} fits "), c)).cast("date")
    return df.withColumn(col, F.when(c.isNotNull() & parsed.isNull(), bad).otherwise(parsed))


def apply_type_casts(df: DataFrame, col: str, args: list[Any]) -> DataFrame:
    """Casts one after the other, by type name."""
    c = F.col(col)
    for name in args:
        c = c.try_cast(NAMED.get(name, name))
    return df.withColumn(col, c)


def combine_columns(df: DataFrame, col: str, args: list[Any]) -> DataFrame:
    """Parts joined to one text: ${Name} is a column, any other part itself. Null if one part is null."""
    parts = []
    for a in args:
        m = re.fullmatch(r"\$\{(.+?)\}(.*)", str(a), re.S)
        parts += [F.col(m.group(1)).cast("string"), F.lit(m.group(2))] if m else [F.lit(str(a))]
    return df.withColumn(col, F.concat(*parts))


def map_to_true(df: DataFrame, col: str, args: list[Any]) -> DataFrame:
    """True where the value is one of args, false else and for null."""
    return df.withColumn(col, F.coalesce(F.col(col).isin(*args), F.lit(False)))


BUILT_IN = {f.__name__: f for f in (null_if_gte, parse_date, apply_type_casts, combine_columns, map_to_true)}
