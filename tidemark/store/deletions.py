"""Deletion vectors: which records of immutable data files are gone, 64 positions of a file to a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a record lies.
FILE, POS = "__file", "__pos"
SCHEMA = "__file string, __word bigint, __bits bigint"
#: About what a row of a vector takes in memory, and up to how much of them is broadcast.
ROW_BYTES, BROADCAST_BYTES = 160, 32 << 20


def write_vector(places: DataFrame, path: str) -> tuple[int, list[str]]:
    """Writes the vector of places (FILE, POS); returns its number of rows, at most one for each 64 positions of a file,
    and the names of the files."""
    word, bit = F.shiftright(POS, 6), F.expr(f"shiftleft(1L, cast({POS} & 63 as int))")
    places.select(FILE, word.alias("__word"), bit.alias("__bits")).groupBy(FILE, "__word").agg(F.bit_or("__bits").alias("__bits")).write.parquet(path)
    r = places.sparkSession.read.schema(SCHEMA).parquet(path).agg(F.count(F.lit(1)), F.collect_set(FILE)).first()
    return r[0], sorted(r[1])


def _joined(df: DataFrame, spark: SparkSession, paths: Sequence[str], rows: int, how: str) -> DataFrame:
    v = spark.read.schema(SCHEMA).parquet(*paths).select(F.col(FILE).alias("__dv_file"), F.col("__word").alias("__dv_word"), F.col("__bits").alias("__dv_bits"))
    hit = (F.col(FILE) == F.col("__dv_file")) & (F.shiftright(POS, 6) == F.col("__dv_word")) & F.expr(f"shiftright(__dv_bits, cast({POS} & 63 as int)) & 1 = 1")
    return df.join(F.broadcast(v) if rows * ROW_BYTES <= BROADCAST_BYTES else v.hint("merge"), hit, how)


def without(df: DataFrame, paths: Sequence[str], rows: int) -> DataFrame:
    """df (with FILE and POS) less the records of the vectors at paths, which have so many rows: broadcast if these are
    few, else joined by file and word."""
    return _joined(df, df.sparkSession, paths, rows, "left_anti") if paths else df


def within(df: DataFrame, paths: Sequence[str], rows: int) -> DataFrame:
    """The records of df that are in the vectors."""
    return _joined(df, df.sparkSession, paths, rows, "left_semi") if paths else df.limit(0)
