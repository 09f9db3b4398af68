"""Delimited files as typed columns."""

from __future__ import annotations

import csv
import io
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config.model import IngestColumn
from tidemark.functions.clean import NULL_TOKENS
from tidemark.operators.delta import ORD
from tidemark.operators.errparse import DELIMITERS
from tidemark.session import jpath
from tidemark.types import cast, spark_type

LOG = logging.getLogger(__name__)
#: Characters of a file that the header may take.
HEADER = 1 << 20


def sniff(first_line: str, delimiter: str | None = None) -> tuple[str, list[str]]:
    """(delimiter, header cells): the first of DELIMITERS that makes more than one cell, or the one given."""
    for d in [delimiter] if delimiter else DELIMITERS:
        cells = next(csv.reader([first_line.removeprefix("﻿")], delimiter=d), [])
        if len(cells) > 1 or delimiter:
            return d, cells
    raise ValueError("no delimiter makes more than one column of the header")


def first_line(spark: SparkSession, path: str) -> str:
    """A file's first line; no more of it is read."""
    fs, p = jpath(spark, path)
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"), HEADER)
        return reader.readLine() or ""
    finally:
        stream.close()


def clean_payload(data: str) -> str:
    """Delimited text with every cell trimmed and quoted only where needed."""
    delimiter, _ = sniff(data.split("\n", 1)[0].rstrip("\r"))
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows([c.strip() for c in row] for row in csv.reader(io.StringIO(data), delimiter=delimiter))
    return out.getvalue()


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of a file may hold a line break: whether a line has an odd number of quotes. Files of no more
    than one split are not looked at, as one task reads them anyway."""
    fs, p = jpath(spark, path)
    if fs.getFileStatus(p).getLen() <= int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))):
        return True
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def load_typed_dsv(
    spark: SparkSession,
    source: str | bytes | Sequence[str],
    columns: Sequence[IngestColumn],
    delimiter: str | None = None,
    null_values: Sequence[str] | None = None,
    schema_overrides: dict[str, T.DataType] | None = None,
    multi_line: bool | None = None,
    with_path: str | None = None,
) -> DataFrame:
    """A file (path), several ones, or a file's content (bytes) as the configured columns, typed for ingestion, with ORD.

    All cells are read as text and cast, so nothing is inferred; only headers that are configured, as source or target,
    or begin with __ are read, with their spaces removed after that. Of a file's equal rows there is one, the first one's
    place counts; rows of a later file come later. null_values (default '' and None) are null. Values that can't be cast
    are null. Configured sources that a file lacks come as null columns of their type. multi_line false splits a file
    over tasks, which needs cells without line breaks; None does so for large files in which no quote spans lines.
    with_path: a column for the path of the row's file.
    """
    overrides = schema_overrides or {}
    known = {c.source for c in columns if c.source} | {c.target for c in columns if c.target}
    tokens = list(NULL_TOKENS if null_values is None else null_values)
    kinds = {c.source: spark_type(c.ingestion_data_type or c.target_data_type or "VARCHAR(255)") for c in reversed(columns) if c.source}
    kinds = {**kinds, **overrides}

    def wanted(header: Sequence[str]) -> dict[int, str]:
        found = {i: h.strip() for i, h in enumerate(header) if h and (h in known or h.startswith("__") or h in overrides)}
        if dropped := [h for i, h in enumerate(header) if i not in found and h]:
            LOG.warning("columns without configuration: %s", dropped)
        return found

    def cells(raw: DataFrame, header: Sequence[str], path: str | None) -> DataFrame:
        at = F.lit(path).alias("__from") if path is not None else F.lit("").alias("__from")
        return raw.select(*(F.when(~F.col(f"c{i}").isin(*tokens), F.col(f"c{i}")).alias(h) for i, h in wanted(header).items()), at, *([ORD] if ORD in raw.columns else []))

    if isinstance(source, bytes):
        text = source.decode("utf-8-sig")
        d, header = sniff(text.split("\n", 1)[0].rstrip("\r"), delimiter)
        rows = [r + [None] * (len(header) - len(r)) for r in csv.reader(io.StringIO(text), delimiter=d)][1:]
        raw = spark.createDataFrame([tuple(r[: len(header)]) + (n,) for n, r in enumerate(rows) if any(r)], T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField(ORD, T.LongType())]))
        df = cells(raw, header, None)
    else:
        files = []
        for path in [source] if isinstance(source, str) else source:
            d, header = sniff(first_line(spark, path), delimiter)
            schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
            whole = spans_lines(spark, path) if multi_line is None else multi_line
            files.append(cells(spark.read.schema(schema).csv(path, sep=d, header=True, enforceSchema=True, multiLine=whole, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="PERMISSIVE"), header, path))
        # follows the files as given and each one's lines, as no exchange came before
        df = union_all(files).withColumn(ORD, F.monotonically_increasing_id())
    names = [c for c in df.columns if c not in (ORD, "__from")]
    df = df.groupBy(*(f"`{n}`" for n in names), "__from").agg(F.min(ORD).alias(ORD)) if names else df
    missing = [c.source for c in columns if c.source and c.source not in names]
    if missing:
        LOG.warning("configured columns that the file lacks: %s", missing)
    df = df.withColumns({n: cast(F.trim(f"`{n}`"), kinds[n]) for n in names if n in kinds and not isinstance(kinds[n], T.StringType)})
    df = df.withColumns({m: F.lit(None).cast(kinds[m]) for m in dict.fromkeys(missing)})
    return df.withColumnRenamed("__from", with_path) if with_path else df.drop("__from")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """The frames' rows in order, by name, columns that one lacks null; joined in pairs, so that the plan stays flat."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [a.unionByName(b[0], allowMissingColumns=True) if b else a for a, *b in (frames[i : i + 2] for i in range(0, len(frames), 2))]
    return frames[0]
