"""Small tables as base64 text of an Arrow stream, for messages."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a message's table.
MOST = 256 << 20


def arrow_size(df: DataFrame) -> int:
    """Bytes that df takes as an Arrow table, measured on the executors; runs df once."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(b.nbytes for b in batches)], pa.int64())})

    return df.mapInArrow(measure, "n long").groupBy().sum("n").first()[0] or 0


def to_ipc_b64(df: DataFrame, compression: str | None = None) -> bytes:
    """df as base64: uncompressed, or compression lz4, zstd (within Arrow) or zlib (around it). For tables of up to MOST
    bytes; larger ones are refused before they are collected, so df is run twice."""
    if compression not in (None, "lz4", "zstd", "zlib"):
        raise ValueError(f"unknown compression {compression}")
    size = arrow_size(df)
    if size > MOST:
        raise ValueError(f"table of {size} bytes is no message")
    table = df.toArrow()
    if table.nbytes > MOST:  # df may give other rows the second time
        raise ValueError(f"table of {table.nbytes} bytes is no message")
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=compression if compression in ("lz4", "zstd") else None)
    with pa.ipc.new_stream(sink, table.schema, options=options) as w:
        w.write_table(table)
    data = sink.getvalue().to_pybytes()
    return base64.b64encode(zlib.compress(data) if compression == "zlib" else data)


def from_ipc_b64(spark: SparkSession, payload: str | bytes, use_zlib: bool = False) -> DataFrame:
    data = base64.b64decode(payload)
    return spark.createDataFrame(pa.ipc.open_stream(zlib.decompress(data) if use_zlib else data).read_all())
