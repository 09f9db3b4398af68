"""Archives of delimited files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.session import jpath, scratch

#: Bytes of an archive that are read at a time.
BLOCK = 1 << 22


class HadoopFile(io.RawIOBase):
    """A file of any file system that Spark knows, for reading anywhere in it."""

    def __init__(self, spark: SparkSession, path: str):
        fs, p = jpath(spark, path)
        self._stream, self._size, self._at = fs.open(p), fs.getFileStatus(p).getLen(), 0
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._size}[whence]
        return self._at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self._size - self._at))
        if n:
            self._stream.seek(self._at)
            buffer[:n] = bytes(self._io.toByteArray(self._stream, n))
            self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def read_zipfile(spark: SparkSession, filename: str | BinaryIO, schema: Mapping[str, T.DataType] | T.StructType) -> DataFrame:
    """All members of an archive (path on any file system, or open file), one below the other, with the schema; an empty archive has no rows. Members are
    unpacked as a stream into the shared folder, where Spark reads them in parallel."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType([T.StructField(k, v) for k, v in schema.items()])
    where, paths = scratch(spark, "zip"), []
    jvm = spark.sparkContext._jvm
    archive = io.BufferedReader(HadoopFile(spark, filename), BLOCK) if isinstance(filename, str) else filename
    with zipfile.ZipFile(archive) as z:
        for i, name in enumerate(n for n in z.namelist() if not n.endswith("/")):
            path = f"{where}/{i:05d}.csv"
            target = jvm.org.apache.hadoop.fs.Path(path)
            out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
            try:
                with z.open(name) as f:
                    while block := f.read(BLOCK):
                        out.write(block)
            finally:
                out.close()
            paths.append(path)
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(paths, header=True, multiLine=True, escape='"')


def convert_zipped_csvs_to_parquet(spark: SparkSession, folder: str, schema: Mapping[str, T.DataType] | T.StructType, remove_original: bool = False) -> list[str]:
    """Every *.zip of a folder, or one archive, as a Parquet folder beside it."""
    fs, p = jpath(spark, folder)
    files = [folder] if folder.endswith(".zip") else sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().endswith(".zip"))
    out = []
    for f in files:
        target = f[:-4] + ".parquet"
        read_zipfile(spark, f, schema).write.mode("overwrite").parquet(target)
        if remove_original:
            fs.delete(jpath(spark, f)[1], False)
        out.append(target)
    return out
