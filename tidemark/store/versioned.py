"""Immutable table versions: manifests of data files and deletion vectors, and the records that differ between two."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import remove
from tidemark.store.deletions import FILE, POS, within, without, write_vector
from tidemark.store.log import CommitConflict, CommitLog, files_below

CHANGE = "__change"
#: How often a finished run looks for a free commit number while other tables of the log are written.
TRIES = 100


class VersionedTable:
    """A table whose versions are manifests in log. A version lists data files and deletion vectors, with their number of
    rows and the files they are about; neither is ever rewritten."""

    def __init__(self, log: CommitLog, name: str):
        self.log, self.name, self.spark = log, name, log.spark

    def _entry(self, state: dict[str, Any]) -> dict[str, Any]:
        return {"files": [], "dvs": {}, "schema": None, **state.get("tables", {}).get(self.name, {})}

    def _at(self, version: int | None) -> dict[str, Any]:
        return self._entry({} if version == 0 else self.log.read(version))

    def _scan(self, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema).select("*", F.lit("").alias(FILE), F.lit(0).cast("long").alias(POS))
        df = self.spark.read.schema(schema).parquet(*files)
        return df.select(*schema.names, F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(POS))

    def _less(self, files: list[str], schema: T.StructType, dvs: dict[str, Any], scan: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The records of files, by scan, less those of the vectors. Files that no vector is about are read without a join."""
        hit = {n for d in dvs.values() for n in d["files"]}
        dirty = [f for f in files if f.rsplit("/", 1)[-1] in hit]
        clean = [f for f in files if f.rsplit("/", 1)[-1] not in hit]
        if not dirty:
            return scan(self._scan(files, schema))
        out = without(scan(self._scan(dirty, schema)), list(dvs), sum(d["rows"] for d in dvs.values()))
        return out.unionByName(scan(self._scan(clean, schema))) if clean else out

    def schema(self, version: int | None = None) -> T.StructType:
        s = self._at(version)["schema"]
        if s is None:
            raise ValueError(f"table {self.name} has no version yet")
        return T.StructType.fromJson(s)

    def exists(self) -> bool:
        return self._at(None)["schema"] is not None

    def scan(self, version: int | None = None) -> DataFrame:
        """The records of a version (None: the last) with FILE and POS."""
        version = self.log.latest() if version is None else version
        at = self._at(version)
        return self._less(at["files"], self.schema(version), at["dvs"])

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a version; without deletion vectors a plain scan."""
        version = self.log.latest() if version is None else version
        at = self._at(version)
        if at["files"] and not at["dvs"]:
            return self.spark.read.schema(self.schema(version)).parquet(*at["files"])
        return self.scan(version).drop(FILE, POS)

    def _folder(self, n: int) -> str:
        return f"{self.log.root}/{self.name}/{n:08d}-{uuid.uuid4().hex}"

    def commit(self, add: DataFrame | None = None, delete: DataFrame | None = None, replace: bool = False, also: dict[str, Any] | None = None) -> int:
        """A version with add's rows more and the records in delete (FILE, POS) less; replace starts from nothing.

        also: entries of the manifest that change in the same commit, such as a consumer's processed version.
        Two writers: the second one gets CommitConflict, its files stay unlisted.
        """
        n = self.log.latest()
        state = self.log.read(n)
        at = self._entry(state)
        if replace:
            at |= {"files": [], "dvs": {}}
        where = self._folder(n + 1)
        if add is not None:
            if at["schema"] is None or replace:
                at["schema"] = add.schema.jsonValue()
            add.select(*T.StructType.fromJson(at["schema"]).names).write.parquet(f"{where}/data")
            at["files"] = at["files"] + files_below(self.spark, f"{where}/data")
        if delete is not None:
            rows, names = write_vector(delete, f"{where}/dv")
            if rows:
                at["dvs"] = {**at["dvs"], f"{where}/dv": {"rows": rows, "files": names}}
        return self.log.commit(n + 1, {**state, **(also or {}), "tables": {**state.get("tables", {}), self.name: at}})

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Record deltas between two versions, with CHANGE insert or delete, from their manifests alone.

        Of files in both versions only those that a new deletion vector is about are read; of added files the records
        not deleted since are inserts, of removed files those not deleted before are deletes. after 0 is the empty table.
        """
        upto = self.log.latest() if upto is None else upto
        a, b = self._at(after), self._at(upto)
        schema = self.schema(upto)
        old, new = set(a["files"]), set(b["files"])
        fresh = {d: n for d, n in b["dvs"].items() if d not in a["dvs"]}
        names = {n for d in fresh.values() for n in d["files"]}
        kept = sorted(f for f in old & new if f.rsplit("/", 1)[-1] in names)
        parts = [self._less(sorted(new - old), schema, b["dvs"]).withColumn(CHANGE, F.lit("insert"))]
        if old - new:
            parts.append(self._less(sorted(old - new), schema, a["dvs"]).withColumn(CHANGE, F.lit("delete")))
        if kept:
            gone = lambda df: within(df, list(fresh), sum(d["rows"] for d in fresh.values()))
            parts.append(self._less(kept, schema, a["dvs"], gone).withColumn(CHANGE, F.lit("delete")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _consumer(self, consumer: str) -> str:
        return f"{self.name}/{consumer}"

    def processed(self, consumer: str, version: int | None = None) -> int:
        """The version that consumer has processed."""
        return self.log.read(version).get("consumers", {}).get(self._consumer(consumer), 0)

    def consume(self, consumer: str, transform: Callable[[DataFrame], DataFrame], output: "VersionedTable") -> int | None:
        """Gives transform the records changed since consumer's processed version and commits its result to output
        together with the version now processed. None if nothing is new.

        Both are in one manifest, so a run that fails at any point has done nothing and the next one gets the same
        records. Two runs of one consumer: the one that commits second finds the processed version moved, takes its
        files away and raises CommitConflict, so no record comes twice. Commits of other tables and consumers in between
        are kept: the result is then committed on top of them.
        """
        base = self.log.latest()
        done = self.processed(consumer, base)
        a, b = self._at(done), self._at(base)
        if (a["files"], a["dvs"]) == (b["files"], b["dvs"]):
            return None
        result = transform(self.changes(done, base))
        where = output._folder(base + 1)
        result.write.parquet(f"{where}/data")
        files = files_below(self.spark, f"{where}/data")
        for _ in range(TRIES):
            n = self.log.latest()
            state = self.log.read(n)
            consumers = state.get("consumers", {})
            if consumers.get(self._consumer(consumer), 0) != done:
                break
            at = output._entry(state)
            at |= {"files": at["files"] + files, "schema": at["schema"] or result.schema.jsonValue()}
            try:
                return self.log.commit(n + 1, {**state, "consumers": {**consumers, self._consumer(consumer): base}, "tables": {**state.get("tables", {}), output.name: at}})
            except CommitConflict:
                continue
        remove(self.spark, where)
        raise CommitConflict(f"another run of {consumer} was committed first")
