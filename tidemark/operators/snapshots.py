"""What changed between full snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import HOT_ROWS, Ranged, hot_keys, in_parts, lookup_join, matches, neighbours
from tidemark.session import stage

FIRST = -(2**63)
#: Snapshots of a source whose rows of one key are compared together; each last one's rows also go to the next block.
BLOCK = 64


def snapshot_chain(files: DataFrame, source: str = "data_source", ts: str = "data_source_ts", file: str = "file_id", upload: str = "upload_ts", hot_rows: int = HOT_ROWS, block: int = BLOCK) -> DataFrame:
    """(file, __prev, __next, __block, __next_block) of each file that counts: the files before and after it in its source,
    and the blocks of its own and of the next.

    Of several files of one (source, ts) the one with the latest upload (null first), then the largest file counts. A
    source's snapshots follow each other by ts, a null ts before all others; null is a source like any other.
    """
    best = files.groupBy(source, ts).agg(F.max(F.struct(F.col(upload), F.col(file))).alias("__best"))
    chosen = stage(best.select(source, F.coalesce(F.unix_micros(ts), F.lit(FIRST)).alias("__at"), F.col(f"__best.{file}").alias(file)), "chain")

    def link(r: Ranged) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*r.by).orderBy("__at"))
        r = r.on(r.df.withColumn("__block", F.xxhash64(*r.by, F.floor(n / block))))
        own = {"file": file, "block": "__block"}
        r = neighbours(r, ["__at"], [(own, -1, "__prev"), (own, 1, "__next")])
        return r.df.select(file, F.col("__prev.file").alias("__prev"), F.col("__next.file").alias("__next"), "__block", F.col("__next.block").alias("__next_block"))

    return in_parts(chosen, [source], "__at", link, hot_rows)


def snapshot_changes(
    rows: DataFrame,
    chain: DataFrame,
    values: Mapping[str, Column],
    tolerance: Mapping[str, float] | None = None,
    key: Sequence[str] = ("id",),
    file: str = "file_id",
    line: str = "line_no",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(file, key, change_kind, old, new) of the keys added, removed or changed against the previous snapshot; file is the later one.

    EXCEPT ALL both ways: a snapshot's rows count +1, those of the one before it -1; equal rows cancel, what is left of
    either side is joined by key. values: compared columns; equal if both null or equal, for a column with tolerance
    if they differ by no more than it. Rows with a null in key don't count; of rows with one key in a file the one with
    the largest line counts (then the largest values). A file without rows is an empty snapshot.

    The rows are exchanged once, by block of consecutive snapshots and key, so both sides of a comparison meet without
    a second exchange and no key has more than a block's snapshots in a task. Files of more than hot_rows rows, which
    could hold one key that often, are reduced to a row per key first, with map-side aggregation.
    """
    tolerance, key = dict(tolerance or {}), list(key)
    names = [f"k{i}" for i in range(len(key))]
    cols = [f"v{i}" for i in range(len(values))]
    r = rows.select(F.col(file).alias("file"), *(F.col(k).alias(n) for k, n in zip(key, names)), F.col(line).alias("line"), *(v.alias(c) for c, v in zip(cols, values.values())))
    r = r.where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    big = hot_keys(r, ["file"], hot_rows)
    if big is not None:
        mine = matches(r, ["file"], big[0], "left_semi").groupBy("file", *names).agg(F.max(F.struct("line", *cols)).alias("row"))
        r = matches(r, ["file"], big[0], "left_anti").unionByName(mine.select("file", *names, "row.*"))
    linked = chain.where("__prev IS NOT NULL OR __next IS NOT NULL").select(
        F.col(file).alias("file"), F.col("__prev").isNotNull().alias("later"), F.col("__next").alias("next"), F.col("__block").alias("block"), F.col("__next_block").alias("next_block")
    )
    j = lookup_join(r, linked, ["file"])
    inside = F.coalesce(F.col("next_block") == F.col("block"), F.lit(False))
    # (block, whether the row counts for its own file there, the file it is compared in there)
    goes = F.filter(
        F.array(
            F.struct(F.col("block").alias("b"), F.col("later").alias("own"), F.when(inside, F.col("next")).alias("next")),
            F.struct(F.when(~inside, F.col("next_block")).alias("b"), F.lit(False).alias("own"), F.col("next").alias("next")),
        ),
        lambda s: s["b"].isNotNull() & (s["own"] | s["next"].isNotNull()),
    )
    sent = j.select("file", *names, "line", *cols, F.explode(goes).alias("g")).select(F.col("g.b").alias("block"), "file", *names, "line", *cols, "g.own", "g.next")
    last = Window.partitionBy("block", *names, "file").orderBy(F.desc("line"), *(F.desc(c) for c in cols))
    one = sent.repartition("block", *names).withColumn("n", F.row_number().over(last)).where("n = 1")
    signed = F.filter(F.array(F.struct(F.when(F.col("own"), F.col("file")).alias("f"), F.lit(1).alias("n")), F.struct(F.col("next").alias("f"), F.lit(-1).alias("n"))), lambda s: s["f"].isNotNull())
    both = one.select("block", *names, *cols, F.explode(signed).alias("s")).select("block", *names, F.col("s.f").alias("at"), *cols, "s.n")
    rest = both.groupBy("block", *names, "at", *cols).agg(F.sum("n").alias("n")).where("n != 0")
    value = F.struct(*(F.col(c).alias(k) for c, k in zip(cols, values)))
    pair = rest.groupBy("block", *names, "at").agg(F.max(F.when(F.col("n") < 0, value)).alias("old"), F.max(F.when(F.col("n") > 0, value)).alias("new"))
    differs = F.lit(False)
    for k in values:
        a, b = F.col(f"old.{k}"), F.col(f"new.{k}")
        if k in tolerance:
            far = F.coalesce(F.abs(a - b) > tolerance[k], F.lit(False))
            differs = differs | (a.isNull() != b.isNull()) | (far & ~a.eqNullSafe(b))
        else:
            differs = differs | ~a.eqNullSafe(b)
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differs, "changed")
    return pair.select(F.col("at").alias(file), *(F.col(n).alias(k) for k, n in zip(key, names)), kind.alias("change_kind"), "old", "new").where("change_kind IS NOT NULL")
