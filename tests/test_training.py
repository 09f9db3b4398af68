"""Operators behind p1 to p5 against brute force on small random tables."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.clean import clean_double, clean_text
from tidemark.operators.chains import OPEN, build_chains, rebuild_chains
from tidemark.operators.errparse import error_parse, error_parses, header_of, loaded, parse_lines, parse_record, rejects, split_free
from tidemark.operators.incremental import pending_items
from tidemark.operators.skew import HOT_ROWS, apart, hot_keys, in_parts, lookup_join, neighbour, neighbours
from tidemark.operators.skyline import survivors
from tidemark.operators.snapshots import snapshot_chain, snapshot_changes
from tidemark.session import scratch
from tidemark.store.log import CommitConflict, CommitLog
from tidemark.store.versioned import FILE, POS, VersionedTable

T0 = datetime(2000, 1, 1, tzinfo=timezone.utc)


def at(n):
    return None if n is None else T0 + timedelta(seconds=n)


def us(n):
    return int(T0.timestamp() * 1e6) + n * 1_000_000


def clean(v):
    v = None if v is None else v.strip(" ")
    return None if v in ("", "None", None) else v


def values():
    return {"double_col": clean_double("double_col"), "varchar_col": clean_text("varchar_col")}


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_neighbour_crosses_ranges(spark, hot_rows):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i) for i in rnd.sample(range(10_000), 400)]
    seen = []

    def work(r):
        seen.append(r.ranges)
        return neighbour(apart(neighbour(r, ["n"], {"n": "n"}, 1, "nxt")), ["n"], {"n": "n"}, -1, "prv").df.select("k", "n", "nxt", "prv")

    out = in_parts(spark.createDataFrame(rows, "k string, n long"), ["k"], "n", work, hot_rows)
    assert [bool(x) for x in seen] == ([False, True] if hot_rows == 1 else [False])
    by = defaultdict(list)
    for k, n in rows:
        by[k].append(n)
    want = {}
    for k, ns in by.items():
        ns.sort()
        for p, n, x in zip([None, *ns], ns, [*ns[1:], None]):
            want[k, n] = (p, x)
    got = {(r.k, r.n): (r.prv and r.prv.n, r.nxt and r.nxt.n) for r in out.collect()}
    assert got == want


@pytest.mark.parametrize("most", [0, 10**6])
def test_lookup_join_broadcasts_only_what_is_small(spark, most):
    big = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(100)], "k int, n int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k int, s string")
    j = lookup_join(big, small, ["k"], broadcast_bytes=most)
    assert sorted((r.k, r.n, r.s) for r in j.collect()) == sorted((i % 3, i, "ab"[i % 3]) for i in range(100) if i % 7 and i % 3 < 2)
    assert lookup_join(big, small, ["k"], how="left", broadcast_bytes=most).count() == 100
    assert ("Broadcast" in j._jdf.queryExecution().toString()) == bool(most)


def test_lookup_join_of_hot_keys(spark):
    big = spark.createDataFrame([(0 if i % 2 else i % 50, i) for i in range(1000)], "k int, n int")
    small = spark.createDataFrame([(i, str(i)) for i in range(40)], "k int, s string")
    for how in ("inner", "left", "left_semi"):
        j = lookup_join(big, small, ["k"], how, broadcast_bytes=200, hot_rows=100)
        assert "Broadcast" in j._jdf.queryExecution().toString() and "SortMergeJoin" in j._jdf.queryExecution().toString()
        assert sorted(map(repr, j.collect())) == sorted(map(repr, big.join(small, "k", how).collect()))


@pytest.mark.parametrize("hot,share", [(300, 0), (1, 0.1), (1, 0.34)])
def test_all_hot_keys_are_cut_into_ranges(spark, hot, share):
    """300 hot keys, or one with a tenth or a third of all rows: no range of a key has more than HOT rows."""
    most, n = 100, 30_000 if hot == 1 else hot * 130
    rows = spark.range(n).select(F.when(F.col("id") < n * share, 0).otherwise(F.col("id") % (hot if hot > 1 else n)).alias("k"), F.col("id").alias("n"))
    seen = []

    def work(r):
        w = neighbours(r, ["n"], [({"n": "n"}, 1, "nxt"), ({"n": "n"}, -1, "prv")])
        if r.ranges:
            seen.append(r.df.groupBy(*r.by).count().agg(F.max("count")).first()[0])
        return w.df.select("k", "n", "nxt.n", F.col("prv.n").alias("p")).toDF("k", "n", "x", "p")

    out = in_parts(rows, ["k"], "n", work, most).toPandas().sort_values(["k", "n"])
    assert seen and seen[0] <= most and len(out) == n
    g = out.groupby("k").n
    assert out.x.fillna(-1).tolist() == g.shift(-1).fillna(-1).tolist() and out.p.fillna(-1).tolist() == g.shift(1).fillna(-1).tolist()
    assert hot_keys(rows, ["k"], HOT_ROWS) is None


def test_hot_keys_are_no_more_than_may_be_broadcast(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") < 5000, "a" * 100).otherwise(F.concat(F.lit("b" * 100), F.col("id") % 20)).alias("k"))
    all_, _ = hot_keys(rows, ["k"], 100)
    few, n = hot_keys(rows, ["k"], 100, broadcast_bytes=1000)
    assert all_.count() == 21 and [r.k for r in few.collect()] == ["a" * 100] and n == 5000
    assert hot_keys(rows, ["k"], 100, broadcast_bytes=10) is None


def brute_changes(files, rows):
    best = {}
    for f, s, t, u in files:
        if (s, t) not in best or ((u is not None, u, f) > best[s, t]):
            best[s, t] = (u is not None, u, f)
    by = defaultdict(list)
    for (s, t), (_, _, f) in best.items():
        by[s].append((t is not None, t, f))
    content = defaultdict(dict)
    for f, line, i, d, v in sorted(rows, key=lambda r: r[1]):
        if i is not None:
            content[f][i] = (None if d is None or d != d else d, clean(v))
    out = set()
    for chain in by.values():
        chain.sort(key=lambda c: (c[0], c[1] or 0))
        for (_, _, a), (_, _, b) in zip(chain, chain[1:]):
            x, y = content[a], content[b]
            out |= {(b, i, "added") for i in y.keys() - x.keys()} | {(b, i, "removed") for i in x.keys() - y.keys()}
            for i in x.keys() & y.keys():
                (d, v), (e, w) = x[i], y[i]
                if v != w or (d is None) != (e is None) or (d is not None and abs(d - e) > 1e-9):
                    out.add((b, i, "changed"))
    return out


@pytest.mark.parametrize("seed,hot_rows", [(0, 10**6), (1, 1)])
def test_snapshot_changes(spark, seed, hot_rows):
    rnd = random.Random(seed)
    files = [(f, rnd.choice(["s", "s", "s", "t", None]), rnd.choice([None, *range(30)]), rnd.choice([None, 1, 2])) for f in range(60)]
    rows = []
    for f in range(55):  # the others are empty
        for line in range(rnd.choice([0, 3, 8])):
            rows.append((f, line, rnd.choice([None, *range(5)]), rnd.choice([None, float("nan"), 1.0, 1.0 + 1e-12, 2.0]), rnd.choice([None, "", " None", "x", " x ", "X"])))
    fd = spark.createDataFrame([(f, s, at(t), at(u)) for f, s, t, u in files], "file_id long, data_source string, data_source_ts timestamp, upload_ts timestamp")
    rd = spark.createDataFrame(rows, "file_id long, line_no int, id int, double_col double, varchar_col string").withColumn("__n", F.lit("clash"))
    chain = snapshot_chain(fd, hot_rows=hot_rows, block=3)
    got = [(r.file_id, r.id, r.change_kind) for r in snapshot_changes(rd, chain, values(), {"double_col": 1e-9}, hot_rows=hot_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_changes(files, rows)


def test_snapshot_changes_of_nothing(spark):
    fd = spark.createDataFrame([], "file_id long, data_source string, data_source_ts timestamp, upload_ts timestamp")
    rd = spark.createDataFrame([], "file_id long, line_no int, id int, double_col double, varchar_col string")
    assert snapshot_changes(rd, snapshot_chain(fd), values()).count() == 0


# --- versioned tables and increments


def test_versions_and_deltas(spark):
    t = VersionedTable(CommitLog(spark, scratch(spark, "t")), "t")
    df = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "id int, v string")
    assert t.commit(add=df) == 1
    assert t.commit(delete=t.scan().where("id < 2")) == 2
    assert t.commit(add=spark.createDataFrame([(9, None)], df.schema)) == 3
    assert t.commit(add=spark.createDataFrame([(1, "z")], df.schema), replace=True) == 4
    key = lambda d: sorted((r["__change"], r.id) for r in d.collect())
    assert sorted(r.id for r in t.read(1).collect()) == list(range(6)) and sorted(r.id for r in t.read(3).collect()) == [2, 3, 4, 5, 9]
    assert key(t.changes(0, 2)) == [("insert", i) for i in (2, 3, 4, 5)]
    assert key(t.changes(1, 2)) == [("delete", 0), ("delete", 1)]
    assert key(t.changes(1, 3)) == [("delete", 0), ("delete", 1), ("insert", 9)]
    assert key(t.changes(3, 4)) == [("delete", i) for i in (2, 3, 4, 5, 9)] + [("insert", 1)]
    assert key(t.changes(2, 2)) == []


def test_commit_conflict(spark):
    log = CommitLog(spark, scratch(spark, "log"))
    log.commit(1, {"a": 1})
    with pytest.raises(CommitConflict):
        log.commit(1, {"a": 2})
    assert log.read() == {"a": 1} and log.latest() == 1


def test_consume_survives_failure(spark):
    log = CommitLog(spark, scratch(spark, "c"))
    src, out = VersionedTable(log, "src"), VersionedTable(log, "out")
    src.commit(add=spark.createDataFrame([(1,), (2,)], "id int"))
    take = lambda d: d.where("__change = 'insert'").select("id")
    assert src.consume("job", take, out)
    src.commit(add=spark.createDataFrame([(3,)], "id int"))

    def fails(d):
        d.count()
        raise OSError("lost")

    with pytest.raises(OSError):
        src.consume("job", fails, out)
    assert src.consume("job", take, out)
    assert src.consume("job", take, out) is None
    assert sorted(r.id for r in out.read().collect()) == [1, 2, 3]


def test_pending_items(spark):
    items = [(1, "T ", "dsv", "a", at(5.4), at(10)), (2, "t", "dsv", "a", at(5), at(20)), (3, "t", "dsv", "b", at(5), at(20)), (4, None, None, None, None, None), (5, "u", "dsv", None, at(1), at(3)), (6, "t", "dsv", "c", at(1), at(1))]
    audit = [("t", "dsv", "a", at(5), at(19), 1), ("T", "dsv", "b", at(5), at(20), 1), ("u", "dsv", None, at(1), at(9), 2), ("t", "dsv", "c", at(1), at(9), 3), ("t", "dsv", "c", at(1), at(9), None), ("u", "dsv", None, at(1), at(3), 1)]
    runs = [(1, " Committed"), (2, "failed"), (3, None)]
    got = pending_items(
        spark.createDataFrame(items, "item_id long, table_name string, data_source_type string, data_source string, data_source_ts timestamp, changed_ts timestamp"),
        spark.createDataFrame(audit, "table_name string, data_source_type string, data_source string, data_source_ts timestamp, upload_ts timestamp, run_id long"),
        spark.createDataFrame(runs, "run_id long, status string"),
        scratch(spark, "items"),
    )
    assert sorted(r.item_id for r in got.collect()) == [1, 4, 6]


def test_consume_gives_each_record_once_to_two_runs(spark):
    log = CommitLog(spark, scratch(spark, "c"))
    src, out, other = (VersionedTable(log, n) for n in ("src", "out", "other"))
    src.commit(add=spark.range(5).toDF("id"))
    take = lambda d: d.where("__change = 'insert'").select("id")

    def overtaken(d):
        src.consume("job", take, out)
        return take(d)

    with pytest.raises(CommitConflict):
        src.consume("job", overtaken, out)
    assert sorted(r.id for r in out.read().collect()) == list(range(5)) and src.consume("job", take, out) is None

    def beside(d):  # commits of others in between stay, and so does this run's
        other.commit(add=spark.range(2).toDF("id"))
        src.consume("another", take, other)
        return take(d)

    src.commit(add=spark.range(5, 7).toDF("id"))
    assert src.consume("job", beside, out)
    assert sorted(r.id for r in out.read().collect()) == list(range(7)) and other.read().count() == 9
    assert src.processed("job") == 3 and src.processed("another") == 4


def test_consume_survives_failure_before_its_commit(spark, monkeypatch):
    log = CommitLog(spark, scratch(spark, "c"))
    src, out = VersionedTable(log, "src"), VersionedTable(log, "out")
    src.commit(add=spark.range(3).toDF("id"))

    def lost(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(log, "commit", lost)
        with pytest.raises(OSError):
            src.consume("job", lambda d: d.select("id"), out)
    assert not out.exists() and src.processed("job") == 0
    src.consume("job", lambda d: d.select("id"), out)
    assert sorted(r.id for r in out.read().collect()) == [0, 1, 2]


def test_deletion_vectors(spark):
    for few in (True, False):
        t = VersionedTable(CommitLog(spark, scratch(spark, "t")), "t")
        t.commit(add=spark.range(0, 1000, 1, 3).toDF("id"))
        t.commit(delete=t.scan().where("id % 3 = 0"))
        t.commit(delete=t.scan().where("id % 5 = 0"))
        assert sum(d["rows"] for d in t._at(None)["dvs"].values()) < 40  # 64 positions to a row
        with pytest.MonkeyPatch.context() as m:
            m.setattr("tidemark.store.deletions.BROADCAST_BYTES", 1 << 20 if few else 0)
            assert sorted(r.id for r in t.read().collect()) == [i for i in range(1000) if i % 3 and i % 5]
            assert sorted(r.id for r in t.changes(2, 3).collect()) == [i for i in range(1000) if i % 3 and not i % 5]


def test_later_runs_read_only_the_delta(spark):
    kinds = "item_id long, table_name string, data_source_type string, data_source string, data_source_ts timestamp, changed_ts timestamp"
    log, runs = "table_name string, data_source_type string, data_source string, data_source_ts timestamp, upload_ts timestamp, run_id long", spark.createDataFrame([(1, "committed")], "run_id long, status string")
    root, items = scratch(spark, "items"), [(i, "t", "dsv", f"s{i}", at(1), at(10)) for i in range(1, 5)]
    audit = spark.createDataFrame([("t", "dsv", f"s{i}", at(1), at(20), 1) for i in (1, 2)], log)
    run = lambda rows: sorted(r.item_id for r in pending_items(spark.createDataFrame(rows, kinds), audit, runs, root).collect())
    assert run(items) == [3, 4] and run(items) == []
    assert run([*items, (5, "t", "dsv", "s1", at(1), at(30)), (6, "t", "dsv", "s9", at(1), at(1))]) == [1, 6]
    table = VersionedTable(CommitLog(spark, root), "items")
    now, before = table.processed("loader"), 2
    files = lambda df: {f.rsplit("/", 1)[-1] for f in df.inputFiles() if "/data/" in f}
    new = {f.rsplit("/", 1)[-1] for f in set(table._at(now)["files"]) - set(table._at(before)["files"])}
    changes = table.changes(before, now)
    # the files added since, and of the others only those that lost a record
    hit = {n for d, v in table._at(now)["dvs"].items() if d not in table._at(before)["dvs"] for n in v["files"]}
    assert new and files(changes) == new | hit
    assert table.read().count() == 5


def test_only_files_with_deleted_records_are_joined(spark):
    t = VersionedTable(CommitLog(spark, scratch(spark, "t")), "t")
    for n in range(3):
        t.commit(add=spark.range(n * 10, n * 10 + 10, 1, 1).toDF("id"))
    t.commit(delete=t.scan().where("id = 15"))
    gone = t.changes(3, 4)
    assert [(r.id, r["__change"]) for r in gone.collect()] == [(15, "delete")] and len([f for f in gone.inputFiles() if "/data/" in f]) == 1
    assert sorted(r.id for r in t.read().collect()) == [i for i in range(30) if i != 15]
    t.commit(delete=t.scan().where("id = 16 or id = 3"))
    assert sorted(r.id for r in t.changes(4, 5).collect()) == [3, 16] and sorted(r.id for r in t.changes(3, 5).collect()) == [3, 15, 16]
    assert sorted(r.id for r in t.changes(0, 5).collect()) == [i for i in range(30) if i not in (3, 15, 16)]


# --- error parse


def brute_split(line, d):
    """Cells by the rules, one character at a time; None if the quoting is broken."""
    cells, i, n = [], 0, len(line)
    while True:
        j = i
        while j < n and line[j] == " ":
            j += 1
        if j < n and line[j] == '"':
            j += 1
            out = ""
            while True:
                if j >= n:
                    return None
                if line[j] == '"':
                    if j + 1 < n and line[j + 1] == '"':
                        out += '"'
                        j += 2
                        continue
                    break
                out += line[j]
                j += 1
            j += 1
            while j < n and line[j] == " ":
                j += 1
            if j < n and line[j] != d:
                return None
            cells.append(out.strip(" "))
        else:
            j = i
            while j < n and line[j] != d:
                if line[j] == '"':
                    return None
                j += 1
            cells.append(line[i:j].strip(" "))
        if j >= n:
            return cells
        i = j + 1


def test_free_parse_and_costs():
    rnd = random.Random(5)
    for _ in range(6000):
        line = "".join(rnd.choice('",; a"b\n') for _ in range(rnd.randint(0, 9)))
        want = brute_split(line, ",")
        assert split_free(line, ",") == want, line
        assert (error_parse(line, ",", None)[0] == 0) == (want is not None)
        n = rnd.randint(1, 4)
        cost, edits = error_parse(line, ",", n)
        assert (cost == 0) == (want is not None and len(want) == n)
        fixed, shift = line, 0
        for how, c, i in edits:
            fixed = fixed[: i + shift] + ("" if how == "delete" else c) + fixed[i + shift + (how == "delete") :]
            shift += -1 if how == "delete" else 1
        assert len(edits) == cost and len(brute_split(fixed, ",")) == n, (line, edits, fixed)


def test_error_parse_is_cheapest():
    rnd = random.Random(6)

    def edits1(s):
        for i in range(len(s) + 1):
            for c in '",':
                yield s[:i] + c + s[i:]
            if i < len(s) and s[i] in '",':
                yield s[:i] + s[i + 1 :]

    for _ in range(150):
        line, n = "".join(rnd.choice('",ab ') for _ in range(rnd.randint(0, 6))), rnd.randint(1, 3)
        level, cost = {line}, 0
        while not any((c := brute_split(s, ",")) is not None and len(c) == n for s in level):
            level, cost = {x for s in level for x in edits1(s)}, cost + 1
        assert error_parse(line, ",", n)[0] == cost, (line, n)


def test_error_parses_of_many_are_as_cheap_as_of_one():
    rnd = random.Random(8)
    for n in (1, 2, 3, 5, 30):
        lines = ["".join(rnd.choice('";ab  ') for _ in range(rnd.randint(0, 14))) for _ in range(200)]
        for line, (free, cost, edits) in zip(lines, error_parses(lines, [";"] * len(lines), n)):
            assert (free, cost) == (error_parse(line, ";", None)[0], error_parse(line, ";", n)[0]) and len(edits) == cost
            fixed, shift = line, 0
            for how, c, i in edits:
                fixed = fixed[: i + shift] + ("" if how == "delete" else c) + fixed[i + shift + (how == "delete") :]
                shift += -1 if how == "delete" else 1
            cells = brute_split(fixed, ";")
            assert cells is not None and len(cells) == n, (line, edits, fixed)
            assert (free == 0) == (brute_split(line, ";") is not None)


def test_lines_are_parsed_as_records_are(spark):
    """The zero-cost layer in the JVM, its values and the reasons against one record at a time in Python."""
    rnd = random.Random(9)
    heads = {1: "id,double_col,varchar_col", 2: "varchar_col | id|x| double_col", 3: 'id;"double_col";varchar_col;id', 4: "double_col:id"}
    parts = ['"', '""', "1", "-2", " ", "None", "x", "1e400", "2.5e1", "\n", "\ufffd", "\u0663", "y" * 21, "00000000000007", "2147483648"]
    rows = [(f, 1, h) for f, h in heads.items()]
    for n in range(2, 700):
        f = rnd.randint(1, 5)
        d = header_of(heads.get(f))[0]
        line = "".join(rnd.choice([*parts, d, d, d]) for _ in range(rnd.randint(0, 9)))
        rows.append((f, n, rnd.choice(["", "\ufeff"]) + line + rnd.choice(["", "\r"])))
    for f, n in ((1, 800), (2, 801)):
        rows.append((f, n, '"' + '""x' * 50_000 + '"' + header_of(heads[f])[0] * (len(header_of(heads[f])[1]) - 1)))
    got = {(r.file_id, r.line_no): r for r in parse_lines(spark.createDataFrame(rows, "file_id long, line_no int, line string")).collect()}
    want = {}
    for f, n, line in rows:
        text = line.removeprefix("\ufeff").removesuffix("\r")
        if n > 1 and text.strip(" "):
            reason, values, _, cost = parse_record(text, *header_of(heads.get(f)))
            v, x = (values.get(c, "") for c in ("varchar_col", "double_col"))
            want[f, n] = (reason, None if reason else (int(values["id"]), None if x in ("", "None") else float(x), None if v in ("", "None") else v), cost)
    assert got.keys() == want.keys()
    for k, (reason, loads, cost) in want.items():
        r = got[k]
        assert (r.reason, None if reason else (r.id, r.double_col, r.varchar_col)) == (reason, loads), k
        assert (r.cost == cost or (reason or "").startswith("invalid")) and bool(r.edits) == bool(reason)


def test_reasons(spark):
    lines = [
        (1, 1, '﻿id;double_col;varchar_col\r'), (1, 2, "1;2.5;x\r"), (1, 3, " "), (1, 4, None), (1, 5, '"2";None;"a;b"'), (1, 6, '3;1;"a'), (1, 7, "3;1"), (1, 8, "x;1;a"), (1, 9, "2147483648;1;a"),
        (1, 10, "4;.5;a"), (1, 11, "4;1e999;a"), (1, 12, "4;;" + "a" * 21), (1, 13, "4;;�"), (1, 14, "4;+1.5E-3;" + "é" * 20), (1, 15, "\r"), (1, 16, "x;1"), (1, 16, "x;1"),
        (2, 1, "varchar_col,id,double_col,extra"), (2, 2, 'a"b,1,2,3'), (2, 3, "a,1,2,3"), (3, 7, "5,6,seven"), (None, 2, "8,9,ten"),
    ]
    parsed = parse_lines(spark.createDataFrame(lines, "file_id long, line_no int, line string"))
    bad = sorted((r.file_id, r.line_no, r.reason) for r in rejects(parsed).collect())
    assert bad == [
        (1, 6, "quoting"), (1, 7, "column_count"), (1, 8, "invalid_id"), (1, 9, "invalid_id"), (1, 10, "invalid_double_col"), (1, 11, "invalid_double_col"),
        (1, 12, "invalid_varchar_col"), (1, 13, "invalid_varchar_col"), (1, 16, "column_count"), (1, 16, "column_count"), (2, 2, "quoting"),
    ]
    good = {(r.file_id, r.line_no): (r.id, r.double_col, r.varchar_col) for r in loaded(parsed).collect()}
    assert good == {(1, 2): (1, 2.5, "x"), (1, 5): (2, None, "a;b"), (1, 14): (4, 0.0015, "é" * 20), (2, 3): (1, 2.0, "a"), (3, 7): (5, 6.0, "seven"), (None, 2): (8, 9.0, "ten")}
    assert parse_lines(spark.createDataFrame([], "file_id long, line_no int, line string")).count() == 0


def test_long_record():
    line = "1," + "x" * 300_000 + ',"y'
    reason, _, edits, cost = parse_record(line, *header_of("id,double_col,varchar_col"))
    assert (reason, cost) == ("quoting", 1) and edits.startswith("delete")


# --- chains


def brute_chains(rows):
    best = {}
    for i, f, t, d, v, u, n in rows:
        if i is None or f is None:
            continue
        rank = (u is not None, u or 0, n)
        if (i, f) not in best or rank > best[i, f][0]:
            best[i, f] = (rank, OPEN if t is None else us(t), None if d is None or d != d else d, clean(v))
    out = []
    by = defaultdict(list)
    for (i, f), (_, t, d, v) in best.items():
        by[i].append((us(f), t, d, v))
    for i, rs in by.items():
        rs.sort(key=lambda r: r[0])
        mine = []
        for r, nxt in zip(rs, [*rs[1:], None]):
            t = r[1] if nxt is None else min(r[1], nxt[0])
            if t <= r[0]:
                continue
            if mine and mine[-1][1] == r[0] and mine[-1][2:] == r[2:]:
                mine[-1] = (mine[-1][0], t, *r[2:])
            else:
                mine.append((r[0], t, *r[2:]))
        out += [(i, *m) for m in mine]
    return sorted(out, key=repr)


UPDATES = "id int, __valid_from timestamp, __valid_to timestamp, double_col double, varchar_col string, upload_ts timestamp, update_id long"


def updates(rnd, n, hot=0.4):
    out = []
    for k in range(n):
        f = rnd.choice([None, *range(40)])
        t = rnd.choice([None, None, rnd.randint(0, 45)])
        out.append((0 if rnd.random() < hot else rnd.choice([None, 1, 2, 3, 4]), f, t, rnd.choice([None, float("nan"), 0.0, 1.0]), rnd.choice([None, "", "a", " a", "b"]), rnd.choice([None, *range(9)]), k))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, at(f), at(t), d, v, at(u), n) for i, f, t, d, v, u, n in rows], UPDATES)


def how():
    return {"key": "id", "start": "__valid_from", "end": "__valid_to", "rank": ("upload_ts", "update_id"), "values": values()}


def chains(df):
    return sorted(((r.id, r.valid_from_us, r.valid_to_us, r.double_col, r.varchar_col) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,hot_rows", [(0, 10**6), (1, 5), (2, 5)])
def test_chains(spark, seed, hot_rows):
    rows = updates(random.Random(seed), 300)
    assert chains(build_chains(frame(spark, rows), hot_rows=hot_rows, **how())) == brute_chains(rows)


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_rebuild_touches_only_its_chains(spark, hot_rows):
    rnd = random.Random(7)
    first, late = updates(rnd, 200), [(i, f, t, d, v, u, n + 1000) for i, f, t, d, v, u, n in updates(rnd, 20, 0.3) if i in (None, 0, 1)]
    t = VersionedTable(CommitLog(spark, scratch(spark, "chains")), "chains")
    t.commit(add=build_chains(frame(spark, first), **how()))
    before = {(r[FILE], r[POS]): r.id for r in t.scan().collect()}
    rebuild_chains(t, frame(spark, first + late), frame(spark, late), hot_rows=hot_rows, **how())
    got, want = chains(t.read()), brute_chains(first + late)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    kept = {(r[FILE], r[POS]) for r in t.scan().collect()}
    assert {k for k, i in before.items() if i not in (0, 1)} <= kept


def test_chains_of_nothing(spark):
    assert build_chains(frame(spark, []), **how()).count() == 0
    assert build_chains(frame(spark, [(None, 1, None, 1.0, "a", 1, 1), (1, None, None, 1.0, "a", 1, 2)]), **how()).count() == 0


# --- survivors


@pytest.mark.parametrize("seed", range(3))
def test_survivors(spark, seed):
    rnd = random.Random(seed)
    rows = [(n, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(6)]), rnd.choice([None, 1.0, 2.0]), rnd.choice([None, "x", "y"]), rnd.choice([None, 0, 1, 2]), rnd.choice([None, *range(5)])) for n in range(1, 200)]
    df = spark.createDataFrame(rows, "row_id long, g string, id int, x double, y string, trust int, ts long")
    got = survivors(df, ["g", "id"], {"x": F.col("x"), "y": F.col("y")}, F.col("trust"), F.col("ts"), F.col("row_id"), F.col("g") == "b", F.col("g") == "c")
    by = defaultdict(list)
    for r in rows:
        by[r[1], r[2]].append(r)
    want = {}
    for (g, i), rs in by.items():
        if len(rs) < 2:
            continue
        old = g == "b"
        rank = lambda r: (r[5] is not None, r[5] or 0, r[6] is not None, (-r[6] if old else r[6]) if r[6] is not None else 0, -r[0] if old else r[0])  # noqa: E731, B023
        picks = []
        for c in (3, 4):
            full = [r for r in rs if r[c] is not None]
            picks.append(max(full, key=rank)[0] if full else 0)
        if g == "c" and any(len({r[c] for r in rs if r[c] is not None}) > 1 for c in (3, 4)):
            picks = [-1, -1]
        want[g, i] = (len(rs), *picks)
    assert {(r.g, r.id): (r.n_rows, r.x_row, r.y_row) for r in got.collect()} == want
    seen = {(r.g, r.id): (r.n_skyline, r.n_layers) for r in got.collect()}
    for (g, i), rs in by.items():
        if (g, i) not in seen:
            continue
        old = g == "b"
        late = lambda r: (r[6] is not None, (-r[6] if old else r[6]) if r[6] is not None else 0, -r[0] if old else r[0])  # noqa: E731, B023
        trust = lambda r: -1 if r[5] is None else r[5]
        dims = lambda r: ((r[3] is not None) + (r[4] is not None), trust(r), late(r))  # noqa: E731, B023
        left, layers, taken = list(rs), [], {3: None, 4: None}
        while left:
            layer = [r for r in left if not any(o is not r and all(a >= b for a, b in zip(dims(o), dims(r))) for o in left)]
            layers.append(layer)
            for c in taken:
                taken[c] = max([(trust(r), late(r)) for r in layer if r[c] is not None] + ([taken[c]] if taken[c] else []), default=None)
            left = [r for r in left if r not in layer and any(r[c] is not None and (taken[c] is None or (trust(r), late(r)) > taken[c]) for c in taken)]
        assert seen[g, i] == (len(layers[0]), len(layers))
    few = survivors(df, ["g", "id"], {"x": F.col("x"), "y": F.col("y")}, F.col("trust"), F.col("ts"), F.col("row_id"), F.col("g") == "b", F.col("g") == "c", hot_rows=1)
    assert {(r.g, r.id): (r.n_rows, r.x_row, r.y_row) for r in few.collect()} == want


@pytest.mark.parametrize("hot_rows", [1, 40])
def test_survivors_of_hot_groups(spark, hot_rows):
    """Layers in ranges are those of whole groups; a staircase of trust and time is all skyline."""
    rnd = random.Random(7)
    some = lambda *v: rnd.choice([None, *v])
    rows = [(n, rnd.choice(["a", "b", "c", None]), some(1.0, 2.0), some("x", "y"), some(1, 2), some(*range(30)), some(*range(90))) for n in range(1, 400)]
    rows += [(n, "stairs", 1.0, "x", 1, n, -n) for n in range(1000, 1060)]
    # beaten by the stairs' full records, or only where those hold nothing
    rows += [(n, "stairs", None, "z", None, n - 1000, -n) for n in range(1060, 1100)] + [(n, "late", n % 2 * 1.0 or None, None if n % 2 else "y", None, n, -n) for n in range(60)]
    df = spark.createDataFrame(rows, "row_id long, g string, x double, y string, z int, trust int, ts long")
    how = (["g"], {c: F.col(c) for c in "xyz"}, F.col("trust"), F.col("ts"), F.col("row_id"), F.col("g") == "b", F.col("g") == "c")
    whole = {r.g: r for r in survivors(df, *how).collect()}
    assert (whole["stairs"].n_rows, whole["stairs"].n_skyline) == (100, 60)
    assert max(r.n_layers for r in whole.values()) > 1
    assert {r.g: r for r in survivors(df, *how, hot_rows=hot_rows).collect()} == whole


def test_extra_columns_with_clashing_names(spark):
    extra = {c: F.lit("x") for c in ("__row", "__rank", "__late", "__next", "__range", "__salt", "__n", "__mask", "__change", "__file", "valid_from_us", "old", "reason", "head")}
    up = frame(spark, updates(random.Random(5), 60))
    assert chains(build_chains(up.withColumns(extra), hot_rows=5, **how())) == chains(build_chains(up, **how()))
    raw = spark.createDataFrame([(1, 1, "id,double_col"), (1, 2, "x,1")], "file_id long, line_no int, line string").withColumns(extra)
    assert [r.reason for r in rejects(parse_lines(raw)).collect()] == ["invalid_id"]
    df = spark.createDataFrame([(1, "g", 1.0, 1, 1), (2, "g", 2.0, 2, 1)], "row_id long, g string, x double, trust int, ts long").withColumns(extra)
    assert [r.x for r in survivors(df, ["g"], {"x": F.col("x")}, F.col("trust"), F.col("ts"), F.col("row_id")).collect()] == [2.0]
    items = spark.createDataFrame([(1, "t", "dsv", "a", at(5), at(9))], "item_id long, table_name string, data_source_type string, data_source string, data_source_ts timestamp, changed_ts timestamp").withColumns(extra)
    log = spark.createDataFrame([], "table_name string, data_source_type string, data_source string, data_source_ts timestamp, upload_ts timestamp, run_id long").withColumns(extra)
    runs = spark.createDataFrame([(1, "committed")], "run_id long, status string").withColumns(extra)
    assert [r.item_id for r in pending_items(items, log, runs, scratch(spark, "items")).collect()] == [1]
    assert pending_items(items.limit(0), log, runs, scratch(spark, "items")).count() == 0


def test_survivors_of_nothing(spark):
    df = spark.createDataFrame([], "row_id long, g string, x double, trust int, ts long")
    assert survivors(df, ["g"], {"x": F.col("x")}, F.col("trust"), F.col("ts"), F.col("row_id")).count() == 0
