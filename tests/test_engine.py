"""Tables, upserts, slices, pipelines and sources."""

import io
import json
import os
import random
import zipfile
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config.model import DatasetConfig, EngineConfig, IngestColumn, TableConfig, TableConfigs
from tidemark.functions.registry import readers, transforms
from tidemark.operators import delta, diff, ingest
from tidemark.operators.delta import Field, Policy
from tidemark.operators.foreign_keys import deduce_keys
from tidemark.operators.history import bulk_history
from tidemark.operators.skew import dense_numbers
from tidemark.operators.temporal import FROM, SENTINEL, TO, TimeSlice
from tidemark.plans.audit_log import AuditLog
from tidemark.plans.pipeline import DatasetRunner, run_datasets, run_transaction
from tidemark.session import scratch
from tidemark.sources import ipc
from tidemark.sources.dsv import clean_payload, load_typed_dsv, sniff, spans_lines
from tidemark.sources.files import file_time, find_files
from tidemark.sources.ipc import arrow_size, from_ipc_b64, to_ipc_b64
from tidemark.sources.ziptools import convert_zipped_csvs_to_parquet, read_zipfile
from tidemark.store.log import CommitConflict
from tidemark.store.tables import Database
from tidemark.streaming.messages import JetStreamClient, MessageDataSource, StreamMissing, decode_json, message_batches, start_stream
from tidemark.streaming.tracker import UpdateTracker
from tidemark.types import cast, literal, spark_type, sql_type, text_length
from tidemark.utils import Clock, NonRetryable, as_sql_date, as_sql_datetime, flatten_list, is_text_type, load_yaml, nested, strip_outer_quotes


def y(n, s=1):
    return datetime(n, 1, 1, 0, 0, s, tzinfo=timezone.utc)


@pytest.fixture
def db(spark):
    return Database(spark, scratch(spark, "db"))


SIMPLE = {"schema": "test", "name": "simple", "is_temporal": True, "primary_keys": ["id"], "columns": [{"name": "id", "data_type": "INT"}, {"name": "double_col", "data_type": "DOUBLE"}, {"name": "varchar_col", "data_type": "VARCHAR(20)"}]}


def simple(spark, rows):
    return spark.createDataFrame([(i, d, None) for i, d in rows], "id int, double_col double, varchar_col string")


def year(us):
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)).year


def seen(df):
    """{(id, value, year from, year to)}; live rows without the last."""
    rows = df.select("id", "double_col", F.unix_micros(FROM).alias("f"), F.unix_micros(TO).alias("t")).collect()
    return sorted(((r.id, r.double_col, year(r.f)) if year(r.t) == 2038 else (r.id, r.double_col, year(r.f), year(r.t)) for r in rows), key=repr)


STEPS = [
    (1985, [(1, 100.1), (2, -200.2), (3, None), (4, 400.4), (5, -500.5), (6, 600.6), (7, 700.7), (8, -800.8)]),
    (1987, [(1, 100.1), (2, -200.2), (3, None), (4, None), (5, -500.5), (6, 600.6), (7, 700.7), (8, -800.8)]),
    (1988, [(1, 100.1), (2, -200.2), (3, None), (4, None), (6, 600.6), (7, 700.7), (8, -800.8)]),
    (1989, [(1, 100.1), (2, -200.2), (3, None), (4, 444.444), (7, 700.7), (8, -800.8)]),
    (1990, [(1, 100.1), (2, -200.2), (3, None), (4, 444.444), (7, 700.7), (8, -800.8), (9, -999.999)]),
    (1991, [(1, 100.123), (2, -200.2), (3, None), (4, 444.444), (7, 700.7), (8, -800.8), (9, -999.999), (10, 111.111)]),
    (1992, [(1, 100.123), (2, -200.234), (3, None), (4, 444.444), (7, 700.7), (9, -999.999), (10, 111.111)]),
]
LIVE = [(1, 100.123, 1991), (2, -200.234, 1992), (3, None, 1985), (4, 444.444, 1989), (7, 700.7, 1985), (9, -999.999, 1990), (10, 111.111, 1991)]
ENDED = [(1, 100.1, 1985, 1991), (2, -200.2, 1985, 1992), (4, 400.4, 1985, 1987), (4, None, 1987, 1989), (5, -500.5, 1985, 1988), (6, 600.6, 1985, 1989), (8, -800.8, 1985, 1992)]


@pytest.mark.parametrize("unchanged", [True, False])
def test_dropout_sequence(spark, db, unchanged):
    db.create(TableConfig.of(SIMPLE))
    for t, rows in STEPS:
        counts = db.table_upsert_temporal(simple(spark, rows), "test", "simple", Policy(unchanged, "take_last", row_finality="dropout"), y(t))
    assert tuple(counts) == (0, 1, 1 + (6 if unchanged else 0))
    assert seen(db.from_table("test", "simple")) == sorted(LIVE, key=repr)
    assert seen(db.from_table("test", "simple", TimeSlice("all"))) == sorted(LIVE + ENDED, key=repr)
    assert [r[0] for r in seen(db.from_table("test", "simple", TimeSlice("asof", y(1988, 2))).orderBy("id"))] == [1, 2, 3, 4, 6, 7, 8]
    db.begin().compact("test.simple")


@pytest.mark.parametrize("finality,hot_rows", [("dropout", 10**6), ("disabled", 10**6), ("dropout", 2), ("disabled", 2)])
def test_one_pass_equals_the_sequence(spark, finality, hot_rows):
    fields = [Field("id", "INT", False), Field("double_col", "DOUBLE"), Field("varchar_col", "VARCHAR(20)")]
    empty = spark.createDataFrame([], f"id int, double_col double, varchar_col string, {FROM} timestamp")
    rows = spark.createDataFrame([(i, d, None, y(t)) for t, rs in STEPS for i, d in rs], "id int, double_col double, varchar_col string, t timestamp")
    got = bulk_history(empty, rows, ["id"], fields, "t", finality == "dropout", hot_rows=hot_rows)
    if finality == "dropout":
        assert seen(got) == sorted(LIVE + ENDED, key=repr)
    else:
        gone = [(5, -500.5, 1985), (6, 600.6, 1985), (8, -800.8, 1985)]
        assert seen(got) == sorted(LIVE + gone + [e for e in ENDED if e[0] not in (5, 6, 8)], key=repr)
    # in two passes, the second one on what the first left
    first = bulk_history(empty, rows.where(F.year("t") < 1989), ["id"], fields, "t", finality == "dropout", hot_rows=hot_rows)
    live = first.where(F.year(TO) == 2038).drop(TO)
    second = bulk_history(live, rows.where(F.year("t") >= 1989), ["id"], fields, "t", finality == "dropout", hot_rows=hot_rows)
    assert sorted(seen(first.where(F.year(TO) != 2038)) + seen(second), key=repr) == seen(got)


@pytest.mark.parametrize("dropout", [True, False])
@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_one_pass_equals_merging_in_turn(spark, db, dropout, hot_rows):
    """Random batches, one value column of each kind of null policy."""
    rnd = random.Random(11 + dropout)
    table = {"schema": "s", "name": "t", "is_temporal": True, "primary_keys": ["id"], "columns": [{"name": "id", "data_type": "INT"}, {"name": "a", "data_type": "INT"}, {"name": "b", "data_type": "INT", "nullable": False, "default_value": 7}, {"name": "c", "data_type": "INT", "nullable": False}]}
    config = TableConfig.of(table)
    db.create(config)
    rows, known = [], set()
    for t in range(2000, 2005):
        now = {k for k in (1, 2, 3) if rnd.random() < 0.6}
        rows.append((9, None, 1, 1, y(t)))  # no batch is empty
        rows += [(k, rnd.choice([None, 1]), rnd.choice([None, 7, 8]), rnd.choice([None, 1, 2]) if k in known else 1, y(t)) for k in sorted(now)]
        known = now if dropout else known | now
    df = spark.createDataFrame(rows, "id int, a int, b int, c int, t timestamp")
    p = Policy(False, "take_last", row_finality="dropout" if dropout else "disabled")
    for t in range(2000, 2005):
        tx = db.begin()
        # a default also stands in for a null of a new row
        tx.merge("s.t", df.where(F.year("t") == t).drop("t").withColumn("b", F.coalesce("b", F.lit(7))), y(t), p)
        tx.commit()
    show = lambda d: sorted(((r.id, r.a, r.b, r.c, r.f, r.t) for r in d.select("id", "a", "b", "c", F.year(FROM).alias("f"), F.year(TO).alias("t")).collect()), key=repr)
    empty = spark.createDataFrame([], f"id int, a int, b int, c int, {FROM} timestamp")
    assert show(bulk_history(empty, df, ["id"], config.fields, "t", dropout, hot_rows=hot_rows)) == show(db.from_table("s", "t", TimeSlice("all")))


def test_empty_upload_ends_all_and_reinsert(spark, db):
    db.create(TableConfig.of(SIMPLE))
    p = Policy(True, "take_last", row_finality="dropout")
    db.table_upsert_temporal(simple(spark, [(1, 1.0), (2, 2.0)]), "test", "simple", p, y(2000))
    assert tuple(db.table_upsert_temporal(simple(spark, []), "test", "simple", p, y(2001))) == (0, 0, 2)
    db.table_upsert_temporal(simple(spark, [(1, 1.0)]), "test", "simple", p, y(2002))
    assert seen(db.from_table("test", "simple", TimeSlice("all"))) == [(1, 1.0, 2000, 2001), (1, 1.0, 2002), (2, 2.0, 2000, 2001)]
    with pytest.raises(Exception, match="newer than the update"):
        db.table_upsert_temporal(simple(spark, [(1, 9.0)]), "test", "simple", p, y(1999))
    # empty batches in one pass
    f = [Field("id", "INT", False), Field("double_col", "DOUBLE"), Field("varchar_col", "VARCHAR(20)")]
    rows = simple(spark, [(1, 1.0)]).withColumn("t", F.lit(y(2000))).unionByName(simple(spark, [(1, 1.0)]).withColumn("t", F.lit(y(2002))))
    got = bulk_history(spark.createDataFrame([], f"id int, double_col double, varchar_col string, {FROM} timestamp"), rows, ["id"], f, "t", True, spark.createDataFrame([(y(2001),)], "t timestamp"))
    assert seen(got) == [(1, 1.0, 2000, 2001), (1, 1.0, 2002)]


def test_slices_at_the_edges(spark, db):
    db.create(TableConfig.of(SIMPLE))
    for t, v in ((2000, 1.0), (2001, 2.0), (2002, 3.0)):
        db.table_upsert_temporal(simple(spark, [(1, v)]), "test", "simple", Policy(True, "take_last"), y(t))
    at = lambda m, t, h=timedelta(0): [r[1] for r in seen(db.from_table("test", "simple", TimeSlice(m, t, h)))]
    assert at("asof", y(2001)) == [2.0] and at("asof", y(1999)) == [] and at("span", y(2001)) == [2.0]
    assert at("span", y(2001), timedelta(seconds=1)) == [1.0, 2.0]
    assert at("span", y(2002), y(2002) - y(2001)) == [2.0, 3.0]  # the first ended just then
    with pytest.raises(ValueError):
        TimeSlice("asof")
    with pytest.raises(ValueError):
        TimeSlice("never")


def test_collation(spark, db):
    db.create(TableConfig.of({"schema": "s", "name": "t", "collation": "UNICODE_CI", "is_temporal": True, "primary_keys": ["k"], "columns": [{"name": "k", "data_type": "VARCHAR(9)"}, {"name": "v", "data_type": "VARCHAR(9)"}]}))
    df = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    p = Policy(True, "take_last")
    db.table_upsert_temporal(df(("a", "x"), ("b", "y")), "s", "t", p, y(2000))
    assert tuple(db.table_upsert_temporal(df(("A", "X"), ("B", "z")), "s", "t", p, y(2001))) == (0, 1, 1)
    assert db.from_table("s", "t", TimeSlice("all")).count() == 3
    assert db.timed("count", lambda: db.row_count("s", "t")) == 2 and Clock.shared().get_avg("count") > 0


def test_null_policies(spark, db):
    db.create(TableConfig.of({"schema": "s", "name": "t", "primary_keys": ["id"], "columns": [{"name": "id", "data_type": "INT"}, {"name": "a", "data_type": "INT"}, {"name": "b", "data_type": "INT", "nullable": False, "default_value": 7}, {"name": "c", "data_type": "INT", "nullable": False}]}))
    df = lambda *r: spark.createDataFrame(list(r), "id int, a int, b int, c int")
    db.table_upsert_temporal(df((1, 1, 1, 1), (None, 1, 1, 1)), "s", "t", Policy())
    db.table_upsert_temporal(df((1, None, None, None)), "s", "t", Policy())
    assert [tuple(r) for r in db.from_table("s", "t").collect()] == [(1, None, 7, 1)]
    f = [Field("id", "INT", False), Field("a", "INT"), Field("b", "INT", False, "7"), Field("c", "INT", False)]
    rows = spark.createDataFrame([(1, 1, 1, 1, y(2000)), (1, None, None, None, y(2001)), (1, 2, 3, 4, y(2002))], "id int, a int, b int, c int, t timestamp")
    empty = spark.createDataFrame([], f"id int, a int, b int, c int, {FROM} timestamp")
    for hot_rows in (10**6, 1):
        got = sorted((r.a or 0, r.b, r.c) for r in bulk_history(empty, rows, ["id"], f, "t", hot_rows=hot_rows).collect())
        assert got == [(0, 7, 1), (1, 1, 1), (2, 3, 4)]
    with pytest.raises(Exception, match="lacks a value"):
        bulk_history(empty, rows.where("a IS NULL"), ["id"], f, "t").collect()


def test_duplicate_keys(spark, db):
    db.create(TableConfig.of(SIMPLE))
    rows = spark.createDataFrame([(1, 1.0, "a", 0), (1, 2.0, "b", 1), (1, 3.0, "c", 2), (2, 5.0, "x", 3), (2, 5.0, "x", 4)], f"id int, double_col double, varchar_col string, {delta.ORD} long")
    for policy, want in (("take_first", 1.0), ("take_last", 3.0)):
        got = {r.id: r.double_col for r in delta.resolve_duplicates(rows, ["id"], policy).collect()}
        assert got == {1: want, 2: 5.0}
    with pytest.raises(Exception, match="duplicate key"):
        delta.resolve_duplicates(rows, ["id"], "error").collect()
    assert delta.resolve_duplicates(rows.where("id = 2"), ["id"], "error").count() == 1
    assert [r.id for r in delta.dedupe(rows, ["id"], "none").collect()] == []
    assert delta.dedupe(rows.drop(delta.ORD), ["nothing"]).count() == 4


def test_insert_update_delete(spark, db):
    db.create(TableConfig.of({**SIMPLE, "name": "plain", "is_temporal": False}))
    assert db.table_insert(simple(spark, [(1, 1.0), (2, 2.0), (2, 3.0)]).withColumn("other", F.lit(1)), "test", "plain", ["id"]) == 2
    with pytest.raises(ValueError, match="duplicate"):
        db.table_insert(simple(spark, [(1, 1.0)]), "test", "plain")
    db.table_update(spark.createDataFrame([(1, 9.0), (None, 8.0)], "id int, double_col double"), "test", "plain")
    assert {r.id: r.double_col for r in db.from_table("test", "plain").collect()} == {1: 9.0, 2: 3.0}
    assert db.table_delete_rows(spark.createDataFrame([(1,), (5,)], "id int"), "test", "plain") == 1
    with pytest.raises(ValueError):
        db.table_delete_rows(simple(spark, []), "test", "plain")
    assert db.table_insert(simple(spark, []), "test", "plain", clear_table_first=True) == 0 and db.row_count("test", "plain") == 0
    # temporal: an update and a delete keep what was
    db.create(TableConfig.of(SIMPLE))
    db.table_insert(simple(spark, [(1, 1.0), (2, 2.0)]), "test", "simple", update_time=y(2000))
    db.table_update(spark.createDataFrame([(1, 5.0), (2, 2.0)], "id int, double_col double"), "test", "simple", update_time=y(2001))
    assert db.table_delete_rows_temporal(spark.createDataFrame([(2,)], "id int"), "test", "simple", y(2002)) == 1
    assert seen(db.from_table("test", "simple", TimeSlice("all"))) == [(1, 1.0, 2000, 2001), (1, 5.0, 2001), (2, 2.0, 2000, 2002)]


def test_constraints(spark, db):
    parent = {"schema": "s", "name": "p", "primary_keys": ["id"], "forbid_drop_table": True, "columns": [{"name": "id", "data_type": "INT", "autoincrement": True}, {"name": "name", "data_type": "VARCHAR(3)", "unique_constraint": ["u"]}]}
    child = {"schema": "s", "name": "c", "primary_keys": ["k"], "foreign_keys": [{"name": "p_id", "references": {"schema": "s", "table": "p", "column": "id"}}], "columns": [{"name": "k", "data_type": "INT"}, {"name": "p_id", "data_type": "INT", "default_value": "1"}]}
    configs = TableConfigs([child, parent])
    assert [t.name for t in configs.ordered()] == ["p", "c"] and configs.schemas() == ["s"]
    db.create_all(configs)
    db.create_all(configs)
    assert db.table_insert(spark.createDataFrame([("b",), ("a",)], "name string"), "s", "p") == 2
    assert db.table_insert(spark.createDataFrame([("c",)], "name string"), "s", "p") == 1
    assert {(r.id, r.name) for r in db.from_table("s", "p").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    for rows, schema, table, why in (([("a",)], "name string", "p", "duplicate"), ([("long",)], "name string", "p", "too long"), ([(1, 9)], "k int, p_id int", "c", "no row"), ([(None, 1)], "k int, p_id int", "c", "nulls")):
        with pytest.raises(ValueError, match=why):
            db.table_insert(spark.createDataFrame(rows, schema), "s", table)
    assert db.table_insert(spark.createDataFrame([(1, None)], "k int, p_id int"), "s", "c", prefill_nulls_with_default=True) == 1
    assert db.from_table("s", "c").first().p_id == 1
    assert db.primary_keys("s", "c") == ["k"] and db.has_all_columns("s", "c", ["k"]) and db.column_intersection("s", "c", ["x", "p_id"]) == ["p_id"] and not db.is_temporal("s", "c")
    with pytest.raises(ValueError, match="dropped"):
        db.drop_all(configs)
    db.drop("s", "c")
    assert not db.table_exists("s", "c")
    with pytest.raises(ValueError):
        db.from_table("s", "c")
    with pytest.raises(ValueError):
        TableConfig.of({**child, "primary_keys": ["nope"]})


def test_type_check_sees_the_last_column(spark):
    have = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    with pytest.raises(ValueError, match="b "):
        delta.check_types(have, [], {"a": "a", "b": "b"}, {"a": T.IntegerType(), "b": T.DoubleType()})


def test_concurrent_writers(spark, db):
    db.create(TableConfig.of({**SIMPLE, "is_temporal": False}))
    one, two = db.begin(), db.begin()
    one.put("test.simple", append=simple(spark, [(1, 1.0)]))
    two.put("test.simple", append=simple(spark, [(2, 2.0)]))
    one.commit()
    with pytest.raises(CommitConflict):
        two.commit()
    assert [r.id for r in db.from_table("test", "simple").collect()] == [1]


def test_raw_sql_and_lookup(spark, db):
    db.create(TableConfig.of(SIMPLE))
    for t, v in ((2000, 1.0), (2001, 2.0)):
        db.table_upsert_temporal(simple(spark, [(1, v), (2, 5.0)]), "test", "simple", Policy(True), y(t))
    assert db.from_raw_sql("select * from test.simple").columns == ["id", "double_col", "varchar_col"]
    assert db.from_raw_sql("select count(*) n from test.simple for system_time all").first().n == 3
    assert db.from_raw_sql("select id, __valid_from from test.simple where id = 1", {"id": T.LongType()}).first().id == 1
    assert db.from_raw_sql("select double_col from test.simple for system_time as of '2000-06-01' where id = 1").first()[0] == 1.0
    keys = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert db.table_query("test", "simple", keys, ["id", "double_col"], TimeSlice("asof", y(2000, 9))).select("id", "double_col").collect() == [(1, 1.0)]
    db.table_create("test", "made", keys, ["id"])
    assert db.table_config("test", "made").columns[0].data_type == "INT"
    db.table_create("test", "view_only", keys, tbl_for_types=("test", "simple"), is_temporary_table=True)
    assert spark.table("view_only").count() == 3
    assert db.variables("spark.sql.session.time%").first()[0] == "UTC"


ALL_TYPES = [
    ("bigint_col", "BIGINT", "9223372036854775807"), ("bit_col", "BIT", "0"), ("bool_col", "BOOL", "0"), ("boolean_col", "BOOLEAN", "false"), ("char_col", "CHAR(1)", "?"), ("date_col", "DATE", "1985-10-26"), ("datetime_col", "DATETIME", "1985-10-26T01:21:00"),
    ("decimal_col", "DECIMAL(10,2)", "2.71"), ("double_col", "DOUBLE", "1.618033988749895"), ("float_col", "FLOAT", "1.1"), ("int_col", "INT", "1"), ("integer_col", "INTEGER", "1"), ("mediumint_col", "MEDIUMINT", "1"), ("numeric_col", "NUMERIC(8,5)", "3.14159"),
    ("real_col", "REAL", "1.616255e-35"), ("smallint_col", "SMALLINT", "1"), ("text_col", "TEXT(16)", "?abcdef?"), ("time_col", "TIME", "01:20:00"), ("timestamp_col", "TIMESTAMP", "1985-10-26T01:20:00"), ("tinyint_col", "TINYINT", "1"), ("varchar_col", "VARCHAR(32)", "?abcdefghijklmn?"),
]


def test_raw_sql_reads_names_only_where_tables_stand(spark, db):
    db.create(TableConfig.of({"schema": "shop", "name": "o", "primary_keys": ["k"], "columns": [{"name": "k", "data_type": "INT"}, {"name": "v", "data_type": "VARCHAR(20)"}]}))
    db.table_insert(spark.createDataFrame([(1, "shop.o"), (2, "{x}")], "k int, v string"), "shop", "o")
    ask = lambda q: [tuple(r) for r in db.from_raw_sql(q).collect()]
    assert ask("select k from shop.o where v = 'shop.o'") == [(1,)]
    assert ask('select k /* from shop.o /* nested */ */ from `shop`.O -- shop.o\n where v = "{x}"') == [(2,)]
    assert ask("select shop.o.k, b.k from shop.o, shop.o b where shop.o.k < b.k") == [(1, 2)]
    assert ask("select shop.o from (select 7 as o) shop") == [(7,)]
    assert ask("with t as (select * from (shop.o join (select 2 as k) x using (k))) select v, '__valid_from' from t") == [("{x}", "__valid_from")]
    assert ask("select count(*) from shop.o where k is distinct from 1 and v <> 'it''s shop.o'") == [(1,)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tm_")]


def test_inserts_look_up_only_their_keys(spark, db):
    db.create(TableConfig.of({"schema": "shop", "name": "u", "primary_keys": ["k"], "columns": [{"name": "k", "data_type": "INT"}, {"name": "v", "data_type": "INT", "unique_constraint": ["one"]}]}))
    add = lambda *rows: db.table_insert(spark.createDataFrame(list(rows), "k int, v int"), "shop", "u")
    assert add((1, 10), (2, None)) == 2 and add((3, None)) == 1
    for bad in ([(3, 30)], [(4, 10)], [(4, 40), (5, 40)]):
        with pytest.raises(ValueError, match="duplicate"):
            add(*bad)
    assert db.row_count("shop", "u") == 3 and db.table_insert(spark.createDataFrame([(3, 10)], "k int, v int"), "shop", "u", clear_table_first=True) == 1


def test_schemas(spark, db):
    db.create_schema("one")
    db.create_schema("one")
    db.create(TableConfig.of({**SIMPLE, "schema": "two"}))
    assert db.schemas() == ["one", "two"]


def test_all_column_types(spark, db):
    columns = [{"name": "id", "data_type": "INT"}, *({"name": n, "data_type": t, "default_value": v} for n, t, v in ALL_TYPES)]
    db.create(TableConfig.of({"schema": "s", "name": "all", "is_temporal": True, "primary_keys": ["id"], "columns": columns}))
    text = spark.createDataFrame([(1, *([None] * len(ALL_TYPES))), (2, *(v for _, _, v in ALL_TYPES))], ", ".join(["id int", *(f"{n} string" for n, _, _ in ALL_TYPES)]))
    assert db.table_insert(text, "s", "all", prefill_nulls_with_default=True, update_time=y(2000)) == 2
    one, two = (r[1:-2] for r in db.from_table("s", "all").orderBy("id").collect())
    assert one == two and None not in one
    assert (one[0], one[1], one[2], one[3], one[4], one[7], one[13], str(one[17])) == (2**63 - 1, 0, False, False, "?", Decimal("2.71"), Decimal("3.14159"), "01:20:00")
    # the same rows again change nothing; nulls without prefill overwrite
    assert tuple(db.table_upsert_temporal(text, "s", "all", Policy(True, prefill_nulls_with_default=True), y(2001))) == (0, 0, 2)
    assert tuple(db.table_upsert_temporal(text, "s", "all", Policy(True), y(2002))) == (0, 1, 1)
    assert set(db.from_table("s", "all").orderBy("id").first()[1:-2]) == {None}


# --- types and expressions


def test_types():
    for sql, kind in {"BIGINT": "bigint", "BIT": "int", "BOOLEAN": "boolean", "CHAR(1)": "string", "DATETIME": "timestamp", "DATE": "date", "REAL": "double", "FLOAT": "float", "INTEGER": "int", "TIMESTAMP": "timestamp", "TINYINT(DISPLAY_WIDTH=1)": "boolean", "TINYINT": "int", "MEDIUMINT": "bigint", "smallint": "int", "VARCHAR(LENGTH=5)": "string", "TEXT": "string", "NUMERIC(10,4)": "decimal(10,4)", "DEC(PRECISION=5, SCALE=2)": "decimal(5,2)", "TIME": "time(6)"}.items():
        assert spark_type(sql).simpleString() == kind
    for bad in ("BLOB", "DECIMAL", "DECIMAL(5)", "5"):
        with pytest.raises(ValueError):
            spark_type(bad)
    assert text_length("VARCHAR(LENGTH=5)") == 5 and text_length("CHAR") == 1 and text_length("TEXT") is None and text_length("INT") is None
    for k in (T.LongType(), T.DoubleType(), T.StringType(), T.DecimalType(9, 3), T.TimestampType(), T.BooleanType(), T.TimeType(6), T.DateType()):
        assert spark_type(sql_type(k)) == k


def test_casts(spark):
    df = spark.createDataFrame([("9007199254740993", "2015-4-01", "f", "x", "1.25")], "a string, b string, c string, d string, e string")
    r = df.select(cast(F.col("a"), T.LongType()), cast(F.col("b"), T.DateType()), cast(F.col("c"), T.BooleanType()), cast(F.col("d"), T.IntegerType()), cast(F.col("e"), T.DecimalType(9, 4)), literal("false", T.BooleanType())).first()
    assert tuple(r) == (9007199254740993, datetime(2015, 4, 1).date(), False, None, Decimal("1.2500"), False)


def test_transforms(spark):
    reg = transforms()
    df = spark.createDataFrame([(5, "2020-01-02", "a"), (1, "03.02.2020", None)], "n int, d string, w string")
    assert [r.n for r in reg.call_function("null_if_gte", df, "n", [5]).collect()] == [None, 1]
    assert [str(r.d) for r in reg.call_function("parse_date", df, "d", ["%Y-%m-%d", "%d.%m.%Y"]).collect()] == ["2020-01-02", "2020-02-03"]
    with pytest.raises(Exception, match="no format"):
        reg.call_function("parse_date", df, "d", ["%Y-%m-%d"]).collect()
    assert [r.x for r in reg.call_function("combine_columns", df, "x", ["${w}", "-", "${n}z"]).collect()] == ["a-5z", None]
    assert [r.w for r in reg.call_function("map_to_true", df, "w", ["a"]).collect()] == [True, False]
    with pytest.raises(ValueError):
        reg.register_function("map_to_true", lambda df, c, a: df)
    reg.register_function("nothing", lambda df, c, a: None)
    with pytest.raises(ValueError, match="nothing"):
        reg.call_function("nothing", df, "n", [])
    reg.delete_function("nothing")
    assert "nothing" not in reg.list_functions()
    with pytest.raises(ValueError):
        reg.call_function("nothing", df, "n", [])


def test_intervals(spark):
    t = datetime(2024, 5, 17, 13, 45, 30, 123456, tzinfo=timezone.utc)
    df = spark.createDataFrame([(t,), (None,)], "t timestamp")
    for i, want in {"1d": (2024, 5, 17), "1w": (2024, 5, 13), "1mo": (2024, 5, 1), "1q": (2024, 4, 1), "1y": (2024, 1, 1), "2h": (2024, 5, 17, 12), "15m": (2024, 5, 17, 13, 45), "500ms": (2024, 5, 17, 13, 45, 30)}.items():
        r = [x[0] for x in df.select(F.unix_micros(ingest.truncate(F.col("t"), i))).collect()]
        assert r == [int(datetime(*want, tzinfo=timezone.utc).timestamp() * 1e6), None], i
    up = df.select(*(F.date_format(ingest.offset(F.col("t"), i, s), "yyyy-MM-dd HH:mm:ss.SSSSSS") for i, s in (("1mo", 1), ("1q", -1), ("1d12h", 1), ("1w", -1), ("1ms", 1)))).first()
    assert tuple(up) == ("2024-06-17 13:45:30.123456", "2024-02-17 13:45:30.123456", "2024-05-19 01:45:30.123456", "2024-05-10 13:45:30.123456", "2024-05-17 13:45:30.124456")
    for bad in ("", "d", "1x", "1d mo"):
        with pytest.raises(ValueError):
            ingest.interval_parts(bad)


def test_dense_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(7)
    assert sorted((r.v, r.n) for r in dense_numbers(df, ["v"], "n", 5).collect()) == [(i, i + 5) for i in range(1000)]
    assert dense_numbers(df.limit(0), ["v"], "n").count() == 0


def test_surrogate_keys(spark):
    parent = spark.createDataFrame([(3, "a", None), (5, "b", None)], "id int, name string, note string")
    fields = [Field("id", "INT", False, autoincrement=True), Field("name", "VARCHAR(9)", False, "?"), Field("note", "VARCHAR(9)", True, "new")]
    rows = spark.createDataFrame([("a", 1), ("z", 2), ("c", 3), (None, 4), ("z", 5)], "name string, n int")
    out, added, top = deduce_keys(rows, parent, fields, {"name": "name"}, ("pid", "id"))
    assert {r.n: r.pid for r in out.collect()} == {1: 3, 2: 8, 3: 7, 4: 6, 5: 8}
    assert sorted(tuple(r) for r in added.collect()) == [(6, "?", "new"), (7, "c", "new"), (8, "z", "new")] and top == 8
    strict = [fields[0], Field("name", "VARCHAR(9)")]
    with pytest.raises(Exception, match="no parent"):
        deduce_keys(rows, parent.drop("note"), strict, {"name": "name"}, ("pid", "id"))[0].collect()


def test_compare_and_flatten(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, None, "z"), (4, None, None)], "id int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x", 0), (2, 2.5, "y", 0), (3, 1.0, "z", 0), (5, None, None, 0)], "id long, v double, s string, extra int")
    rows, missing = diff.compare_dataframes(a, b, ["id"])
    assert missing == ["missing:extra_lhs"] and rows.columns == ["id", "v_lhs", "v_rhs"]
    assert [tuple(r) for r in rows.collect()] == [(2, 2.0, 2.5), (3, None, 1.0)]
    with pytest.raises(ValueError):
        diff.compare_dataframes(a.select("id"), b.select("id"), ["id"])
    n = spark.createDataFrame([(1, [(1, ["p", "q"]), (2, None)], [10, 20]), (2, [], None)], "id int, x array<struct<a:int,b:array<string>>>, w array<int>")
    flat = diff.recursive_flatten(n)
    assert flat.columns == ["id", "x.a", "x.b", "w"]
    assert sorted((tuple(r) for r in flat.collect()), key=repr) == sorted([(1, 1, "p", 10), (1, 1, "q", 10), (1, 2, None, 20), (2, None, None, None)], key=repr)


# --- sources


COLUMNS = [IngestColumn("s", "t", "id", "id", ingestion_data_type="INT"), IngestColumn("s", "t", "v", "v", ingestion_data_type="DOUBLE"), IngestColumn("s", "t", "d", "d", ingestion_data_type="NUMERIC(5,2)"), IngestColumn("s", "t", "gone", "gone", ingestion_data_type="DATE")]


@pytest.mark.parametrize("as_bytes", [True, False])
def test_dsv(spark, tmp_path, as_bytes):
    text = 'id;v;d;junk;__keep; pad \n1;1.5;2.25;x;k;p\n2;None;;y;"a;\nb";p\n1;1.5;2.25;x;k;p\nbad;7;1;z;k;p\n'
    f = tmp_path / "a.csv"
    f.write_text(text)
    df = load_typed_dsv(spark, text.encode() if as_bytes else str(f), COLUMNS)
    assert df.columns == ["id", "v", "d", "__keep", delta.ORD, "gone"]
    rows = [tuple(r) for r in df.drop(delta.ORD).orderBy(df[delta.ORD]).collect()]
    assert rows == [(1, 1.5, Decimal("2.25"), "k", None), (2, None, None, "a;\nb", None), (None, 7.0, Decimal("1.00"), "k", None)]
    assert load_typed_dsv(spark, text.encode(), COLUMNS, null_values=["x"]).count() == 3


def test_several_and_split_files(spark, tmp_path, monkeypatch):
    cols = [IngestColumn("s", "t", "a", "a", ingestion_data_type="INT"), IngestColumn("s", "t", "b", "b")]
    (tmp_path / "1.csv").write_text("a,b\n1,x\n2,y\n1,x\n")
    (tmp_path / "2.csv").write_text('b;a\n"p\nq";3\nx;1\n')
    df = load_typed_dsv(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], cols, with_path="from")
    assert [(r.a, r.b, r["from"][-5]) for r in df.orderBy("__ord").collect()] == [(1, "x", "1"), (2, "y", "1"), (3, "p\nq", "2"), (1, "x", "2")]
    (tmp_path / "3.csv").write_text("a,b\n" + "".join(f'{i},"v ""{i}"", w"\n' for i in range(20_000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert not spans_lines(spark, str(tmp_path / "3.csv"))
        df = load_typed_dsv(spark, str(tmp_path / "3.csv"), cols)
        assert [(r.a, r.b) for r in df.orderBy("__ord").collect()] == [(i, f'v "{i}", w') for i in range(20_000)]
        (tmp_path / "4.csv").write_text("a,b\n" + "".join(f'{i},"{"z" * 50}\n{i}"\n' for i in range(3000)))
        assert spans_lines(spark, str(tmp_path / "4.csv")) and load_typed_dsv(spark, str(tmp_path / "4.csv"), cols).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("size", [1, 2, 10])
def test_files_in_batches_are_as_files_in_turn(spark, db, tmp_path, size):
    for n, rows in enumerate(["1,1.0,a\n2,2.0,b", "1,5.0,a", "2,2.0,b\n3,3.0,c", "1,1.0,a\n3,4.0,c"]):
        (tmp_path / f"2024010{n + 1}.csv").write_text(f"id,double_col,varchar_col\n{rows}\n")
    spec = {"root_path": str(tmp_path), "file_include": ["*.csv"], "timestamp": {"method": "regex", "datetime_regex": r".*/(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)"}}
    dataset = {**STREAM, "input_config": {"type": "dsv", "files_per_batch": size, "search_paths": [spec]}, "delta_config": {"on_duplicate_key": "take_last", "drop_unchanged_rows": True}}
    tables = TableConfigs([SIMPLE])
    run_datasets(EngineConfig(tables, (DatasetConfig.of(dataset),)), db, wait=0)
    day = lambda t: None if t.year == 2038 else t.day
    got = sorted((r.id, r.double_col, day(r[FROM]), day(r[TO])) for r in db.from_table("test", "simple", TimeSlice("all")).collect() if r[TO].year != 2038)
    live = sorted((r.id, r.double_col, r[FROM].day) for r in db.from_table("test", "simple").collect())
    assert got == [(1, 1.0, 1, 2), (1, 5.0, 2, 4), (3, 3.0, 3, 4)] and live == [(1, 1.0, 4), (2, 2.0, 1), (3, 4.0, 4)]
    assert db.row_count("test", "__audit_log") == 4 and db.log.latest() == 1 + -(-4 // size)
    with pytest.raises(ValueError):
        bad = {**dataset, "name": "other", "delta_config": {"on_duplicate_key": "take_last", "row_finality": "dropout"}, "input_config": {**dataset["input_config"], "files_per_batch": 2}}
        (tmp_path / "20240109.csv").write_text("id,double_col,varchar_col\n9,9.0,z\n")
        run_datasets(EngineConfig(tables, (DatasetConfig.of(bad),)), db, wait=0)


def test_sniff_and_payload():
    assert sniff("a|b") == ("|", ["a", "b"]) and sniff('"x;y",b') == (",", ["x;y", "b"]) and sniff("a", "|") == ("|", ["a"])
    with pytest.raises(ValueError):
        sniff("only")
    assert clean_payload('a,b\n 1 ," x,y "\n') == 'a,b\n1,"x,y"\n'


def test_find_files(spark, tmp_path):
    for d in ("one", "one/two", "one/two/three", "one/two/three/four", "skip"):
        (tmp_path / d).mkdir()
        for s in ("log", "bin", "txt"):
            (tmp_path / d / f"f.{s}").write_text("x")
    spec = {"root_path": str(tmp_path), "file_include": ["*.log", "*.bin"], "dir_exclude": ["skip"], "timestamp": {"method": "manual", "source_tz": "US/Pacific", "datetime": "2023-01-01T12:00:01"}}
    df = find_files(spark, [spec, spec, {**spec, "is_enabled": False, "root_path": "/"}])
    got = df.select("__path", F.unix_micros("__created_at").alias("t")).collect()
    assert len(got) == 6 and {r.t for r in got} == {int(datetime(2023, 1, 1, 20, 0, 1, tzinfo=timezone.utc).timestamp() * 1e6)}
    assert find_files(spark, [{**spec, "max_depth": 2}]).count() == 2 and find_files(spark, [{**spec, "dir_include": ["three"]}]).count() == 2
    assert find_files(spark, [{**spec, "root_path": f"file://{tmp_path}", "timestamp": {"method": "mtime"}}]).count() == 6
    assert file_time("/x/20240203_040506.csv", {"method": "regex", "datetime_regex": r".*/(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)_(?P<H>\d\d)(?P<M>\d\d)(?P<S>\d\d)", "source_tz": "Europe/London"}) == datetime(2024, 2, 3, 4, 5, 6, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        file_time("x", {"method": "guess"})


def test_zip_and_ipc(spark, tmp_path):
    schema = {"a": T.IntegerType(), "b": T.StringType()}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("1.csv", "a,b\n1,x\n")
        z.writestr("2.csv", 'a,b\n2,"y\ny"\n')
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    assert sorted(tuple(r) for r in read_zipfile(spark, str(tmp_path / "x.zip"), schema).collect()) == [(1, "x"), (2, "y\ny")]
    out = convert_zipped_csvs_to_parquet(spark, str(tmp_path), schema, True)
    assert not list(tmp_path.glob("*.zip")) and [spark.read.parquet(p).count() for p in out] == [0, 2]
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "i int, s string, d double")
    for c in (None, "lz4", "zstd", "zlib"):
        assert from_ipc_b64(spark, to_ipc_b64(df, c), c == "zlib").collect() == df.collect()
    with pytest.raises(ValueError):
        to_ipc_b64(df, "rar")


def test_a_table_too_large_for_a_message_is_not_collected(spark, monkeypatch):
    for df in (spark.range(10_000), spark.range(3000).selectExpr("id", "repeat('x', 20) s", "array(id, id) a", "if(id % 2 = 0, id, null) n"), spark.range(0)):
        size, table = arrow_size(df), df.toArrow()
        assert abs(size - table.nbytes) <= 0.02 * table.nbytes
        monkeypatch.setattr(ipc, "MOST", table.nbytes * 2)
        assert from_ipc_b64(spark, to_ipc_b64(df)).count() == df.count()
    df, collected = spark.range(10_000), []
    monkeypatch.setattr(ipc, "MOST", 60_000)
    monkeypatch.setattr(type(df), "toArrow", lambda self: collected.append(self))
    with pytest.raises(ValueError, match="no message"):
        to_ipc_b64(df)
    assert not collected


# --- pipelines


def usd(df, col, args):
    rates = F.create_map(*(F.lit(x) for p in ((2014, 2.0), (2015, 4.0)) for x in p))
    return df.withColumn(col, F.round(F.col(args[0]) / rates[F.col(args[1])].cast("decimal(10,4)"), 4).cast("decimal(10,4)"))


YAML = """
table_configs:
  - { name: unit_info, schema: test, primary_keys: [id], columns: [ { name: id, data_type: INT, nullable: false }, { name: name, data_type: VARCHAR(16) } ] }
  - name: prices
    schema: test
    is_temporal: true
    primary_keys: [product, um_id]
    foreign_keys: [ { name: um_id, references: { schema: test, table: unit_info, column: id } } ]
    columns:
      - { name: product, data_type: INT, nullable: false }
      - { name: um_id, data_type: INT, nullable: false }
      - { name: price, data_type: 'NUMERIC(10,4)' }
      - { name: usd, data_type: 'NUMERIC(10,4)' }
datasets:
  - name: food
    delta_table_schema: test
    scrape_limit: ~
    input_config:
      type: dsv
      search_paths: [ { root_path: data, file_include: ['*.csv'], timestamp: { method: regex, datetime_regex: '.*/(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})', source_tz: ${ZONE} } } ]
    time_partition: { column: time, bucket_interval: 1d, bucket_strategy: round_down, unique_strategy: last }
    delta_config: { drop_unchanged_rows: true, on_duplicate_key: take_last }
    pipeline:
      - { table: unit_info, schema: test, columns: [ { source: UmId, target: id }, { source: UmName, target: name } ] }
      - table: prices
        schema: test
        type: primary
        columns:
          - { source: Product, target: product }
          - { source: UmId, target: um_id }
          - { source: Price, target: price }
          - { source: Month, ingestion_data_type: VARCHAR(2) }
          - { source: Year, ingestion_data_type: INT }
          - { target: usd, transforms: { test_usd: ['Price', 'Year'] } }
          - { target: time, column_type: time_partition_only, target_data_type: DATETIME, transforms: { combine_columns: ['${Year}', '-', '${Month}', '-01'], apply_type_casts: [Utf8, Date] } }
"""


@pytest.fixture
def food(spark, db, tmp_path, monkeypatch):
    transforms().register_function("test_usd", usd, allow_overwrite=True)
    monkeypatch.setenv("ZONE", "UTC")
    for k in ("Year", "Month"):
        monkeypatch.delenv(k, raising=False)
    (tmp_path / "data").mkdir()
    (tmp_path / "food.yaml").write_text(YAML)
    (tmp_path / "data" / "2015-06-01.csv").write_text("Product,UmId,UmName,Month,Year,Price\n1,1,KG,12,2014,10\n1,1,KG,1,2015,12\n1,1,KG,2,2015,12\n1,1,KG,3,2015,14\n2,2,Lt,1,2015,8\n2,2,Lt,1,2015,9\n")
    return EngineConfig.from_yaml(str(tmp_path / "food.yaml")), tmp_path


def prices(db, s=TimeSlice("all")):
    rows = db.from_table("test", "prices", s).select("product", "price", "usd", F.date_format(FROM, "yyyy-MM").alias("f"), F.date_format(TO, "yyyy-MM").alias("t")).collect()
    return sorted((r.product, float(r.price), float(r.usd), r.f, r.t) for r in rows)


def test_pipeline(spark, db, food):
    config, folder = food
    got = []
    run_datasets(config, db, "food", capture=got, wait=0)
    assert len(got) == 1
    want = [(1, 10.0, 5.0, "2014-12", "2015-01"), (1, 12.0, 3.0, "2015-01", "2015-03"), (1, 14.0, 3.5, "2015-03", "2038-01"), (2, 9.0, 2.25, "2015-01", "2038-01")]
    assert prices(db) == want and {(r.id, r.name) for r in db.from_table("test", "unit_info").collect()} == {(1, "KG"), (2, "Lt")}
    log = AuditLog(db, "test")
    assert {(r.table_name, os.path.basename(r.data_source)) for r in log.rows().collect()} == {("prices", "2015-06-01.csv"), ("unit_info", "2015-06-01.csv")}
    run_datasets(config, db, "food", wait=0)  # nothing new
    assert prices(db) == want
    (folder / "data" / "2015-07-01.csv").write_text("Product,UmId,UmName,Month,Year,Price\n1,1,Kilo,6,2015,20\n")
    run_datasets(config, db, wait=0)
    assert (1, 20.0, 5.0, "2015-06", "2038-01") in prices(db) and "Kilo" in {r.name for r in db.from_table("test", "unit_info").collect()}
    seen_ = []
    tracker = UpdateTracker(lambda s, n, t: seen_.append((s, n, t.year, t.month)))
    ms = int(datetime(2015, 6, 15, tzinfo=timezone.utc).timestamp() * 1000)
    assert tracker.check(ms, ["test"], db) == 2 and tracker.check(ms, ["test"], db) == 0
    assert tracker.check(ms + 40 * 86_400_000, ["test"], db) == 2 and ("test", "prices", 2015, 7) in seen_
    assert log.purge_after_timestamp("prices", datetime(2015, 7, 1, tzinfo=timezone.utc), "open") == 0 and log.purge_after_timestamp("prices", datetime(2015, 7, 1, tzinfo=timezone.utc)) == 1
    assert log.purge("prices") == 1 and log.get_latest_entry(table_name="unit_info").count() == 1
    with pytest.raises(ValueError):
        run_datasets(config, db, "nope")


def test_failed_pipeline_changes_nothing(spark, db, food):
    config, folder = food
    (folder / "data" / "2015-07-01.csv").write_text("Product,UmId,UmName,Month,Year\n1,1,KG,6,2015\n")
    transforms().register_function("test_usd", lambda df, c, a: df.withColumn(c, F.raise_error(F.lit("boom")).cast("decimal(10,4)")), allow_overwrite=True)
    waits = []
    with pytest.raises(Exception, match="boom"):
        r = DatasetRunner(db, config.datasets[0], config.tables)
        db.create_all(config.tables)
        r.run(r.file_batches(), attempts=2, wait=0)
    assert db.row_count("test", "prices") == db.row_count("test", "unit_info") == AuditLog(db, "test").rows().count() == 0
    run_datasets(config, db, swallow_errors=True, attempts=1, wait=0)

    def never(tx):
        raise NonRetryable("no")

    with pytest.raises(NonRetryable):
        run_transaction(db, never, sleep=waits.append)
    n = []

    def second(tx):
        n.append(1)
        if len(n) == 1:
            raise OSError

    run_transaction(db, second, sleep=waits.append)
    assert waits == [60.0] and len(n) == 2


def test_payload_aggregation_and_missing(spark, db):
    tables = TableConfigs([{"schema": "s", "name": "t", "primary_keys": ["k"], "columns": [{"name": "k", "data_type": "VARCHAR(9)"}, {"name": "n", "data_type": "INT"}, {"name": "m", "data_type": "INT"}]}])
    d = DatasetConfig.of({"name": "d", "delta_table_schema": "s", "is_temporary_table": False, "input_config": {"type": "dsv"}, "delta_config": {"is_temporary_table": False}, "pipeline": [{"schema": "s", "table": "t", "type": "primary", "columns": [{"source": "k", "target": "k"}, {"source": "n", "target": "n", "aggregation": "max"}, {"source": "m", "target": "m", "value_if_missing": "7"}]}]})
    db.create_all(tables)
    r = DatasetRunner(db, d, tables)
    r.run(iter([r.payload_batch(" k , n ,m\na,1,\na,2,\nb,5,1\n", y(2020))]), wait=0)
    assert sorted(tuple(x) for x in db.from_table("s", "t").collect()) == [("a", 3, 7), ("b", 5, 1)]
    with pytest.raises(ValueError):
        DatasetConfig.of({"name": "d", "input_config": {"type": "nats-subject"}, "pipeline": []})


def test_late_data_state_is_kept(spark, db):
    e = spark.createDataFrame([(1, datetime(2024, 1, d, 5, tzinfo=timezone.utc)) for d in (1, 2, 3)], "k int, t timestamp")
    b = ingest.bucketed(e, "t", "1d", ["k"])
    kept, prev = ingest.drop_past(b, "t", "1d", "round_up", None)
    assert kept.count() == 1 and prev == datetime(2024, 1, 3, tzinfo=timezone.utc)
    kept, again = ingest.drop_past(b, "t", "1d", "round_up", datetime(2024, 2, 1, tzinfo=timezone.utc))
    assert kept.count() == 0 and again == datetime(2024, 2, 1, tzinfo=timezone.utc)


# --- streams


class Mail:
    def __init__(self, payload, n):
        self.data, self.time, self.state = json.dumps(payload).encode(), y(2020, n), []

    def ack(self):
        self.state.append("ack")

    def nak(self):
        self.state.append("nak")


class Queue:
    def __init__(self, *batches):
        self.batches = list(batches)

    def fetch(self, *a):
        b = self.batches.pop(0) if self.batches else []
        if b is None:
            raise StreamMissing
        return b


STREAM = {"name": "feed", "delta_table_schema": "test", "input_config": {"type": "nats-jetstream", "run_until": "empty", "payload_ingest": {"fn_name": "rows_reader"}, "jetstream": {"subscription": {"stream": "s", "subject": "x"}, "fetch": {"batch_size": 2}}}, "delta_config": {"on_duplicate_key": "take_last"}, "pipeline": [{"schema": "test", "table": "simple", "type": "primary", "columns": [{"source": c, "target": c} for c in ("id", "double_col", "varchar_col")]}]}


def test_messages(spark, db):
    readers().register_function("rows_reader", lambda p, t, a: spark.createDataFrame([(*r, p["name"], t) for r in p["rows"]], "id int, double_col double, varchar_col string, __path string, __created_at timestamp"), allow_overwrite=True)
    one, two = Mail({"name": "m1", "rows": [[1, 1.0, "a"]]}, 1), Mail({"name": "m2", "rows": [[2, 2.0, "b"]], "fn_loader_name": "rows_reader"}, 2)
    waits = []
    tables = TableConfigs([SIMPLE])
    db.create_all(tables)
    r = DatasetRunner(db, DatasetConfig.of(STREAM), tables)
    r.run(message_batches(r, Queue(None, None, [one, two]), waits.append), wait=0)
    assert waits == [5.0, 10.0] and one.state == two.state == ["ack"]
    assert seen(db.from_table("test", "simple")) == [(1, 1.0, 2020), (2, 2.0, 2020)]
    again, new = Mail({"name": "m1", "rows": [[1, 99.0, "x"]]}, 3), Mail({"name": "m3", "rows": [[1, 5.0, "a"]]}, 4)
    run_datasets(EngineConfig(tables, (r.dataset,)), db, client=Queue([again, new]), wait=0)
    assert {x[:2] for x in seen(db.from_table("test", "simple"))} == {(1, 5.0), (2, 2.0)} and again.state == ["ack"]
    bad = Mail({"name": "m4", "rows": [["x", 5.0, "a"]]}, 5)
    with pytest.raises(Exception):
        run_datasets(EngineConfig(tables, (r.dataset,)), db, client=Queue([bad]), attempts=1, wait=0)
    with pytest.raises(ValueError):
        run_datasets(EngineConfig(tables, (r.dataset,)), db)


@pytest.mark.parametrize("value", [True, False])
def test_truncate_table_first_is_refused(value):
    with pytest.raises(TypeError, match="truncate_table_first"):
        DatasetConfig.of({**STREAM, "delta_config": {"truncate_table_first": value}})


@pytest.mark.parametrize("limit", [1, 3, 4, 100])
def test_limited_messages_lose_nothing(spark, db, limit):
    readers().register_function("rows_reader", lambda p, t, a: spark.createDataFrame([(*r, p["name"], t) for r in p["rows"]], "id int, double_col double, varchar_col string, __path string, __created_at timestamp"), allow_overwrite=True)
    mails = [Mail({"name": f"m{i}", "rows": [[10 * i + k, float(i), "a"] for k in range(2)]}, i) for i in (3, 1, 2)]

    class Again:
        def fetch(self, *a):
            return [m for m in mails if m.state[-1:] != ["ack"]]

    tables = TableConfigs([SIMPLE])
    db.create_all(tables)
    r = DatasetRunner(db, DatasetConfig.of({**STREAM, "scrape_limit": limit}), tables)
    assert r.run(message_batches(r, Again()), wait=0) == {1: 3, 3: 3, 4: 2, 100: 1}[limit]
    assert [x[:2] for x in seen(db.from_table("test", "simple"))] == [(10 * i + k, float(i)) for i in (1, 2, 3) for k in range(2)]
    assert sorted(x["data_source"] for x in r.audit.rows().collect()) == ["m1", "m2", "m3"]
    naks = {m.time: m.state.count("nak") for m in mails}
    assert [naks[t] for t in sorted(naks)] == {1: [0, 1, 2], 3: [0, 1, 2], 4: [0, 0, 1], 100: [0, 0, 0]}[limit]


def test_runs_leave_nothing_staged(spark, db, tmp_path):
    import glob

    from tidemark.session import shared_dir

    staged = lambda: set(glob.glob(shared_dir(spark).removeprefix("file://") + "/tidemark/*"))
    tables = TableConfigs([{**SIMPLE, "is_temporal": False}])
    db.create_all(tables)
    r = DatasetRunner(db, DatasetConfig.of({**STREAM, "name": "clean"}), tables)
    src = str(tmp_path / "in")
    simple(spark, [(1, 1.0), (2, 2.0)]).write.parquet(src)
    before = staged()
    start_stream(r, spark.readStream.schema("id int, double_col double, varchar_col string").parquet(src), str(tmp_path / "cp")).awaitTermination(120)
    r.run(iter([r.payload_batch("id,double_col,varchar_col\n3,3.0,x\n", y(2020))]), wait=0)
    assert db.row_count("test", "simple") == 3 and staged() - before <= {db.root.removeprefix("file://")}


class Returns:
    """Messages come again until they are acknowledged."""

    def __init__(self, *mails):
        self.mails = list(mails)

    def fetch(self, *a):
        return [m for m in self.mails if m.state[-1:] != ["ack"]]


@pytest.mark.parametrize("how", ["load", "reject"])
def test_late_messages_are_not_lost(spark, db, how):
    readers().register_function("rows_reader", lambda p, t, a: spark.createDataFrame([(*r, p["name"], t) for r in p["rows"]], "id int, double_col double, varchar_col string, __path string, __created_at timestamp"), allow_overwrite=True)
    tables = TableConfigs([{**SIMPLE, "is_temporal": False}])
    db.create_all(tables)
    r = DatasetRunner(db, DatasetConfig.of({**STREAM, "input_config": {**STREAM["input_config"], "late_messages": how}}), tables)
    mail = lambda name, day, *rows: Mail({"name": name, "rows": [list(x) for x in rows]}, day)
    five = mail("a", 5, (1, 5.0, "x"))
    r.run(message_batches(r, Returns(five)), wait=0)
    # two older than what was loaded, and one that is there
    three, four, again = mail("b", 3, (2, 3.0, "y")), mail("d", 4, (3, 4.0, None)), mail("a", 5, (1, 99.0, "z"))
    six = mail("c", 6, (4, 6.0, "w"))
    r.run(message_batches(r, Returns(three, four, again, six)), wait=0)
    assert all(m.state == ["ack"] for m in (five, three, four, again, six))
    got = {x.id: x.double_col for x in db.from_table("test", "simple").collect()}
    assert got == ({1: 5.0, 2: 3.0, 3: 4.0, 4: 6.0} if how == "load" else {1: 5.0, 4: 6.0})
    assert r.audit.rows().count() == 4  # also of the rejected ones: they don't come again
    assert db.table_exists("test", "feed__late") == (how == "reject")
    if how == "reject":
        late = [(x.path, json.loads(x.row)) for x in db.from_table("test", "feed__late").orderBy("path").collect()]
        assert late == [("b", {"id": 2, "double_col": 3.0, "varchar_col": "y"}), ("d", {"id": 3, "double_col": 4.0})]
    with pytest.raises(ValueError):
        DatasetConfig.of({**STREAM, "input_config": {**STREAM["input_config"], "late_messages": "drop"}})


def test_jetstream_client(spark, db):
    import asyncio
    import threading
    from types import SimpleNamespace

    class Gone(Exception):
        pass

    log = []

    class Server:
        """Stands in for a context: the stream appears at the second attempt, holds two messages, then times out."""

        tries = 0
        left = [(b"1", y(2020)), (b"2", y(2021))]

        async def pull_subscribe(self, **a):
            self.tries += 1
            if self.tries == 1:
                raise Gone
            log.append(a)
            return self

        async def fetch(self, n, timeout):
            if not self.left:
                raise asyncio.TimeoutError
            out, self.left = self.left[:n], self.left[n:]

            def message(data, t):
                async def said(what):
                    log.append((data, what))

                return SimpleNamespace(data=data, metadata=SimpleNamespace(timestamp=t), ack=lambda: said("ack"), nak=lambda: said("nak"))

            return [message(*m) for m in out]

    loop = asyncio.new_event_loop()
    threading.Thread(target=loop.run_forever, daemon=True).start()
    c = JetStreamClient(Server(), loop, consumer_config=lambda **k: k, not_found=Gone)
    c.configure({"options": {"pending_bytes_limit": 9}, "consumer_args": {"max_ack_pending": 5}})
    with pytest.raises(StreamMissing):
        c.fetch("s", "x", "d", 1, 0.1)
    first, = c.fetch("s", "x", "d", 1, 0.1)
    second, = c.fetch("s", "x", "d", 1, 0.1)
    first.ack(), second.nak()
    assert c.fetch("s", "x", "d", 1, 0.1) == [] and (second.data, second.time) == (b"2", y(2021))
    assert log == [{"subject": "x", "durable": "d", "stream": "s", "config": {"max_ack_pending": 5}, "pending_bytes_limit": 9}, (b"1", "ack"), (b"2", "nak")]
    loop.call_soon_threadsafe(loop.stop)


def test_structured_stream(spark, db, tmp_path):
    tables = TableConfigs([{**SIMPLE, "is_temporal": False}])
    db.create_all(tables)
    r = DatasetRunner(db, DatasetConfig.of(STREAM), tables)
    src = str(tmp_path / "in")
    simple(spark, [(1, 1.0), (2, 2.0)]).write.parquet(src)
    for rows in ([], [(2, 5.0), (3, 3.0)]):
        if rows:
            simple(spark, rows).write.mode("append").parquet(src)
        q = start_stream(r, spark.readStream.schema("id int, double_col double, varchar_col string").parquet(src), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert {x.id: x.double_col for x in db.from_table("test", "simple").collect()} == {1: 1.0, 2: 5.0, 3: 3.0}
    assert db.log.read()["streams"] == {"feed": 1}


def test_decode_json(spark):
    df = spark.createDataFrame([(1, '{"a": 5}'), (2, "{"), (3, None), (4, '{"a": "x"}')], "a int, data string").withColumn("n", F.lit(1))
    got = decode_json(df, "a int, b string").collect()
    assert [(r.a, r.b, r["__bad"]) for r in got] == [(5, None, False), (None, None, True), (None, None, False), (None, None, True)]


class Numbers:
    def read(self, start, end):
        return [(n, y(2020), str(n)) for n in range(start, min(end, 5))]


def numbers(options):
    return Numbers()


def test_message_source_reads_ranges():
    s = MessageDataSource({"client": "tests.test_engine:numbers", "batch_size": "3"}).simpleStreamReader(None)
    rows, end = s.read(s.initialOffset())
    assert [r[0] for r in rows] == [0, 1, 2] and end == {"sequence": 3}
    assert [r[2] for r in s.readBetweenOffsets(end, {"sequence": 9})] == ["3", "4"]
    assert s.read({"sequence": 5})[1] == {"sequence": 5}


# --- helpers


def test_helpers(tmp_path, monkeypatch):
    c = Clock()
    for t in (9, 1, 2, 3, 4, 5):
        c.add_timing("a", t)
    assert c.get_avg("a") == 3 and c.get_avg("b") == 0 and c.eta("a", 2, 1) == timedelta(seconds=10) and Clock.shared() is Clock.shared()
    monkeypatch.setenv("WHO", "me")
    (tmp_path / "a.yaml").write_text("a: { b: [ '${WHO}' ] }")
    assert nested(load_yaml(str(tmp_path / "a.yaml")), "a.b") == ["me"]
    assert strip_outer_quotes("'a'") == "a" and strip_outer_quotes("'a") == "'a" and is_text_type("VARCHAR(3)") and not is_text_type("INT")
    assert as_sql_date(y(2020)) == "2020-01-01" and as_sql_datetime(y(2020)).startswith("2020-01-01 00:00:01") and flatten_list([1, [2, [3]], (4,)]) == [1, 2, 3, 4]
    assert io and SENTINEL.year == 2038


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tidemark.session import DISPLAY, shared_dir, show_whole

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(unset)
    unset.conf.get = lambda *a: "hdfs:///shared/"
    assert shared_dir(unset) == "hdfs:///shared"
    was = {k: spark.conf.get(k) for k in DISPLAY}
    show_whole(spark)
    assert {k: spark.conf.get(k) for k in DISPLAY} == DISPLAY
    for k, v in was.items():
        spark.conf.set(k, v)


def test_dead_rows_and_small_folders_are_tidied(spark, db, monkeypatch):
    monkeypatch.setattr("tidemark.store.tables.FOLDERS", 3)
    db.create(TableConfig.of(SIMPLE))
    p = Policy(True, "take_last")
    db.table_upsert_temporal(simple(spark, [(i, 0.0) for i in range(10)]), "test", "simple", p, y(2000))
    for n in range(1, 5):
        db.table_upsert_temporal(simple(spark, [(n, float(n))]), "test", "simple", p, y(2000 + n))
        e = db.begin()._entry("test.simple")
        # under a third of dead rows they are only marked; the third folder of a level makes one of the next
        assert (e["rows"], e["dead"], len(e["dvs"]), len(e["current"])) == {1: (10, 1, 1, 2), 2: (10, 2, 2, 1), 3: (10, 3, 3, 2), 4: (10, 0, 0, 1)}[n]
    want = sorted([(0, 0.0, 2000), *((i, 0.0, 2000) for i in range(5, 10)), *((n, float(n), 2000 + n) for n in range(1, 5))], key=repr)
    assert seen(db.from_table("test", "simple")) == want
    assert len(db.begin()._entry("test.simple")["history"]) == 2
    assert seen(db.from_table("test", "simple", TimeSlice("all"))) == sorted(want + [(n, 0.0, 2000, 2000 + n) for n in range(1, 5)], key=repr)
    tx = db.begin()
    tx.compact("test.simple")
    tx.commit()
    e = db.begin()._entry("test.simple")
    assert (len(e["current"]), len(e["history"]), e["dvs"], e["rows"]) == (1, 1, {}, 10)
    assert seen(db.from_table("test", "simple")) == want and db.row_count("test", "simple") == 10
