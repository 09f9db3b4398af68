"""Queries of the engine as a whole: catalog, configuration, payloads, messages, archives, retries and trackers, each
with the SQL that must give the same rows."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config.model import DatasetConfig, EngineConfig, IngestColumn, TableConfig, TableConfigs
from tidemark.functions.registry import readers, transforms
from tidemark.operators import delta
from tidemark.operators.temporal import is_temporal
from tidemark.plans.pipeline import DatasetRunner, apply_transformations, run_datasets, run_transaction
from tidemark.plans.reference import utc
from tidemark.plans.tables import table
from tidemark.session import jpath, scratch
from tidemark.sources.files import find_files
from tidemark.sources.ipc import from_ipc_b64, to_ipc_b64
from tidemark.sources.ziptools import convert_zipped_csvs_to_parquet, read_zipfile
from tidemark.store.log import CommitConflict
from tidemark.store.tables import Database
from tidemark.streaming.tracker import UpdateTracker
from tidemark.types import cast_columns
from tidemark.utils import Clock, as_sql_date, as_sql_datetime, flatten_list, is_text_type, strip_outer_quotes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _database(spark: SparkSession) -> Database:
    return Database(spark, scratch(spark, "db"))


CUSTOMER = {"schema": "shop", "name": "customer", "primary_keys": ["c_custkey"], "columns": [{"name": "c_custkey", "data_type": "BIGINT"}, {"name": "c_name", "data_type": "VARCHAR(64)"}, {"name": "c_nationkey", "data_type": "INT"}]}
NATION = {"schema": "shop", "name": "nation", "primary_keys": ["n_nationkey"], "columns": [{"name": "n_nationkey", "data_type": "INT"}, {"name": "n_name", "data_type": "VARCHAR(25)"}]}
LINKED = {**CUSTOMER, "foreign_keys": [{"name": "c_nationkey", "references": {"schema": "shop", "table": "nation", "column": "n_nationkey"}}]}
_C = "select c_custkey, c_name, c_nationkey from customer"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")


# --- catalog and tables


@query(f"{_C}")
def table_create_from_frame(spark, d):
    """The columns' types are those of the frame."""
    db, c = _database(spark), _customers(spark, d)
    db.table_create("shop", "copy", c, ["c_custkey"])
    db.table_insert(c, "shop", "copy")
    return db.from_table("shop", "copy")


@query("select (select count(*) from customer) as n, true before, false as after, 'c_custkey' keys, 'c_custkey,c_nationkey' both_have, true has, false lacks, false temporal, 'nation,customer' as ordered, 'shop' as schemas_")
def catalog_facts(spark, d):
    db, configs = _database(spark), TableConfigs([LINKED, NATION])
    db.create_schema("shop")
    db.create_all(configs)
    db.table_insert(table(spark, d, "nation").select("n_nationkey", "n_name"), "shop", "nation")
    db.table_insert(_customers(spark, d), "shop", "customer")
    n, before = db.row_count("shop", "customer"), db.table_exists("shop", "customer")
    both = ",".join(db.column_intersection("shop", "customer", ["c_nationkey", "x", "c_custkey"]))
    has, lacks = db.has_all_columns("shop", "customer", ["c_name"]), db.has_all_columns("shop", "customer", ["c_name", "x"])
    temporal = is_temporal(db.from_table("shop", "customer")) or db.is_temporal("shop", "customer")
    keys, ordered = ",".join(db.primary_keys("shop", "customer")), ",".join(t.name for t in configs.ordered())
    db.drop_all(configs)
    row = (n, before, db.table_exists("shop", "customer"), keys, both, has, lacks, temporal, ordered, ",".join(db.schemas()))
    return spark.createDataFrame([row], "n bigint, before boolean, after boolean, keys string, both_have string, has boolean, lacks boolean, temporal boolean, ordered string, schemas_ string")


@query("select unnest(['duplicate', 'no row', 'nulls', 'too long', 'types differ', 'null']) refused")
def constraints_refuse(spark, d):
    """What each of a set of bad uploads of all customers is refused for; none changes the table."""
    db, c = _database(spark), _customers(spark, d)
    db.create_all(TableConfigs([{**LINKED, "columns": [*CUSTOMER["columns"][:2], {**CUSTOMER["columns"][2], "nullable": False}]}, NATION]))
    db.table_insert(table(spark, d, "nation").select("n_nationkey", "n_name"), "shop", "nation")
    bad = {
        "duplicate": c.unionByName(c),
        "no row": c.withColumn("c_nationkey", F.col("c_nationkey") + 1000),
        "nulls": c.withColumn("c_nationkey", F.lit(None).cast("int")),
        "too long": c.withColumn("c_name", F.repeat("c_name", 9)),
    }
    refused = []
    for what, rows in bad.items():
        try:
            db.table_insert(rows, "shop", "customer")
        except ValueError as e:
            refused.append(what if what in str(e) else str(e))
    try:
        delta.check_types(c.schema, TableConfig.of(NATION).fields, {"c_custkey": "n_nationkey"}, TableConfig.of(NATION).kinds)
    except ValueError as e:
        refused.append("types differ" if "types differ" in str(e) else str(e))
    refused.append("null" if db.row_count("shop", "customer") == 0 else "changed")
    return spark.createDataFrame([(x,) for x in refused], "refused string")


@query("select c_custkey::varchar c_custkey, c_name, c_nationkey::bigint c_nationkey from customer")
def selectable_overrides(spark, d):
    return _database(spark).from_selectable(_customers(spark, d), {"c_custkey": T.StringType(), "c_nationkey": T.LongType()})


@query("select c_custkey, 'shop.customer' label from customer where c_name <> 'shop.customer'")
def raw_sql_literals(spark, d):
    """A table's name stands in a literal, a comment and before a column as well."""
    db = _database(spark)
    db.create(TableConfig.of(CUSTOMER))
    db.table_insert(_customers(spark, d), "shop", "customer")
    return db.from_raw_sql("select shop.customer.c_custkey, 'shop.customer' label /* from shop.customer */ from shop.customer where c_name <> 'shop.customer' -- shop.customer")


@query("select 'UTC' \"spark.sql.session.timeZone\"")
def server_variables(spark, d):
    return _database(spark).variables("spark.sql.session.time%")


@query("select c_custkey, c_name from customer where c_nationkey <> 7")
def null_keys_left_out(spark, d):
    c = _customers(spark, d).select(F.when(F.col("c_nationkey") != 7, F.col("c_custkey")).alias("c_custkey"), "c_name")
    return delta.insert_new(c.limit(0), c, ["c_custkey"])


# --- transactions


@query(f"{_C}")
def transaction_retry(spark, d):
    """The first attempt fails after it has written, the second one meets another writer; the third is the only one seen."""
    db, tries = _database(spark), []
    db.create_all(TableConfigs([CUSTOMER, NATION]))

    def work(tx):
        tries.append(tx.base)
        tx.put("shop.customer", append=_customers(spark, d), grown=1)
        if len(tries) == 1:
            raise OSError("lost")
        if len(tries) == 2:
            db.table_insert(table(spark, d, "nation").select("n_nationkey", "n_name"), "shop", "nation")

    run_transaction(db, work, wait=0)
    if len(tries) != 3:
        raise CommitConflict(f"{len(tries)} attempts")
    return db.from_table("shop", "customer")


# --- configuration


DATASET = {
    "name": "feed",
    "input_config": {"type": "dsv"},
    "pipeline": [
        {"schema": "shop", "table": "nation", "columns": [{"source": "nation", "target": "n_name"}, {"target": "n_nationkey", "column_type": "computed", "deduce_foreign_key": True}]},
        {"schema": "shop", "table": "customer", "type": "primary", "columns": [{"source": "key", "target": "c_custkey", "ingestion_data_type": "VARCHAR(32)"}, {"source": "name", "target": "c_name"}, {"source": "note", "ingestion_data_type": "DATE"}, {"target": "c_nationkey", "column_type": "computed", "transforms": {"combine_columns": ["1"]}}]},
    ],
}


@query(
    """select unnest(['nation', 'n_nationkey', 'key', 'name', 'note', 'c_nationkey']) as name, unnest(['VARCHAR(25)', 'INT', 'VARCHAR(32)', 'VARCHAR(64)', 'DATE', 'INT']) ingestion,
  unnest(['VARCHAR(25)', 'INT', 'BIGINT', 'VARCHAR(64)', 'DATE', 'INT']) target, unnest(['data', 'computed', 'data', 'data', 'dsv_only', 'computed']) kind, unnest([true, true, true, true, false, true]) in_delta"""
)
def resolved_columns(spark, d):
    tables, pipeline = TableConfigs([LINKED, NATION]), DatasetConfig.of(DATASET).pipeline
    staged = {c.name for c in pipeline.delta_columns(tables)}
    return spark.createDataFrame([(c.name, c.ingestion_data_type, c.target_data_type, c.column_type, c.name in staged) for c in pipeline.resolved(tables)], "name string, ingestion string, target string, kind string, in_delta boolean")


@query("select p_brand, coalesce(nullif(p_type, 'SMALL'), '?') p_type, sum(p_size)::bigint p_size, sum(p_size * 2)::bigint twice from part group by all")
def pipeline_post_steps(spark, d):
    """Own transform, then columns without target go, sums are made, missing values filled and types set."""
    transforms().register_function("twice", lambda df, name, args: df.withColumn(name, F.col(args[0]) * 2), allow_overwrite=True)
    columns = [
        IngestColumn("s", "t", "p_partkey", column_type="dsv_only", target_data_type="BIGINT"),
        IngestColumn("s", "t", "p_brand", "p_brand", target_data_type="VARCHAR(16)"),
        IngestColumn("s", "t", "p_type", "p_type", target_data_type="VARCHAR(32)", value_if_missing="?"),
        IngestColumn("s", "t", "p_size", "p_size", target_data_type="BIGINT", aggregation="sum"),
        IngestColumn("s", "t", None, "twice", column_type="computed", target_data_type="BIGINT", transforms={"twice": ["p_size"]}, aggregation="sum"),
    ]
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.expr("nullif(p_type, 'SMALL')").alias("p_type"), F.col("p_size").cast("bigint").alias("p_size"))
    return apply_transformations(p, columns).select("p_brand", "p_type", "p_size", "twice")


@query("select o_orderkey, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def transform_with_lookup(spark, d):
    """A registered transform that joins other tables to the delta."""

    def nation_of(df: DataFrame, name: str, args: list) -> DataFrame:
        c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return df.join(c.select(F.col("c_custkey").alias(args[0]), F.col("n_name").alias(name)), args[0], "left")

    transforms().register_function("nation_of", nation_of, allow_overwrite=True)
    columns = [IngestColumn("s", "t", c, c, target_data_type="BIGINT") for c in ("o_orderkey", "o_custkey")] + [IngestColumn("s", "t", None, "n_name", column_type="computed", target_data_type="VARCHAR(32)", transforms={"nation_of": ["o_custkey"]})]
    return apply_transformations(table(spark, d, "orders").select("o_orderkey", "o_custkey"), columns).select("o_orderkey", "n_name")


# --- sources


@query("select unnest(['customer.parquet', 'nation.parquet', 'orders.parquet', 'part.parquet', 'region.parquet', 'supplier.parquet']) file, 1704110401000000 created_at")
def crawl_files(spark, d):
    """Files of a folder by pattern, their time given in another zone."""
    spec = {"root_path": d, "file_include": ["[cos]*er*.parquet", "nation.parquet", "part.parquet", "region.parquet"], "file_exclude": ["*_*", "documents*"], "max_depth": 1, "timestamp": {"method": "manual", "source_tz": "US/Pacific", "datetime": "2024-01-01T04:00:01"}}
    listed = {**spec, "max_depth": 2}
    names = F.regexp_extract("__path", "([a-z_0-9]+\\.parquet)", 1)
    return find_files(spark, [spec, listed]).select(names.alias("file"), F.unix_micros("__created_at").alias("created_at")).distinct()


def _texts(df: DataFrame, name: str) -> Iterator[bytes]:
    """The part files of df as delimited text."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.csv(path, header=True, escape='"')
    fs, p = jpath(spark, path)
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
        if s.getPath().getName().endswith(".csv") and s.getLen():
            stream = fs.open(s.getPath())
            try:
                yield bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def zip_scan(spark, d):
    """All orders as an archive of several delimited files."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return read_zipfile(spark, f"{_zipped(o)}/0.zip", o.schema)


def _zipped(df: DataFrame, archives: int = 1) -> str:
    """A folder with df as archives of several delimited files each."""
    spark, folder = df.sparkSession, scratch(df.sparkSession, "zips")
    texts = list(_texts(df.repartition(4), "parts"))
    for n in range(archives):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for i, text in enumerate(texts[n::archives]):
                z.writestr(f"{i}.csv", text)
        fs, p = jpath(spark, f"{folder}/{n}.zip")
        out = fs.create(p, True)
        out.write(data.getvalue())
        out.close()
    return folder


@query("select c_custkey, c_name, c_acctbal, true zips_gone from customer")
def zips_to_parquet(spark, d):
    """A folder of archives, each made a Parquet folder in place of it."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    folder = _zipped(c, 2)
    made = convert_zipped_csvs_to_parquet(spark, folder, c.schema, remove_original=True)
    fs, p = jpath(spark, folder)
    gone = not any(x.getPath().getName().endswith(".zip") for x in fs.listStatus(p))
    return spark.read.parquet(*made).withColumn("zips_gone", F.lit(gone))


@query("select c_custkey, c_name, c_acctbal from customer")
def ipc_roundtrip(spark, d):
    return from_ipc_b64(spark, to_ipc_b64(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "zlib"), True)


@query(f"{_C}")
def payload_load(spark, d):
    """Customers as delimited text given directly."""
    tables = TableConfigs([CUSTOMER])
    dataset = DatasetConfig.of({**DATASET, "delta_table_schema": "shop", "delta_config": {"on_duplicate_key": "take_last"}, "pipeline": [{"schema": "shop", "table": "customer", "type": "primary", "columns": [{"source": s, "target": s} for s in ("c_custkey", "c_name", "c_nationkey")]}]})
    db = _database(spark)
    db.create_all(tables)
    runner = DatasetRunner(db, dataset, tables)
    runner.run(runner.payload_batch(t.decode(), utc(2024, 1, 1)) for t in _texts(_customers(spark, d), "payload"))
    return db.from_table("shop", "customer")


MESSAGES = {
    "name": "customers",
    "delta_table_schema": "shop",
    "input_config": {"type": "nats-jetstream", "run_until": "empty", "payload_ingest": {"fn_name": "customer_rows"}, "jetstream": {"subscription": {"stream": "s", "subject": "x"}, "fetch": {"batch_size": 10}}},
    "delta_config": {"on_duplicate_key": "take_last"},
    "pipeline": [{"schema": "shop", "table": "customer", "type": "primary", "columns": [{"source": s, "target": s} for s in ("c_custkey", "c_name", "c_nationkey")]}],
}


class _Message:
    def __init__(self, nation: int, rows: list):
        self.data, self.time, self.said = json.dumps({"nation": nation, "rows": rows}).encode(), utc(2024, 1, 1) + timedelta(days=nation), []

    def ack(self) -> None:
        self.said.append("ack")

    def nak(self) -> None:
        self.said.append("nak")


class _Again:
    """A client whose messages come again, newest first, until they are acknowledged."""

    def __init__(self, messages: list[_Message]):
        self.messages = messages

    def fetch(self, stream, subject, durable, batch_size, timeout) -> list[_Message]:
        return [m for m in reversed(self.messages) if m.said[-1:] != ["ack"]][:batch_size]


def _loaded(spark: SparkSession, d: str, **how) -> tuple[Database, list[_Message]]:
    """The customers through a stream of one message for each nation, the later ones first."""

    def rows_of(payload: dict, time: datetime, args: dict) -> DataFrame:
        rows = [(*r, f"nation-{payload['nation']}", time) for r in payload["rows"]]
        return spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, __path string, __created_at timestamp")

    readers().register_function("customer_rows", rows_of, allow_overwrite=True)
    by = _customers(spark, d).groupBy("c_nationkey").agg(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey")).alias("rows")).collect()
    messages = [_Message(r.c_nationkey, [list(x) for x in r.rows]) for r in sorted(by)]
    db, tables = _database(spark), TableConfigs([CUSTOMER])
    dataset = DatasetConfig.of({**MESSAGES, **{k: v for k, v in how.items() if k != "input"}, "input_config": {**MESSAGES["input_config"], **how.get("input", {})}})
    run_datasets(EngineConfig(tables, (dataset,)), db, client=_Again(messages), wait=0)
    return db, messages


@query(f"{_C}")
def messages_load(spark, d):
    """Messages older than those loaded before them are loaded too."""
    return _loaded(spark, d)[0].from_table("shop", "customer")


@query(f"{_C}")
def messages_limited(spark, d):
    """A limit of rows for each fetch; what is beyond it comes again."""
    return _loaded(spark, d, scrape_limit=700)[0].from_table("shop", "customer")


@query("select 'nation-' || c_nationkey path, count(*) n from customer where c_nationkey < (select max(c_nationkey) - 9 from customer) group by all")
def messages_late(spark, d):
    """Messages older than what was loaded, as rows of the reject table."""
    return _loaded(spark, d, input={"late_messages": "reject"})[0].from_table("shop", "customers__late").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct 'nation-' || c_nationkey data_source, 'customer' table_name, true acknowledged from customer")
def messages_audited(spark, d):
    db, messages = _loaded(spark, d)
    acknowledged = all(m.said == ["ack"] for m in messages)
    return db.from_table("shop", "__audit_log").select("data_source", "table_name", F.lit(acknowledged).alias("acknowledged"))


@query("select 'shop' as schema_, 'customer' table_name, epoch_us(timestamp '2024-01-01') + max(c_nationkey)::bigint * 86400000000 newest, 1 calls, 0 again from customer")
def tracked_updates(spark, d):
    """What a tracker calls back for, and that it does so once."""
    db, seen = _loaded(spark, d)[0], []
    tracker = UpdateTracker(lambda *a: seen.append(a))
    asof = int(utc(2030, 1, 1).timestamp() * 1000)
    calls, again = tracker.check(asof, ["shop"], db), tracker.check(asof, ["shop"], db)
    rows = [(s, t, int(x.timestamp()) * 1_000_000, calls, again) for s, t, x in seen]
    return spark.createDataFrame(rows, "schema_ string, table_name string, newest bigint, calls int, again int")


@query(f"{_C} where c_nationkey < 16")
def files_limited(spark, d):
    """Files by the times in their paths, of which a run takes the first two."""
    day = F.when(F.col("c_nationkey") < 8, "20240101").when(F.col("c_nationkey") < 16, "20240102").otherwise("20240103")
    folder = scratch(spark, "days")
    _customers(spark, d).withColumn("day", day).repartition("day").write.partitionBy("day").csv(folder, header=True)
    spec = {"root_path": folder, "file_include": ["*.csv"], "dir_include": ["day=*"], "timestamp": {"method": "regex", "datetime_regex": r".*/day=(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)/"}}
    tables = TableConfigs([CUSTOMER])
    dataset = DatasetConfig.of({**MESSAGES, "input_config": {"type": "dsv", "search_paths": [spec]}, "scrape_limit": 2})
    db = _database(spark)
    run_datasets(EngineConfig(tables, (dataset,)), db, wait=0)
    return db.from_table("shop", "customer")


@query("select o_orderkey, o_orderdate::date d, epoch_us(date_trunc('second', o_orderdate)) t from orders")
def inferred_dates(spark, d):
    """Dates and times as texts of several forms, without a pattern given."""
    day = F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    texts = table(spark, d, "orders").select("o_orderkey", day.alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    return cast_columns(texts, {"d": T.DateType(), "t": T.TimestampType()}).select("o_orderkey", "d", F.unix_micros("t").alias("t"))


# --- helpers


@query("select 3.0::double mean, 9::bigint eta, '2024-02-03' d, '2024-02-03 04:05:06.000000' t, 'a' as unquoted, true text_type, 4 as flat, (select count(*) from nation) counted, 1 timings")
def helper_values(spark, d):
    clock = Clock()
    for t in (9, 1, 2, 3, 4, 5):
        clock.add_timing("step", t)
    when = datetime(2024, 2, 3, 4, 5, 6)
    before = len(Clock.shared()._timings["count nations"])
    counted = _database(spark).timed("count nations", lambda: table(spark, d, "nation").count())
    row = (clock.get_avg("step"), int(clock.eta("step", 3).total_seconds()), as_sql_date(when), as_sql_datetime(when), strip_outer_quotes("'a'"), is_text_type("TINYTEXT") and not is_text_type("INT"), len(flatten_list([1, [2, [3]], (4,)])), counted, len(Clock.shared()._timings["count nations"]) - before)
    return spark.createDataFrame([row], "mean double, eta bigint, d string, t string, unquoted string, text_type boolean, flat int, counted bigint, timings int")
