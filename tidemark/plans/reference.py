"""One query per operator of the engine over the shared tables, each with the SQL that must give the same rows.

Times come out as microseconds since 1970, so that no zone or display matters.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config.model import DatasetConfig, EngineConfig, IngestColumn, Pipeline, TableConfig, TableConfigs
from tidemark.functions import transforms as tf
from tidemark.operators import audit, delta, diff, ingest
from tidemark.operators.delta import Field, Merge, Policy
from tidemark.operators.foreign_keys import deduce_keys
from tidemark.operators.history import bulk_history
from tidemark.operators.temporal import FROM, TO, TimeSlice, close_rows, moment
from tidemark.plans.audit_log import AuditLog
from tidemark.plans.pipeline import DatasetRunner, run_datasets
from tidemark.plans.tables import table
from tidemark.session import jpath, scratch
from tidemark.sources.dsv import load_typed_dsv, union_all
from tidemark.store.tables import Database
from tidemark.streaming.messages import decode_json, start_stream
from tidemark.types import cast_columns, failed_casts, spark_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def utc(*a: int) -> datetime:
    return datetime(*a, tzinfo=timezone.utc)


def us(*names: str) -> list:
    return [F.unix_micros(n).alias(n.strip("_")) for n in names]


# --- projections, casts, transforms


@query("select c_custkey, c_name, c_nationkey::bigint c_nationkey, c_acctbal::decimal(12,2) c_acctbal, c_mktsegment from customer")
def scan_typed(spark, d):
    kinds = {"c_nationkey": "BIGINT", "c_acctbal": "NUMERIC(12,2)", "c_name": "VARCHAR(64)"}
    return cast_columns(table(spark, d, "customer"), {c: spark_type(t) for c, t in kinds.items()})


@query("select o_orderkey id, o_custkey customer_id, o_totalprice price from orders")
def select_map(spark, d):
    names = {"o_orderkey": "id", "o_custkey": "customer_id", "o_totalprice": "price"}
    item = Pipeline.of([{"schema": "shop", "table": "orders", "type": "primary", "columns": [*({"source": s, "target": t} for s, t in names.items()), {"source": "o_orderstatus"}]}]).primary
    return table(spark, d, "orders").select(*(F.col(s).alias(t) for s, t in item.column_map().items()))


@query("select o_orderkey, case when o_totalprice >= 200000 then null else o_totalprice end o_totalprice from orders")
def null_if_gte(spark, d):
    return tf.null_if_gte(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", [200000])


@query("select o_orderkey, o_orderstatus in ('F', 'O') o_orderstatus from orders")
def map_to_true(spark, d):
    return tf.map_to_true(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


@query("select o_orderkey, o_orderkey::varchar || '-' || o_orderstatus || '/x' label from orders")
def combine_columns(spark, d):
    return tf.combine_columns(table(spark, d, "orders"), "label", ["${o_orderkey}", "-", "${o_orderstatus}/x"]).select("o_orderkey", "label")


@query("select o_orderkey, o_orderdate::date d from orders")
def parse_date(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return tf.parse_date(table(spark, d, "orders").select("o_orderkey", text.alias("d")), "d", ["%Y/%m/%d", "%d.%m.%Y"])


@query("select p_partkey, p_size::double p_size from part")
def type_casts(spark, d):
    return tf.apply_type_casts(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", ["Utf8", "Float64"])


@query("select count(*) filter (try_cast(p_name as int) is null and p_name is not null) p_name, 0::bigint p_size from part")
def failed_cast_count(spark, d):
    return failed_casts(table(spark, d, "part"), {"p_name": T.IntegerType(), "p_size": T.LongType()})


@query("select o_orderkey, coalesce(case when o_totalprice >= 200000 then null else o_totalprice end, 1.5) o_totalprice, coalesce(nullif(o_orderstatus, 'P'), '?') o_orderstatus from orders")
def fill_defaults(spark, d):
    o = tf.null_if_gte(table(spark, d, "orders"), "o_totalprice", [200000]).select("o_orderkey", "o_totalprice", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"))
    return delta.fill_defaults(o, {"o_totalprice": ("1.5", T.DoubleType()), "o_orderstatus": ("?", T.StringType())})


@query("select event_id, case event_type when 'click' then true when 'view' then true when 'error' then false when 'signup' then false end flag from events")
def bool_parse(spark, d):
    from tidemark.types import cast

    word = F.create_map(*(F.lit(x) for x in ("click", "true", "view", "1", "error", "f", "signup", "0", "purchase", "maybe")))[F.col("event_type")]
    return table(spark, d, "events").select("event_id", cast(word, T.BooleanType()).alias("flag"))


@query("select count(*) filter (length(p_name) > 9) p_name, count(*) filter (length(p_brand) > 7) p_brand from part")
def length_check(spark, d):
    return delta.too_long(table(spark, d, "part"), [Field("p_name", "VARCHAR(9)"), Field("p_brand", "CHAR(7)"), Field("p_size", "INT")])


# --- duplicates


@query("select event_id, epoch_us(ts) ts, user_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def dedupe_last(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return delta.dedupe(e, ["user_id"], "last", ["ts", "event_id"]).select("event_id", *us("ts"), "user_id", "event_type")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"select {_LINE} from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def dedupe_first(spark, d):
    li = table(spark, d, "lineitem").select(*_LINE.split(", "))
    return delta.dedupe(li, ["l_orderkey", "l_linenumber"], "first", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query("select l_orderkey, l_linenumber, any_value(l_partkey) l_partkey from lineitem group by 1, 2 having count(*) = 1")
def dedupe_none(spark, d):
    return delta.dedupe(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], "none")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def duplicate_error_policy(spark, d):
    """Each order twice, alike in all columns: no conflict."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return delta.resolve_duplicates(o.unionByName(o), ["o_orderkey"], "error")


@query("select o_orderstatus, o_orderpriority, min(o_orderkey) o_orderkey from orders group by all")
def duplicate_first_policy(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return delta.resolve_duplicates(o, ["o_orderstatus", "o_orderpriority"], "take_first")


@query("select distinct o_custkey, o_orderstatus from orders")
def distinct_rows(spark, d):
    return delta.dedupe(table(spark, d, "orders").select("o_custkey", "o_orderstatus"))


# --- time buckets


def _buckets(interval: str, strategy: str, keep: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
        return ingest.bucketed(e, "ts", interval, ["user_id"], strategy, keep).select("event_id", "user_id", "event_type", *us("ts", ingest.BUCKET))

    return run


for _name, _interval, _strategy, _keep, _sql in (
    ("bucket_round_down", "1d", "round_down", "last", "date_trunc('day', ts)"),
    ("bucket_round_up", "1d", "round_up", "last", "date_trunc('day', ts) + interval 1 day"),
    ("bucket_first", "12h", "round_down", "first", "time_bucket(interval 12 hour, ts, timestamp '1970-01-01')"),
    ("bucket_weeks", "1w", "round_up", "last", "date_trunc('week', ts) + interval 7 day"),
    ("bucket_months", "1mo", "round_up", "last", "date_trunc('month', ts) + interval 1 month"),
    ("bucket_quarters", "1q", "round_down", "first", "date_trunc('quarter', ts)"),
):
    QUERIES[_name] = _buckets(_interval, _strategy, _keep)
    _order = "ts, event_id" if _keep == "first" else "ts desc, event_id desc"
    SQL[_name] = f"select event_id, user_id, event_type, epoch_us(ts) ts, epoch_us(b) bucket from (select *, {_sql} b from events) qualify row_number() over (partition by user_id, b order by {_order}) = 1"

_DAYS = "b as (select event_id, ts, user_id, event_type, date_trunc('day', ts) + interval 1 day b from events qualify row_number() over (partition by user_id, date_trunc('day', ts) order by ts desc, event_id desc) = 1)"


@query(f"with {_DAYS}, k as (select * from b where b > timestamp '2024-01-05') select event_id, user_id, epoch_us(ts) ts from k where ts > (select max(b) - interval 1 day from k)")
def filter_past_events(spark, d):
    e = ingest.bucketed(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "1d", ["user_id"], "round_up", "last")
    return ingest.drop_past(e, "ts", "1d", "round_up", utc(2024, 1, 5))[0].select("event_id", "user_id", *us("ts"))


# --- history


HIST = [Field("user_id", "BIGINT", False), Field("event_type", "VARCHAR(16)"), Field("value", "DOUBLE")]
EMPTY = "user_id bigint, event_type string, value double, __valid_from timestamp"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") / 100).alias("value").cast("double"))
    return ingest.bucketed(e, "ts", "1d", ["user_id"], "round_down", "last").select("user_id", "event_type", "value", F.col(ingest.BUCKET).alias("t"))


def history(spark: SparkSession, d: str, dropout: bool = False) -> DataFrame:
    return bulk_history(spark.createDataFrame([], EMPTY), _daily(spark, d), ["user_id"], HIST, "t", dropout)


_INP = "inp as (select user_id, event_type, floor(value / 100)::double as value, date_trunc('day', ts) t from events qualify row_number() over (partition by user_id, date_trunc('day', ts) order by ts desc, event_id desc) = 1)"
_SENT = "timestamp '2038-01-19 03:14:07.999999'"
_HIST = f"""{_INP},
f as (select *, row_number() over w = 1 or lag(event_type) over w is distinct from event_type or lag(value) over w is distinct from value keep from inp window w as (partition by user_id order by t)),
h as (select user_id, event_type, value, t vf, coalesce(lead(t) over (partition by user_id order by t), {_SENT}) vt from f where keep)"""
_DROP = f"""{_INP},
n as (select t, row_number() over (order by t) i, lead(t) over (order by t) nt from (select distinct t from inp)),
r as (select inp.*, i, nt from inp join n using (t)),
f as (select *, case when lag(i) over w = i - 1 and lag(event_type) over w is not distinct from event_type and lag(value) over w is not distinct from value then 0 else 1 end s from r window w as (partition by user_id order by t)),
g as (select *, sum(s) over (partition by user_id order by t) g from f),
h as (select user_id, any_value(event_type) event_type, any_value(value) as value, min(t) vf, coalesce(arg_max(coalesce(nt, {_SENT}), t), {_SENT}) vt from g group by user_id, g)"""
_OUT = "select user_id, event_type, value, epoch_us(vf) valid_from, epoch_us(vt) valid_to from h"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_type", "value", *us(FROM, TO))


@query(f"with {_HIST} {_OUT}")
def history_disabled(spark, d):
    return _shown(history(spark, d))


@query(f"with {_DROP} {_OUT}")
def history_dropout(spark, d):
    return _shown(history(spark, d, True))


@query(f"with {_DROP} {_OUT} where vt = {_SENT}")
def current(spark, d):
    return _shown(TimeSlice().apply(history(spark, d, True)))


@query(f"with {_HIST} {_OUT} where vf <= timestamp '2024-01-15' and timestamp '2024-01-15' < vt")
def asof(spark, d):
    return _shown(TimeSlice("asof", utc(2024, 1, 15)).apply(history(spark, d)))


@query(f"with {_HIST} {_OUT} where vf <= timestamp '2024-01-15' and vt > timestamp '2024-01-15'")
def span_0(spark, d):
    return _shown(TimeSlice("span", utc(2024, 1, 15)).apply(history(spark, d)))


@query(f"with {_HIST} {_OUT} where vf <= timestamp '2024-01-15' and vt > timestamp '2024-01-11'")
def span_n(spark, d):
    return _shown(TimeSlice("span", utc(2024, 1, 15), timedelta(days=4)).apply(history(spark, d)))


_VERS = f"""with {_HIST}"""


@query(f"{_VERS} select user_id, event_type, value, epoch_us(vf) valid_from, epoch_us(case when vt = {_SENT} and event_type = 'error' then timestamp '2024-02-01' else vt end) valid_to from h")
def temporal_delete(spark, d):
    h = history(spark, d)
    return _shown(close_rows(h, TimeSlice().apply(h).where("event_type = 'error'").select("user_id"), ["user_id"], utc(2024, 2, 1)))


# --- delta algebra: all orders against all of them edited: some keys new, some prices changed or null

ORDER = [Field("o_orderkey", "BIGINT", False), Field("o_orderstatus", "VARCHAR(1)"), Field("o_totalprice", "DOUBLE"), Field("o_custkey", "BIGINT")]
COLS = [f.name for f in ORDER]


def _target(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(*COLS)


def _delta(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(*COLS)
    new = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") + 10**12).otherwise(F.col("o_orderkey"))
    return o.withColumn("o_orderkey", new).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


_TD = """t as (select o_orderkey, o_orderstatus, o_totalprice, o_custkey from orders),
n as (select case when o_orderstatus = 'P' then o_orderkey + 1000000000000 else o_orderkey end o_orderkey, o_orderstatus, o_totalprice, o_custkey from orders),
d as (select o_orderkey, o_orderstatus, case when o_orderkey % 10 = 0 then null when o_orderkey % 4 = 0 then o_totalprice + 1 else o_totalprice end o_totalprice, o_custkey from n)"""


@query(f"with {_TD} select * from t where not exists (select 1 from d where d.o_orderkey = t.o_orderkey)")
def drop_missing(spark, d):
    return delta.drop_missing(_target(spark, d), _delta(spark, d), ["o_orderkey"])


@query(f"with {_TD} select * from d where o_orderkey not in (select o_orderkey from (select * from d intersect select * from t))")
def drop_unchanged(spark, d):
    return delta.drop_unchanged(_delta(spark, d), _target(spark, d), COLS, ["o_orderkey"])


@query(f"with {_TD} select t.o_orderkey, coalesce(d.o_orderstatus, t.o_orderstatus) o_orderstatus, case when d.o_orderkey is null then t.o_totalprice else d.o_totalprice end o_totalprice, t.o_custkey from t left join d using (o_orderkey)")
def update_matched(spark, d):
    return delta.update_matched(_target(spark, d), _delta(spark, d), ["o_orderkey"], ORDER)


@query(f"with {_TD} select * from d where not exists (select 1 from t where d.o_orderkey = t.o_orderkey)")
def insert_new(spark, d):
    return delta.insert_new(_target(spark, d), _delta(spark, d), ["o_orderkey"])


@query(f"with {_TD} select t.o_orderkey, t.o_orderstatus, case when d.o_orderkey is null then t.o_totalprice else coalesce(d.o_totalprice, t.o_totalprice) end o_totalprice, t.o_custkey from t left join d using (o_orderkey)")
def null_policy_keep(spark, d):
    return delta.update_matched(_target(spark, d), _delta(spark, d), ["o_orderkey"], [Field(f.name, f.data_type, f.name != "o_totalprice" and f.nullable) for f in ORDER])


@query(f"with {_TD} select t.o_orderkey, t.o_orderstatus, case when d.o_orderkey is null then t.o_totalprice else coalesce(d.o_totalprice, 9.5) end o_totalprice, t.o_custkey from t left join d using (o_orderkey)")
def null_policy_default(spark, d):
    return delta.update_matched(_target(spark, d), _delta(spark, d), ["o_orderkey"], [Field(f.name, f.data_type, f.name != "o_totalprice" and f.nullable, "9.5" if f.name == "o_totalprice" else None) for f in ORDER])


@query(f"with {_TD} select * from t union all select * from d")
def union_rows(spark, d):
    return union_all([_target(spark, d), _delta(spark, d)])


def _merged(spark: SparkSession, d: str, finality: str) -> tuple[Merge, DataFrame]:
    m = Merge(["o_orderkey"], ORDER, utc(2001, 1, 1), Policy(True, "error", row_finality=finality))
    return m, m.plan(_target(spark, d).withColumn(FROM, moment(utc(2000, 1, 1))), _delta(spark, d))


_CHG = "(d.o_totalprice is distinct from t.o_totalprice or d.o_orderstatus is distinct from t.o_orderstatus or d.o_custkey is distinct from t.o_custkey)"


@query(
    f"""with {_TD}, j as (select t.o_orderkey tk, d.o_orderkey dk, t.o_orderstatus ts, d.o_orderstatus ds, t.o_totalprice tp, d.o_totalprice dp, t.o_custkey tc, d.o_custkey dc, {_CHG} c from t full join d on t.o_orderkey = d.o_orderkey)
select coalesce(dk, tk) o_orderkey, coalesce(ds, ts) o_orderstatus, case when dk is null then tp else dp end o_totalprice, coalesce(dc, tc) o_custkey,
  epoch_us(case when tk is null or (dk is not null and c) then timestamp '2001-01-01' else timestamp '2000-01-01' end) valid_from from j"""
)
def merge_live(spark, d):
    m, plan = _merged(spark, d, "disabled")
    return m.live(plan).select(*COLS, *us(FROM))


@query(f"with {_TD} select t.*, epoch_us(timestamp '2000-01-01') valid_from, epoch_us(timestamp '2001-01-01') valid_to from t left join d on t.o_orderkey = d.o_orderkey where d.o_orderkey is null or {_CHG}")
def merge_closed_dropout(spark, d):
    m, plan = _merged(spark, d, "dropout")
    return m.closed(plan).select(*COLS, *us(FROM, TO))


@query(f"""with {_TD} select count(*) filter (t.o_orderkey is null) inserts, count(*) filter (t.o_orderkey is not null and d.o_orderkey is not null and {_CHG}) updates,
  count(*) filter (d.o_orderkey is null) + count(*) filter (t.o_orderkey is not null and d.o_orderkey is not null and not {_CHG}) deletions from t full join d on t.o_orderkey = d.o_orderkey""")
def merge_counts(spark, d):
    m, plan = _merged(spark, d, "dropout")
    return spark.createDataFrame([tuple(m.counts(plan))], "inserts bigint, updates bigint, deletions bigint")


# --- keys and lookups


def _parent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").cast("int").alias("id"), F.max("p_size").alias("most")).where("most < 49").drop("most")


_PAR = "p as (select p_brand, p_type, min(p_partkey)::int id from part group by all having max(p_size) < 49), v as (select distinct p_brand, p_type from part), n as (select p_brand, p_type, ((select max(id) from p) + row_number() over (order by p_brand, p_type))::int id from v where (p_brand, p_type) not in (select (p_brand, p_type) from p)), a as (select * from p union all select p_brand, p_type, id from n)"
_PF = [Field("id", "INT", False, autoincrement=True), Field("p_brand", "VARCHAR(16)"), Field("p_type", "VARCHAR(32)")]


@query(f"with {_PAR} select p_partkey, part.p_brand, part.p_type, id type_id from part join a on part.p_brand = a.p_brand and part.p_type = a.p_type")
def fk_deduce(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return deduce_keys(parts, _parent(spark, d), _PF, {"p_brand": "p_brand", "p_type": "p_type"}, ("type_id", "id"))[0].select("p_partkey", "p_brand", "p_type", "type_id")


@query(f"with {_PAR} select p_brand, p_type, id from n")
def fk_new_parents(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return deduce_keys(parts, _parent(spark, d), _PF, {"p_brand": "p_brand", "p_type": "p_type"}, ("type_id", "id"))[1].select("p_brand", "p_type", "id")


# --- aggregates


@query("select l_returnflag, l_linestatus, sum(l_quantity::decimal(12,2))::decimal(22,2) q from lineitem group by all")
def group_sum_ingest(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("decimal(22,2)").alias("q"))
    return ingest.group_sum(li, ["q"])


# --- audit


_AUDIT = "a as (select audit_id, lower(trim(table_name)) table_name, data_source_type, data_source, data_source_ts, upload_ts from audit_log)"
_IT = "i as (select distinct data_source p, data_source_ts c from source_items where lower(trim(table_name)) = 'food_prices')"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_log").withColumn("table_name", F.lower(F.trim("table_name"))).drop("run_id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_items").where("lower(trim(table_name)) = 'food_prices'")
    return s.select(F.col("data_source").alias("__path"), F.col("data_source_ts").alias("__created_at"))


def _found(df: DataFrame) -> DataFrame:
    return df.select(F.col("__path").alias("path"), *us("__created_at"))


@query(f"with {_AUDIT}, {_IT} select p path, epoch_us(c) created_at from i where p not in (select data_source from a where table_name = 'food_prices' and data_source_ts < timestamptz '1998-01-20 00:00:00+00') and c >= (select max(data_source_ts) from a where table_name = 'food_prices' and data_source_ts < timestamptz '1998-01-20 00:00:00+00')")
def audit_filter(spark, d):
    return _found(audit.filter_items(_items(spark, d), _log(spark, d).where(F.col("data_source_ts") < moment(utc(1998, 1, 20))), "food_prices"))


@query(f"with {_AUDIT}, {_IT} select p path, epoch_us(c) created_at from i where c <= (select min(data_source_ts) from a where table_name = 'food_prices')")
def audit_prevalidate(spark, d):
    return _found(audit.late_items(_items(spark, d).distinct(), _log(spark, d), "food_prices"))


@query(f"with {_AUDIT} select audit_id, table_name, data_source, epoch_us(data_source_ts) data_source_ts from a where data_source_ts <= timestamptz '1998-03-01 00:00:00+00' qualify row_number() over (partition by table_name order by a.data_source_ts desc, audit_id desc) = 1")
def audit_latest(spark, d):
    return audit.latest_entries(_log(spark, d), utc(1998, 3, 1)).select("audit_id", "table_name", "data_source", *us("data_source_ts"))


@query(f"with {_AUDIT} select audit_id, table_name from a where not (table_name = 'unit_info' and data_source_ts >= timestamptz '1998-02-01 00:00:00+00')")
def audit_purge(spark, d):
    return audit.purged(_log(spark, d), "unit_info", utc(1998, 2, 1)).select("audit_id", "table_name")


# --- differences, nested data


@query(
    f"""with {_TD} select coalesce(t.o_orderkey, d.o_orderkey) o_orderkey, t.o_orderstatus o_orderstatus_lhs, d.o_orderstatus o_orderstatus_rhs, t.o_totalprice o_totalprice_lhs, d.o_totalprice o_totalprice_rhs
from t full join d on t.o_orderkey = d.o_orderkey where t.o_orderstatus is distinct from d.o_orderstatus or (t.o_totalprice is null) <> (d.o_totalprice is null) or abs(t.o_totalprice - d.o_totalprice) > 1e-9"""
)
def differing_rows(spark, d):
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    return diff.differing(_target(spark, d).select(*cols), _delta(spark, d).select(*cols), ["o_orderkey"])


@query("select o_orderkey, o_totalprice o_totalprice_lhs, case when o_totalprice >= 200000 then null else o_totalprice end o_totalprice_rhs from orders where o_totalprice >= 200000")
def compare_dataframes(spark, d):
    """Only the price differs, so the other compared column doesn't come out."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return diff.compare_dataframes(o, tf.null_if_gte(o, "o_totalprice", [200000]), ["o_orderkey"])[0]


@query("select unnest(['missing:a_lhs', 'missing:b_lhs', 'missing:o_custkey_rhs', 'missing:o_orderdate_rhs', 'missing:o_orderpriority_rhs']) missing")
def compare_missing(spark, d):
    o = table(spark, d, "orders")
    rhs = o.select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("b"), F.lit(2).alias("a"))
    return spark.createDataFrame([(m,) for m in diff.compare_dataframes(o, rhs, ["o_orderkey"])[1]], "missing string")


@query("select vec_id, unnest(embedding)::double e, label from embeddings")
def flatten_lists(spark, d):
    return diff.recursive_flatten(table(spark, d, "embeddings")).select("vec_id", F.col("embedding").cast("double").alias("e"), "label")


@query("select event_id, (props::json->>'k')::int k, event_type label from events")
def flatten_structs(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("props"), F.struct(F.col("event_type").alias("label")).alias("x"))
    flat = diff.recursive_flatten(e)
    return flat.select("event_id", F.col("`props.k`").alias("k"), F.col("`x.label`").alias("label"))


# --- sources and sinks


def _csv(df: DataFrame, name: str) -> list[str]:
    """df as files of text in the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.csv(path, header=True, emptyValue="", nullValue="None", escape='"')
    fs, p = jpath(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".csv") and s.getLen())


@query("select p_partkey id, p_name as name, p_size size, p_retailprice price from part")
def dsv_scan(spark, d):
    p = table(spark, d, "part")
    cols = [IngestColumn("s", "t", "p_partkey", "id", ingestion_data_type="BIGINT"), IngestColumn("s", "t", "p_name", "name", ingestion_data_type="VARCHAR(64)"), IngestColumn("s", "t", "p_size", "size", ingestion_data_type="INT"), IngestColumn("s", "t", "p_retailprice", "price", ingestion_data_type="DOUBLE")]
    return load_typed_dsv(spark, _csv(p, "part"), cols).select(*(F.col(c.source).alias(c.target) for c in cols))


# --- tables, end to end


def _database(spark: SparkSession) -> Database:
    return Database(spark, scratch(spark, "db"))


_CUST = TableConfig.of({"schema": "shop", "name": "customer", "is_temporal": True, "primary_keys": ["c_custkey"], "columns": [{"name": "c_custkey", "data_type": "BIGINT"}, {"name": "c_acctbal", "data_type": "DOUBLE"}, {"name": "c_mktsegment", "data_type": "VARCHAR(10)"}]})


def _customers(spark: SparkSession, d: str) -> Database:
    """Customers uploaded in 2001, in 2002 without those in debt and with those of a segment changed."""
    db = _database(spark)
    db.create(_CUST)
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    policy = Policy(True, "take_last", row_finality="dropout")
    db.table_upsert_temporal(c, "shop", "customer", policy, utc(2001, 1, 1))
    edited = c.where("c_acctbal >= 0").withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", 0.5).otherwise(F.col("c_acctbal")))
    db.table_upsert_temporal(edited, "shop", "customer", policy, utc(2002, 1, 1))
    return db


_CV = f"""v as (
select c_custkey, c_acctbal, c_mktsegment, timestamp '2001-01-01' vf, case when c_acctbal < 0 or (c_mktsegment = 'BUILDING' and c_acctbal <> 0.5) then timestamp '2002-01-01' else {_SENT} end vt from customer
union all select c_custkey, 0.5, c_mktsegment, timestamp '2002-01-01', {_SENT} from customer where c_acctbal >= 0 and c_mktsegment = 'BUILDING' and c_acctbal <> 0.5)"""


@query(f"with {_CV} select c_custkey, c_acctbal, c_mktsegment, epoch_us(vf) valid_from, epoch_us(vt) valid_to from v")
def table_all_versions(spark, d):
    return _customers(spark, d).from_table("shop", "customer", TimeSlice("all")).select("c_custkey", "c_acctbal", "c_mktsegment", *us(FROM, TO))


@query(f"with {_CV} select c_custkey, c_acctbal from v where vf <= timestamp '2001-06-01' and timestamp '2001-06-01' < vt and c_custkey in (select o_custkey from orders)")
def table_query_asof(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _customers(spark, d).table_query("shop", "customer", keys, ["c_custkey", "c_acctbal"], TimeSlice("asof", utc(2001, 6, 1))).drop(FROM, TO)


@query(f"with {_CV} select c_mktsegment, count(*) n from v where vt = {_SENT} group by all")
def raw_sql(spark, d):
    return _customers(spark, d).from_raw_sql("select c_mktsegment, count(*) n from (select * from shop.customer) group by c_mktsegment")


@query(f"with {_CV} select a.c_custkey, a.c_acctbal before, b.c_acctbal as after from v a join v b on a.c_custkey = b.c_custkey where a.vf = timestamp '2001-01-01' and b.vt = {_SENT} and b.vf = timestamp '2002-01-01'")
def raw_sql_system_time(spark, d):
    return _customers(spark, d).from_raw_sql("select a.c_custkey, a.c_acctbal as before, b.c_acctbal as after from shop.customer for system_time as of '2001-06-01' a join shop.customer b on a.c_custkey = b.c_custkey where a.c_acctbal <> b.c_acctbal")


_EV = EngineConfig(
    TableConfigs(
        [
            {"schema": "web", "name": "kinds", "primary_keys": ["id"], "columns": [{"name": "id", "data_type": "INT", "autoincrement": True}, {"name": "name", "data_type": "VARCHAR(16)"}]},
            {"schema": "web", "name": "activity", "is_temporal": True, "primary_keys": ["user_id"], "foreign_keys": [{"name": "kind_id", "references": {"schema": "web", "table": "kinds", "column": "id"}}], "columns": [{"name": "user_id", "data_type": "BIGINT"}, {"name": "kind_id", "data_type": "INT"}]},
        ]
    ),
    (),
)


def _activity(spark: SparkSession, d: str) -> Database:
    """Events as a delimited file through a pipeline with a lookup table and daily buckets."""
    e = table(spark, d, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    folder = _csv(e.orderBy("ts"), "events")[0].rpartition("/")[0]  # several files, later events in later ones
    dataset = {
        "name": "activity_feed",
        "delta_table_schema": "web",
        "input_config": {"type": "dsv", "files_per_batch": 100, "search_paths": [{"root_path": folder, "file_include": ["*.csv"], "timestamp": {"method": "manual", "datetime": "2024-03-01T00:00:00", "source_tz": "UTC"}}]},
        "time_partition": {"column": "time", "bucket_interval": "1d", "bucket_strategy": "round_down", "unique_strategy": "last"},
        "delta_config": {"drop_unchanged_rows": True, "on_duplicate_key": "take_last"},
        "pipeline": [
            {"schema": "web", "table": "kinds", "columns": [{"source": "event_type", "target": "name"}, {"target": "id", "column_type": "computed", "deduce_foreign_key": True}]},
            {"schema": "web", "table": "activity", "type": "primary", "columns": [{"source": "user_id", "target": "user_id"}, {"source": "id", "target": "kind_id"}, {"source": "ts", "ingestion_data_type": "VARCHAR(32)"}, {"target": "time", "column_type": "time_partition_only", "target_data_type": "DATETIME", "transforms": {"combine_columns": ["${ts}"]}}]},
        ],
    }
    db = _database(spark)
    run_datasets(EngineConfig(_EV.tables, (DatasetConfig.of(dataset),)), db, "activity_feed", wait=0)
    return db


_ACT = f"""inp as (select user_id, event_type, date_trunc('day', ts) t from events qualify row_number() over (partition by user_id, date_trunc('day', ts) order by ts desc) = 1),
f as (select *, row_number() over w = 1 or lag(event_type) over w <> event_type keep from inp window w as (partition by user_id order by t)),
k as (select event_type, row_number() over (order by event_type) id from (select distinct event_type from inp)),
h as (select user_id, event_type, t vf, coalesce(lead(t) over (partition by user_id order by t), {_SENT}) vt from f where keep)"""


@query(f"with {_ACT} select user_id, id::int kind_id, epoch_us(vf) valid_from, epoch_us(vt) valid_to from h join k using (event_type)")
def pipeline_history(spark, d):
    return _activity(spark, d).from_table("web", "activity", TimeSlice("all")).select("user_id", "kind_id", *us(FROM, TO))


@query(f"with {_ACT} select id::int id, event_type as name from k")
def extract_lookup(spark, d):
    return _activity(spark, d).from_table("web", "kinds")


_PLAIN = TableConfig.of(
    {"schema": "shop", "name": "orders", "primary_keys": ["o_orderkey"], "columns": [{"name": "o_orderkey", "data_type": "BIGINT"}, {"name": "o_orderstatus", "data_type": "VARCHAR(1)", "default_value": "?"}, {"name": "o_totalprice", "data_type": "DOUBLE", "default_value": "0.5"}, {"name": "o_custkey", "data_type": "BIGINT"}]}
)


def _orders(spark: SparkSession, d: str) -> Database:
    db = _database(spark)
    db.create(_PLAIN)
    db.table_insert(_delta(spark, d), "shop", "orders", ["o_orderkey"], True)
    return db


_ORD = "x as (select o_orderkey, o_orderstatus, coalesce(o_totalprice, 0.5) o_totalprice, o_custkey from d)"


@query(f"with {_TD}, {_ORD} select * from x")
def table_insert(spark, d):
    return _orders(spark, d).from_table("shop", "orders")


@query(f"with {_TD}, {_ORD} select o_orderkey, coalesce(t.o_orderstatus, x.o_orderstatus) o_orderstatus, coalesce(t.p, x.o_totalprice) o_totalprice, o_custkey from x left join (select o_orderkey, o_orderstatus, o_totalprice * 2 p from t) t using (o_orderkey)")
def table_update(spark, d):
    db = _orders(spark, d)
    db.table_update(_target(spark, d).select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") * 2).alias("o_totalprice")), "shop", "orders")
    return db.from_table("shop", "orders")


@query(f"with {_TD}, {_ORD} select * from x where o_orderkey not in (select o_orderkey from t)")
def table_delete_rows(spark, d):
    db = _orders(spark, d)
    db.table_delete_rows(_target(spark, d).select("o_orderkey"), "shop", "orders")
    return db.from_table("shop", "orders")


@query(f"with {_CV} select c_custkey, epoch_us(vf) valid_from, epoch_us(case when vt = {_SENT} and c_mktsegment = 'MACHINERY' then timestamp '2003-01-01' else vt end) valid_to from v")
def table_delete_rows_temporal(spark, d):
    db = _customers(spark, d)
    db.table_delete_rows_temporal(table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey"), "shop", "customer", utc(2003, 1, 1))
    return db.from_table("shop", "customer", TimeSlice("all")).select("c_custkey", *us(FROM, TO))


@query("select count(*) filter (c_acctbal >= 0 and c_mktsegment = 'BUILDING' and c_acctbal <> 0.5) updates, 0::bigint inserts, count(*) filter (c_acctbal < 0) + count(*) filter (c_acctbal >= 0 and not (c_mktsegment = 'BUILDING' and c_acctbal <> 0.5)) deletions from customer")
def upsert_counts(spark, d):
    db = _database(spark)
    db.create(_CUST)
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    policy = Policy(True, "take_last", row_finality="dropout")
    db.table_upsert_temporal(c, "shop", "customer", policy, utc(2001, 1, 1))
    edited = c.where("c_acctbal >= 0").withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", 0.5).otherwise(F.col("c_acctbal")))
    n = db.table_upsert_temporal(edited, "shop", "customer", policy, utc(2002, 1, 1))
    return spark.createDataFrame([tuple(n)], "inserts bigint, updates bigint, deletions bigint")


@query("select distinct 'activity' table_name, 'dsv' data_source_type, 1709251200000000 data_source_ts union all select 'kinds', 'dsv', 1709251200000000")
def audit_entries(spark, d):
    return AuditLog(_activity(spark, d), "web").rows().select("table_name", "data_source_type", *us("data_source_ts")).distinct()


@query("select user_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc) = 1")
def stream_upsert(spark, d):
    """The events as a stream of files into a table that keeps the last one of each user."""
    config = TableConfigs([{"schema": "web", "name": "last_event", "primary_keys": ["user_id"], "columns": [{"name": "user_id", "data_type": "BIGINT"}, {"name": "event_type", "data_type": "VARCHAR(16)"}, {"name": "value", "data_type": "DOUBLE"}]}])
    dataset = DatasetConfig.of(
        {
            "name": "last_events",
            "input_config": {"type": "nats-jetstream"},
            "time_partition": {"column": "ts", "bucket_interval": "1d", "bucket_strategy": "round_down"},
            "delta_config": {"on_duplicate_key": "take_last"},
            "pipeline": [{"schema": "web", "table": "last_event", "type": "primary", "columns": [*({"source": c, "target": c} for c in ("user_id", "event_type", "value")), {"target": "ts", "column_type": "time_partition_only", "target_data_type": "DATETIME"}]}],
        }
    )
    db = _database(spark)
    db.create_all(config)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    start_stream(DatasetRunner(db, dataset, config), stream, scratch(spark, "stream")).awaitTermination()
    return db.from_table("web", "last_event")


@query("select event_id, case when event_id % 5 <> 0 then user_id end user_id, case when event_id % 5 <> 0 then value end as value, event_id % 5 = 0 bad from events")
def message_decode(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 5 != 0, F.to_json(F.struct("user_id", "value"))).otherwise(F.lit("{broken"))
    return decode_json(e.select("event_id", text.alias("data")), "user_id bigint, value double").withColumnRenamed("__bad", "bad")
