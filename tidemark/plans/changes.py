"""Queries p1 to p5: changes, increments, rejects, histories and survivors over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import clean_double, clean_text, fold
from tidemark.operators.chains import build_chains, rebuild_chains
from tidemark.operators.errparse import loaded, parse_lines, rejects
from tidemark.operators.incremental import pending_items
from tidemark.operators.skyline import survivors
from tidemark.operators.snapshots import snapshot_chain, snapshot_changes
from tidemark.plans.tables import table
from tidemark.session import scratch
from tidemark.store.log import CommitLog
from tidemark.store.versioned import VersionedTable

#: What stands in for a missing double_col and varchar_col.
MISSING_DOUBLE, MISSING_TEXT = 1.618033988749895, "?abcdefghijklmn?"
#: Part of the updates, by upload time, that the first build of the history covers; the rest comes as a later batch.
FIRST_BATCH = 0.9


def _values() -> dict:
    return {"double_col": clean_double("double_col"), "varchar_col": clean_text("varchar_col")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    chain = snapshot_chain(table(spark, d, "snapshot_files"))
    found = snapshot_changes(table(spark, d, "simple_01"), chain, _values(), {"double_col": 1e-9})
    return found.select("file_id", F.col("id").cast("long").alias("id"), "change_kind")


def p1_changed_values(spark: SparkSession, d: str) -> DataFrame:
    """The same changes with the values before and after."""
    chain = snapshot_chain(table(spark, d, "snapshot_files"))
    found = snapshot_changes(table(spark, d, "simple_01"), chain, _values(), {"double_col": 1e-9})
    return found.select("file_id", F.col("id").cast("long").alias("id"), "change_kind", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("double_col", "varchar_col")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items = pending_items(table(spark, d, "source_items"), table(spark, d, "audit_log"), table(spark, d, "ingest_runs"), scratch(spark, "items"))
    return items.select("item_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects(parse_lines(table(spark, d, "raw_lines"))).select("file_id", "line_no", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return loaded(parse_lines(table(spark, d, "raw_lines")))


CHAINS = {"key": "id", "start": "__valid_from", "end": "__valid_to", "rank": ("upload_ts", "update_id")}


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """Each id's versions: built from the updates that came first, then rebuilt for the ids that the later ones touch."""
    raw = table(spark, d, "simple_01_updates")
    cut = raw.agg(F.percentile_approx("upload_ts", FIRST_BATCH).alias("t")).first()["t"]
    late = F.col("upload_ts") > F.lit(cut) if cut is not None else F.lit(False)
    late = F.coalesce(late, F.lit(False))
    chains = VersionedTable(CommitLog(spark, scratch(spark, "chains")), "simple_01_chains")
    first = raw.where(~late)
    chains.commit(add=build_chains(first, values=_values(), **CHAINS))
    rebuild_chains(chains, raw, raw.where(late), values=_values(), **CHAINS)
    return chains.read()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_history(spark, d).select(F.col("id").cast("long").alias("id"), "valid_from_us", "valid_to_us")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    config = table(spark, d, "delta_config").select("dataset", F.col("on_duplicate_key").alias("policy"))
    rows = table(spark, d, "simple_01_delta").select(fold("dataset").alias("__name"), "id", "row_id", "double_col", "varchar_col", "trust", "data_source_ts")
    config = config.withColumn("__name", fold("dataset"))
    known = rows.join(F.broadcast(config), "__name")  # delta_config has a fixed number of rows
    text, number = clean_text("varchar_col"), clean_double("double_col")
    out = survivors(
        known,
        ["dataset", "id"],
        {"double_col": F.when(number != MISSING_DOUBLE, number), "varchar_col": F.when(text != MISSING_TEXT, text)},
        trust=F.col("trust"),
        recency=F.unix_micros("data_source_ts"),
        row=F.col("row_id"),
        oldest_first=F.col("policy") != "take_last",
        strict=F.col("policy") == "error",
    )
    return out.select("dataset", "id", "n_rows", "n_skyline", "double_col", "double_col_row", "varchar_col", "varchar_col_row")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_survivors(spark, d).select("dataset", F.col("id").cast("long").alias("id"), F.col("double_col_row").alias("double_row"), F.col("varchar_col_row").alias("varchar_row"))


QUERIES = {f.__name__: f for f in (p1_found, p1_changed_values, p2_found, p3_found, p3_loaded, p4_found, p4_history, p5_found, p5_survivors)}

_ROWS = """
with chosen as (
  select file_id, data_source, data_source_ts from (
    select *, row_number() over (partition by data_source, data_source_ts order by upload_ts desc nulls last, file_id desc) n from snapshot_files) where n = 1),
chain as (select file_id, lag(file_id) over (partition by data_source order by data_source_ts nulls first) prev from chosen),
r as (
  select file_id, id, case when isnan(double_col) then null else double_col end d,
    case when trim(varchar_col) in ('', 'None') then null else trim(varchar_col) end v
  from (select *, row_number() over (partition by file_id, id order by line_no desc) n from simple_01 where id is not null) where n = 1),
b as (select chain.file_id, r.id, r.d, r.v from chain join r using (file_id) where prev is not null),
a as (select chain.file_id, r.id, r.d, r.v from chain join r on r.file_id = chain.prev),
j as (
  select coalesce(a.file_id, b.file_id) file_id, coalesce(a.id, b.id)::bigint id, a.d ad, b.d bd, a.v av, b.v bv,
    case when a.id is null then 'added' when b.id is null then 'removed'
      when a.v is distinct from b.v or (a.d is null) <> (b.d is null) or abs(a.d - b.d) > 1e-9 then 'changed' end kind
  from a full join b on a.file_id = b.file_id and a.id = b.id)
"""

_UPDATES = """
with one as (
  select id, epoch_us("__valid_from") f, coalesce(epoch_us("__valid_to"), 2147483647999999) t, case when isnan(double_col) then null else double_col end d,
    case when trim(varchar_col) in ('', 'None') then null else trim(varchar_col) end v
  from (select *, row_number() over (partition by id, "__valid_from" order by upload_ts desc nulls last, update_id desc) n
    from simple_01_updates where id is not null and "__valid_from" is not null) where n = 1),
held as (select id, f, least(t, coalesce(lead(f) over (partition by id order by f), t)) t, d, v from one),
flag as (select *, case when lag(t) over w = f and lag(d) over w is not distinct from d and lag(v) over w is not distinct from v then 0 else 1 end s
  from held where t > f window w as (partition by id order by f)),
numbered as (select *, sum(s) over (partition by id order by f) g from flag),
versions as (select id, min(f) valid_from_us, max(t) valid_to_us, any_value(d) double_col, any_value(v) varchar_col from numbered group by id, g)
"""

_DELTA = """
with r as (
  select c.dataset, d.id, d.row_id, d.trust, c.on_duplicate_key p,
    case when c.on_duplicate_key = 'take_last' then -epoch_us(d.data_source_ts) else epoch_us(d.data_source_ts) end ts,
    case when c.on_duplicate_key = 'take_last' then -d.row_id else d.row_id end o,
    case when isnan(d.double_col) or d.double_col = 1.618033988749895 then null else d.double_col end x,
    case when trim(d.varchar_col) in ('', 'None', '?abcdefghijklmn?') then null else trim(d.varchar_col) end y
  from simple_01_delta d join delta_config c on lower(trim(d.dataset)) = lower(trim(c.dataset))),
ranked as (
  select *, row_number() over (partition by dataset, id order by (x is null), trust desc nulls last, ts nulls last, o) nx,
    row_number() over (partition by dataset, id order by (y is null), trust desc nulls last, ts nulls last, o) ny from r),
g as (
  select dataset, id::bigint id, count(*) n, any_value(p) p,
    any_value(x) filter (nx = 1) double_value, any_value(y) filter (ny = 1) varchar_value,
    coalesce(max(row_id) filter (nx = 1 and x is not null), 0) double_row, coalesce(max(row_id) filter (ny = 1 and y is not null), 0) varchar_row,
    count(distinct x) > 1 or count(distinct y) > 1 clash
  from ranked group by dataset, id having count(*) >= 2)
"""



def _by_delimiter(make) -> str:
    return "case d " + " ".join(f"when '{d}' then {make('[' + d + ']', d)}" for d in ",;|:") + " end"


_CELL = lambda d: f'( *"(?:[^"]|"")*" *|[^"{d}]*)'
_CLEAN = "list_transform({}, lambda c: case when trim(c) like '\"%' then trim(replace(trim(c)[2:-2], '\"\"', '\"')) else trim(c) end)"
_RECORDS = f"""
with l as (select file_id, line_no::bigint line_no, regexp_replace(line, '^\\x{{FEFF}}|\\r$', '', 'g') t from raw_lines where line is not null),
h as (select file_id, trim(t) t, case when contains(t, ',') then ',' when contains(t, ';') then ';' when contains(t, '|') then '|' when contains(t, ':') then ':' else ',' end d
  from (select file_id, min(t) t from l where line_no = 1 group by file_id)),
heads as (select file_id, d, {_CLEAN.format(_by_delimiter(lambda p, d: f"regexp_extract_all(d || t, '{p}{_CELL(d)}', 1)"))} names from h where t <> ''),
b as (select l.file_id, l.line_no, l.t, coalesce(d, ',') d, coalesce(names, ['id', 'double_col', 'varchar_col']) names from l left join heads using (file_id)
  where (line_no is null or line_no <> 1) and trim(l.t) <> ''),
s as (select *, {_by_delimiter(lambda p, d: f"regexp_full_match(t, '{_CELL(d)}(?:{p}{_CELL(d)})*')")} sound,
  {_CLEAN.format(_by_delimiter(lambda p, d: f"regexp_extract_all(d || t, '{p}{_CELL(d)}', 1)"))} cells from b),
v as (select *, coalesce(cells[list_position(names, 'id')], '') i, coalesce(cells[list_position(names, 'double_col')], '') x, coalesce(cells[list_position(names, 'varchar_col')], '') w from s),
r as (select *, case when not sound then 'quoting' when len(cells) <> len(names) then 'column_count'
  when not regexp_full_match(i, '[+-]?[0-9]+') or coalesce(try_cast(ltrim(i, '+') as hugeint), 1::hugeint << 40) not between -2147483648 and 2147483647 then 'invalid_id'
  when x not in ('', 'None') and not (regexp_full_match(x, '[+-]?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?') and coalesce(isfinite(try_cast(ltrim(x, '+') as double)), false)) then 'invalid_double_col'
  when length(w) > 20 or contains(w, chr(65533)) then 'invalid_varchar_col' end reason from v)
"""

SQL = {
    "p3_found": _RECORDS + "select file_id, line_no, reason from r where reason is not null",
    "p3_loaded": _RECORDS + "select file_id, line_no, try_cast(ltrim(i, '+') as int) id, case when x not in ('', 'None') then try_cast(ltrim(x, '+') as double) end double_col, case when w not in ('', 'None') then w end varchar_col from r where reason is null",
    "p1_found": _ROWS + "select file_id, id, kind change_kind from j where kind is not null",
    "p1_changed_values": _ROWS + "select file_id, id, kind change_kind, ad old_double_col, av old_varchar_col, bd new_double_col, bv new_varchar_col from j where kind is not null",
    "p2_found": """
with a as (
  select lower(trim(table_name)) t, data_source_type y, data_source s, date_trunc('second', data_source_ts) ts, max(upload_ts) u
  from audit_log where run_id in (select run_id from ingest_runs where lower(trim(status)) = 'committed') group by all),
i as (
  select lower(trim(table_name)) t, data_source_type y, data_source s, date_trunc('second', data_source_ts) ts, min(item_id) item_id, max(changed_ts) c
  from source_items group by all)
select item_id from i where not exists (
  select 1 from a where a.t is not distinct from i.t and a.y is not distinct from i.y and a.s is not distinct from i.s and a.ts is not distinct from i.ts and a.u >= i.c)
""",
    "p4_found": _UPDATES + "select id::bigint id, valid_from_us, valid_to_us from versions",
    "p4_history": _UPDATES + "select id, valid_from_us, valid_to_us, double_col, varchar_col from versions",
    "p5_found": _DELTA
    + "select dataset, id, case when p = 'error' and clash then -1 else double_row end double_row, case when p = 'error' and clash then -1 else varchar_row end varchar_row from g",
    "p5_survivors": _DELTA
    + """, z as (select dataset, id::bigint id, (x is not null)::int + (y is not null)::int c, coalesce(trust, -1) t, coalesce(-ts, -9e18::bigint) l, -o o from r),
k as (select dataset, id, count(*) n from z where not exists (select 1 from z q where q.dataset = z.dataset and q.id is not distinct from z.id and q.c >= z.c and q.t >= z.t and (q.l > z.l or (q.l = z.l and q.o > z.o))) group by all)
select dataset, id::int id, g.n n_rows, k.n n_skyline, case when not (p = 'error' and clash) then double_value end double_col, case when p = 'error' and clash then -1 else double_row end double_col_row,
  case when not (p = 'error' and clash) then varchar_value end varchar_col, case when p = 'error' and clash then -1 else varchar_row end varchar_col_row from g join k using (dataset, id)""",
}
