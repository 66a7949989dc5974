"""Registered queries, one or more for each operator, and their DuckDB counterparts."""

from __future__ import annotations

import http.server
import json
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HashSpec, base64_view
from ..functions.scalars import changed_fields, date_key, transpose
from ..operators import extract as ex
from ..operators.find import deleted_rows, find, find_null_safe, lookup_key
from ..operators.mapper import Mapper
from ..operators.merge import apply_updates, first_wins, fold_in_place, load_default, load_inline, load_scd, load_snapshot, load_transaction
from ..operators.quality import ensure, report_test
from ..operators.surrogate import assign_keys
from ..params import ExtractParameter
from ..sinks import CsvSink, NullSink, SqliteSink, TableSink
from ..sources.external import HttpReader, SqliteReader
from ..sources.readers import CsvReader, FrameReader, JsonReader, ListReader, SqlReader
from . import fixtures as fx
from .fixtures import Customer, OrderLine, as_of, table
from .pipeline import Pipeline

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# Hashing and mapping


@query(f"""SELECT c_custkey, {fx.sha("'{\"h\":[\"' || c_custkey || '\"]}'")} AS key_hash FROM customer""")
def hash_key_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-1, HSH-5."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", base64_view(HashSpec(c).include("c_custkey").column()).alias("key_hash"))


@query(f"""SELECT CustomerId, {fx.key_hash(1)} AS key_hash, {fx.change_hash(1)} AS change_hash FROM ({fx.F1})""")
def hash_change_all_seeded(spark, sf_dir):
    """HSH-2, HSH-3, HSH-4, HSH-6, PRJ-3."""
    m = fx.mapped(fx.source_customer(spark, sf_dir))
    return m.select(F.col("Id").alias("CustomerId"), base64_view(F.col("KeyHash")).alias("key_hash"), base64_view(F.col("ChangeHash")).alias("change_hash"))


@query("""SELECT event_id, to_base64(unhex(sha1('{"h":["' || event_id || '","' || event_type || '","' || strftime(ts, '%m/%d/%Y %H:%M:%S') || '"]}'))) AS event_hash FROM events""")
def hash_types_events(spark, sf_dir):
    """HSH-5 over a long, a text and a timestamp."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", base64_view(HashSpec(e).include("event_id", "event_type", "ts").column()).alias("event_hash"))


@query(f"SELECT CustomerId AS Id, CustomerId AS IntegrationId, CustomerName AS Name, Inactive, 7 AS Source, true AS IsActive, false AS IsDeleted FROM ({fx.F1})")
def mapper_projection(spark, sf_dir):
    """PRJ-1, PRJ-2, PRJ-8, PRJ-11."""
    m = Mapper(Customer).map("CustomerId", "Id").map("CustomerId", "IntegrationId").map("CustomerName", "Name").map("Inactive", "Inactive").constant("Source", 7)
    return m.apply(fx.source_customer(spark, sf_dir), as_of()).select("Id", "IntegrationId", "Name", "Inactive", "Source", "IsActive", "IsDeleted")


@query(f"SELECT CustomerId AS Id, upper(CustomerName) || '!' AS Name, 9 AS Source FROM ({fx.F1})")
def mapper_order_override(spark, sf_dir):
    """PRJ-4, PRJ-5, PRJ-6: later stages see and override earlier ones."""
    m = Mapper(Customer).map("CustomerId", "Id").map("Source", "Source").add_source("Name", lambda df: F.upper("CustomerName"))
    m.add_target("Name", lambda df: F.concat("Name", F.lit("!"))).constant("Source", 9)
    return m.apply(fx.source_customer(spark, sf_dir), as_of()).select("Id", "Name", "Source")


@query("SELECT p_partkey, repeat('*', length(p_name)) AS p_name FROM part")
def mapper_obfuscate(spark, sf_dir):
    """PRJ-14, through the mapper."""
    m = Mapper(fx.Part).map("p_partkey", "p_partkey").map("p_name", "p_name").obfuscate("p_name")
    return m.apply(table(spark, sf_dir, "part"), as_of()).select("p_partkey", "p_name")


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date_key FROM orders")
def date_keys_orders(spark, sf_dir):
    """PRJ-12."""
    return table(spark, sf_dir, "orders").select("o_orderkey", date_key(F.col("o_orderdate")).alias("date_key"))


_BACK, _QUOTE = "chr(92)", "chr(34)"


@query(
    f"""WITH v AS (SELECT c_custkey, c_name || {_BACK} AS a, CASE WHEN c_acctbal < 0 THEN NULL ELSE {_QUOTE} || c_mktsegment || chr(10) || c_name END AS b FROM customer),
 e AS (SELECT c_custkey, replace(a, {_BACK}, {_BACK} || {_BACK}) AS a, replace(replace(coalesce(b, ''), {_QUOTE}, {_BACK} || 'u0022'), chr(10), {_BACK} || 'n') AS b FROM v)
 SELECT c_custkey, to_base64(unhex(sha1('{{"h":["' || a || '","' || b || '"]}}'))) AS row_hash FROM e"""
)
def hash_escapes(spark, sf_dir):
    """HSH-3, HSH-5, HSH-6: backslashes, quotes, line breaks and NULL; one property taken out again."""
    v = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("\\")).alias("a"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit('"'), "c_mktsegment", F.lit("\n"), "c_name")).alias("b"))
    return v.select("c_custkey", base64_view(HashSpec(v).all().exclude("c_custkey").column()).alias("row_hash"))


@query("SELECT o_orderkey, to_base64(unhex(sha1('{\"h\":[\"' || strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') || ' ' || chr(92) || 'u002B00:00\"]}'))) AS day_hash FROM orders")
def hash_moments(spark, sf_dir):
    """HSH-5 over a moment in time, written in UTC whatever the session's zone."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.timestamp_seconds(F.unix_seconds(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("o_orderdate")).cast("timestamp"))).alias("day"))
    o = o.select("o_orderkey", "day")
    return o.select("o_orderkey", base64_view(HashSpec(o).include("day").column()).alias("day_hash"))


# Filters and SQL


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_name IS NULL")
def filter_expression(spark, sf_dir):
    """FLT-1 to FLT-4."""
    c = table(spark, sf_dir, "customer")
    return c.where((F.col("c_acctbal") > 0) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") | F.col("c_name").isNull()).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'")
def sql_passthrough_params(spark, sf_dir):
    """SRC-5, SRC-7, SRC-11, SRC-12, EXT-1, EXT-5, EXT-6."""
    reader = SqlReader("SELECT o_orderkey, o_custkey, o_totalprice FROM orders_v WHERE o_totalprice > @least AND o_orderstatus = @status", views={"orders_v": table(spark, sf_dir, "orders")})
    return ex.extract(spark, reader, [ExtractParameter("least", 5), ExtractParameter("@status", "O"), ExtractParameter("least", 1000)])


_CTE = """WITH mapping AS (SELECT n_nationkey, n_name, r_name FROM {nation} LEFT JOIN {region} ON n_regionkey = r_regionkey)
SELECT c_custkey, c_name, n_name, r_name FROM {customer} LEFT JOIN mapping ON c_nationkey = n_nationkey LEFT JOIN {supplier} ON s_suppkey = c_custkey WHERE s_suppkey IS NULL"""


@query(_CTE.format(nation="nation", region="region", customer="customer", supplier="supplier"))
def sql_cte_mapping_join(spark, sf_dir):
    """JN-7, FLT-4."""
    names = ("nation", "region", "customer", "supplier")
    return SqlReader(_CTE.format(**{n: f"{n}_v" for n in names}), views={f"{n}_v": table(spark, sf_dir, n) for n in names}).read(spark)


@query("SELECT 'low' AS kind, p_partkey FROM part WHERE p_retailprice < 950 UNION ALL SELECT 'big' AS kind, p_partkey FROM part WHERE p_size > 40")
def sql_commands_concat(spark, sf_dir):
    """SRC-8, SET-3."""
    commands = ["SELECT 'low' AS kind, p_partkey FROM part_v WHERE p_retailprice < 950", "SELECT 'big' AS kind, p_partkey FROM part_v WHERE p_size > 40"]
    return SqlReader(commands=commands, views={"part_v": table(spark, sf_dir, "part")}).read(spark)


# Pages


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def cursor_page_asc(spark, sf_dir):
    """EXT-3, LIM-1, SRT-1."""
    return ex.cursor_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 25)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 25")
def cursor_page_desc(spark, sf_dir):
    """EXT-3, EXT-7."""
    return ex.cursor_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 25, ex.DESC)


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS page_no FROM orders")
def cursor_all_pages(spark, sf_dir):
    """EXT-3, AGG-1: every page of a table in one scan."""
    o = ex.cursor_scan(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", -1)
    return ex.page_numbers(o, ["o_orderkey"], 1000)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 120")
def offset_page(spark, sf_dir):
    """EXT-4, LIM-2."""
    return ex.offset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 120, 40)


# Finds and dependent extracts


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def find_semi_join(spark, sf_dir):
    """JN-1."""
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return find(table(spark, sf_dir, "customer"), rows, ["c_custkey"], ["c_name"])


_NULLABLE = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey, c_acctbal FROM {c}"


@query(f"""WITH t AS ({_NULLABLE.format(c='customer')}), r AS (SELECT DISTINCT segment, c_nationkey FROM t WHERE c_acctbal < 0)
SELECT segment, c_nationkey, c_custkey FROM t WHERE EXISTS (SELECT 1 FROM r WHERE r.segment IS NOT DISTINCT FROM t.segment AND r.c_nationkey IS NOT DISTINCT FROM t.c_nationkey)""")
def find_null_safe_segment(spark, sf_dir):
    """JN-2."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), "c_nationkey", "c_acctbal")
    return find_null_safe(c, c.where("c_acctbal < 0"), ["segment", "c_nationkey"], ["c_custkey"])


@query("SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def find_composite(spark, sf_dir):
    """JN-1 on two fields."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    wanted = li.join(table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return find(li, wanted, ["l_orderkey", "l_partkey"], ["l_quantity"]).distinct()


@query(f"""SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_extendedprice FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {', '.join(fx.LINE_ORDER)}) AS rn FROM lineitem) ON l_orderkey = o_orderkey WHERE rn <= 2""")
def correlated_extract(spark, sf_dir):
    """JN-5, JN-6: the two dearest lines of each order."""
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem")
    return ex.correlated_top(o, li, {"o_orderkey": "l_orderkey"}, [F.col("l_extendedprice").desc(), *[F.col(c) for c in fx.LINE_ORDER]], 2, ["l_linenumber", "l_partkey", "l_extendedprice"])


@query("SELECT r_regionkey, n_nationkey FROM region, LATERAL (SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey LIMIT 2)")
def correlated_lateral(spark, sf_dir):
    """JN-5 as SQL."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation_v")
    r = table(spark, sf_dir, "region").select("r_regionkey")
    return ex.correlated_query(r, "SELECT n_nationkey FROM nation_v WHERE n_regionkey = input.r_regionkey ORDER BY n_nationkey LIMIT 2")


@query("SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def chained_extract(spark, sf_dir):
    """JN-6."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return ex.chained(o, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), {"o_orderkey": "l_orderkey"}).drop("l_orderkey")


@query("SELECT r_regionkey, r_name, 'row ' || (i + 1) AS label FROM region, range(3) t(i)")
def deferred_rows(spark, sf_dir):
    """JN-5 with an opaque source for each row, UDF-3, UDF-4."""
    return ex.deferred_rows(table(spark, sf_dir, "region"), lambda row: [row | {"label": f"row {i + 1}"} for i in range(3)], "r_regionkey int, r_name string, label string")


# Loads


@query(f"SELECT OrderLineId, OrderId, ProductId, Quantity FROM ({fx.F4_FIRST})")
def dedupe_first_wins(spark, sf_dir):
    """AGG-3."""
    return first_wins(fx.source_lines(spark, sf_dir), "OrderLineId", fx.LINE_ORDER).select("OrderLineId", "OrderId", "ProductId", "Quantity")


@query(f"""SELECT Id, Name FROM ({fx.F3}) UNION ALL SELECT CustomerId, CustomerName FROM ({fx.F2})""")
def load_default_append(spark, sf_dir):
    """LD-1, SET-1."""
    old = fx.existing_customer(spark, sf_dir)
    return load_default(Customer, fx.mapped(fx.changed_customer(spark, sf_dir)), old).next_state(["Id"]).select("Id", "Name")


@query(f"SELECT CustomerId AS Id, CustomerName AS Name FROM ({fx.F2}) WHERE Inactive")
def load_inline_inactive(spark, sf_dir):
    """LD-2, LD-6: a loader of the user's own, here of the inactive customers alone."""

    def own(rows, target):
        return load_default(Customer, rows.where("Inactive"), target)

    r = load_inline(Customer, fx.mapped(fx.changed_customer(spark, sf_dir)), fx.existing_customer(spark, sf_dir), own)
    return r.inserts.select("Id", "Name")


@query(f"""SELECT Id, Name FROM ({fx.F3}) UNION ALL SELECT CustomerId, CustomerName FROM ({fx.F2})""")
def table_sink_append(spark, sf_dir):
    """SNK-0, SNK-6, SNK-8, LD-1: two loads into a table; the second writes its own rows alone."""
    sink = TableSink(_temp(spark), Customer)
    sink.create(spark)
    sink.insert(fx.existing_customer(spark, sf_dir).drop("CustomerKey"), ["Id"])
    sink.insert(fx.mapped(fx.changed_customer(spark, sf_dir)).drop("CustomerKey"), ["Id"])
    return sink.read(spark).select("Id", "Name")


def _lines(spark, sf_dir):
    """First lines of each id as fact rows; the id is the order, as it is unique by then."""
    return fx.line_mapper().apply(fx.first_lines(spark, sf_dir), as_of())


@query(f"SELECT OrderLineId AS Id, OrderId, ProductId, Quantity FROM ({fx.F4_FIRST}) WHERE OrderLineId NOT IN (SELECT OrderLineId FROM ({fx.F5}))")
def load_transaction_fact(spark, sf_dir):
    """LD-3, JN-3, JN-4."""
    r = load_transaction(OrderLine, _lines(spark, sf_dir), fx.existing_lines(spark, sf_dir), ["Id"], as_of())
    return r.inserts.select("Id", "OrderId", "ProductId", "Quantity")


_SNAPSHOT = f"""SELECT n.OrderLineId AS Id, CASE WHEN t.OrderLineId IS NULL THEN 'insert' WHEN n.OrderLineId % 23 = 0 THEN 'delete' WHEN t.IsDeleted THEN 'undelete' WHEN t.Quantity <> n.Quantity THEN 'update' ELSE 'noop' END AS action,
 n.OrderId, n.ProductId, n.Quantity, t.Quantity AS old_quantity, t.IsDeleted AS old_deleted FROM ({fx.F4_FIRST}) n LEFT JOIN ({fx.F5}) t ON n.OrderLineId = t.OrderLineId"""


def _snapshot(spark, sf_dir):
    incoming = _lines(spark, sf_dir).withColumn("IsDeleted", F.col("Id") % 23 == 0)
    return load_snapshot(OrderLine, incoming, fx.existing_lines(spark, sf_dir), ["Id"], as_of())


@query(f"""SELECT {fx.sha("'{\"h\":[\"' || Id || '\"]}'")} AS key_hash, action, CASE action WHEN 'update' THEN 'Quantity,ChangeHash' WHEN 'insert' THEN '' WHEN 'noop' THEN '' ELSE 'IsDeleted' END AS changed FROM ({_SNAPSHOT})""")
def load_snapshot_actions(spark, sf_dir):
    """LD-4."""
    return _snapshot(spark, sf_dir).classified.select(base64_view(F.col("KeyHash")).alias("key_hash"), "action", F.array_join("changed", ",").alias("changed"))


@query(f"""WITH s AS ({_SNAPSHOT}) SELECT Id, CASE WHEN action IN ('insert', 'update') THEN Quantity ELSE old_quantity END AS Quantity,
 CASE action WHEN 'insert' THEN Id % 23 = 0 WHEN 'delete' THEN true WHEN 'undelete' THEN false ELSE old_deleted END AS IsDeleted FROM s
 UNION ALL SELECT OrderLineId, Quantity, IsDeleted FROM ({fx.F5}) WHERE OrderLineId NOT IN (SELECT Id FROM s)""")
def load_snapshot_next_state(spark, sf_dir):
    """LD-4, SNK-7."""
    return _snapshot(spark, sf_dir).next_state(["Id"]).select("Id", "Quantity", "IsDeleted")


def _scd_cte(incoming: str = fx.F2) -> str:
    return f"""WITH i AS ({fx.mapped_sql(incoming)}), t AS ({fx.F3}), m AS (SELECT i.*, t.CustomerKey, t.Name AS old_name, t.Inactive AS old_inactive, t.IsDeleted AS old_deleted, t.ToDate AS old_to,
 t.CustomerKey IS NOT NULL AND t.IsDeleted AS undelete, CASE WHEN t.CustomerKey IS NULL THEN 'insert' WHEN i.Name <> t.Name THEN 'type2' WHEN i.ChangeHash <> t.ChangeHash THEN 'type1' ELSE 'noop' END AS step
 FROM i LEFT JOIN t ON i.KeyHash = t.KeyHash)"""


@query(f"""{_scd_cte()} SELECT KeyHash AS key_hash, CustomerKey AS customer_key, CASE WHEN undelete THEN CASE step WHEN 'noop' THEN 'undelete' ELSE 'undelete+' || step END ELSE step END AS action,
 CASE WHEN undelete THEN CASE step WHEN 'noop' THEN 'IsDeleted,ToDate,ToDateKey' WHEN 'type2' THEN 'IsDeleted,ToDate,ToDateKey,IsActive' ELSE 'IsDeleted,ToDate,ToDateKey,Inactive,ChangeHash' END
 ELSE CASE step WHEN 'type2' THEN 'IsActive,ToDate,ToDateKey' WHEN 'type1' THEN 'Inactive,ChangeHash' ELSE '' END END AS changed FROM m""")
def scd2_merge_customer(spark, sf_dir):
    """LD-5: what each incoming row does. The flagship."""
    r = load_scd(Customer, fx.mapped(fx.changed_customer(spark, sf_dir)), fx.existing_customer(spark, sf_dir), ["Id"], as_of())
    return r.classified.select(base64_view(F.col("KeyHash")).alias("key_hash"), F.col("CustomerKey").alias("customer_key"), "action", F.array_join("changed", ",").alias("changed"))


_STATE = "CustomerKey, Id, Name, Inactive, IsActive, IsDeleted, FromDate, ToDate, ChangeHash"


@query(f"""{_scd_cte()}, new AS (SELECT row_number() OVER (ORDER BY Id) + (SELECT max(CustomerKey) FROM t) AS CustomerKey, Id, Name, Inactive, true AS IsActive, false AS IsDeleted,
 TIMESTAMP '2002-01-01' AS FromDate, CAST(NULL AS TIMESTAMP) AS ToDate, ChangeHash FROM m WHERE step IN ('insert', 'type2'))
SELECT {_STATE} FROM new UNION ALL
SELECT t.CustomerKey, t.Id, t.Name, CASE WHEN m.step = 'type1' THEN m.Inactive ELSE t.Inactive END, coalesce(m.step, '') <> 'type2', CASE WHEN m.undelete THEN false ELSE t.IsDeleted END, t.FromDate,
 CASE WHEN m.step = 'type2' THEN TIMESTAMP '2002-01-01' WHEN m.undelete THEN NULL ELSE t.ToDate END, CASE WHEN m.step = 'type1' THEN m.ChangeHash ELSE t.ChangeHash END
FROM t LEFT JOIN m ON m.CustomerKey = t.CustomerKey""")
def scd2_next_state(spark, sf_dir):
    """LD-5: the whole dimension after the load."""
    r = load_scd(Customer, fx.mapped(fx.changed_customer(spark, sf_dir)), fx.existing_customer(spark, sf_dir), ["Id"], as_of())
    return r.next_state(["Id"]).withColumn("ChangeHash", base64_view(F.col("ChangeHash"))).select(*_STATE.split(", "))


def _deletes(spark, sf_dir):
    old = fx.existing_customer(spark, sf_dir)
    gone = deleted_rows(old, fx.changed_customer(spark, sf_dir), {"Id": "CustomerId"})
    return old, gone.withColumn("IsDeleted", F.lit(True)).withColumn("Inactive", F.lit(True)), gone


@query(f"SELECT CustomerKey, Id FROM ({fx.F3}) WHERE NOT IsDeleted AND Id NOT IN (SELECT CustomerId FROM ({fx.F2}))")
def delete_detection(spark, sf_dir):
    """JN-8."""
    return _deletes(spark, sf_dir)[2].select("CustomerKey", "Id")


@query(f"""SELECT CustomerKey, Id, NOT IsDeleted AND Id % 13 = 0 OR Inactive AS Inactive, NOT (NOT IsDeleted AND Id % 13 = 0) AS IsActive, IsDeleted,
 CASE WHEN NOT IsDeleted AND Id % 13 = 0 THEN 20020101 WHEN IsDeleted THEN 20010101 END AS ToDateKey FROM ({fx.F3})""")
def scd2_delete_override(spark, sf_dir):
    """LD-5a, LD-5b."""
    old, gone, _ = _deletes(spark, sf_dir)
    r = load_scd(Customer, gone, old, ["Id"], as_of(), override_delete=True, fields_on_delete=("Inactive",))
    return r.next_state(["Id"]).select("CustomerKey", "Id", "Inactive", "IsActive", "IsDeleted", "ToDateKey")


@query(f"""SELECT CustomerKey, Id, IsActive, IsDeleted OR Id % 13 = 0 AS IsDeleted, CASE WHEN IsDeleted THEN 20010101 WHEN Id % 13 = 0 THEN 20020101 END AS ToDateKey FROM ({fx.F3})""")
def scd2_delete(spark, sf_dir):
    """LD-5 row 4."""
    old, gone, _ = _deletes(spark, sf_dir)
    return load_scd(Customer, gone, old, ["Id"], as_of()).next_state(["Id"]).select("CustomerKey", "Id", "IsActive", "IsDeleted", "ToDateKey")


@query(f"SELECT CustomerKey, Id, Name, false AS IsDeleted, CAST(NULL AS TIMESTAMP) AS ToDate FROM ({fx.F3}) WHERE IsDeleted")
def scd2_undelete(spark, sf_dir):
    """LD-5 row 5: rows that come back unchanged."""
    old = fx.existing_customer(spark, sf_dir)
    r = load_scd(Customer, fx.mapped(fx.source_customer(spark, sf_dir)), old, ["Id"], as_of())
    return r.updates.select("CustomerKey", "Id", "Name", "IsDeleted", "ToDate")


@query(f"""SELECT Id, Source, KeyHash AS key_hash FROM ({fx.mapped_sql(fx.F1)}) UNION ALL SELECT Id, Source, KeyHash FROM ({fx.mapped_sql(fx.F1.replace('1 AS Source', '2 AS Source'), 2)})""")
def scd2_two_sources_seeded(spark, sf_dir):
    """SET-2, HSH-4: the same ids from two sources stay apart."""
    a = fx.mapped(fx.source_customer(spark, sf_dir))
    b = fx.mapped(fx.source_customer(spark, sf_dir, 2), 2)
    first = load_scd(Customer, a, None, ["Id"], as_of())
    state = first.next_state(["Id"])
    return load_scd(Customer, b, state, ["Id"], as_of()).next_state(["Id"]).select("Id", "Source", base64_view(F.col("KeyHash")).alias("key_hash"))


@query(f"""SELECT CustomerId AS Id, row_number() OVER (ORDER BY CustomerId) + (SELECT max(CustomerKey) FROM ({fx.F3})) AS CustomerKey FROM ({fx.F1}) WHERE CustomerId % 10 = 0""")
def surrogate_key_assign(spark, sf_dir):
    """SNK-6."""
    new = fx.source_customer(spark, sf_dir).where("CustomerId % 10 = 0").select(F.col("CustomerId").alias("Id"))
    return assign_keys(new, fx.existing_customer(spark, sf_dir), "CustomerKey", ["Id"])


@query(f"""SELECT a.CustomerId, concat_ws(',', CASE WHEN a.CustomerName IS DISTINCT FROM b.CustomerName THEN 'CustomerName' END, CASE WHEN a.Inactive IS DISTINCT FROM b.Inactive THEN 'Inactive' END) AS changed FROM ({fx.F1}) a JOIN ({fx.F2}) b ON a.CustomerId = b.CustomerId""")
def changed_fields_list(spark, sf_dir):
    """FLT-7, D5."""
    a, b = fx.source_customer(spark, sf_dir).alias("a"), fx.changed_customer(spark, sf_dir).alias("b")
    both = a.join(b, F.col("a.CustomerId") == F.col("b.CustomerId"))
    return both.select(F.col("a.CustomerId").alias("CustomerId"), F.array_join(changed_fields(["CustomerName", "Inactive", "Source"], "a", "b"), ",").alias("changed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new name' ELSE p_name END AS p_name, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
def partial_update_case(spark, sf_dir):
    """SNK-7, D10."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("p_partkey")
    changed = F.array_compact(F.array(F.when(k % 4 == 0, F.lit("p_name")), F.when(k % 6 == 0, F.lit("p_size"))))
    updates = p.select("p_partkey", F.lit("new name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"), changed.alias("_changed")).where(F.size("_changed") > 0)
    return apply_updates(p, updates, "p_partkey")


# Tests, unions, lookups


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (p_size > 2)) AS failed, (SELECT string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FROM (SELECT p_partkey FROM part WHERE NOT (p_size > 2) ORDER BY p_partkey LIMIT 10)) AS first_ids FROM part")
def quality_test_counts(spark, sf_dir):
    """FLT-5, LIM-3, AGG-4."""
    got = report_test(table(spark, sf_dir, "part"), F.col("p_size") > 2, "p_partkey")
    return spark.createDataFrame([(got.rows, got.failed, ",".join(map(str, got.first_ids)))], "n_rows long, failed long, first_ids string")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (p_size > 2)) AS failed, count(*) AS inserted FROM part")
def pipeline_test_counts(spark, sf_dir):
    """FLT-5, AGG-4, ORC-1, ORC-2, SNK-2, UDF-1: a pipeline's tests and counters, into a sink that keeps nothing."""
    rows = FrameReader(lambda s, args: table(s, sf_dir, "part"))
    p = Pipeline.extract(rows).transform(lambda df: df.where("p_partkey >= 0")).test(F.col("p_size") > 2, "p_partkey")
    done = p.load(fx.Part, NullSink()).invoke(spark)
    return spark.createDataFrame([(p.outcomes[0].rows, p.outcomes[0].failed, done.inserted)], "n_rows long, failed long, inserted long")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def quality_ensure_pass(spark, sf_dir):
    """FLT-6."""
    return ensure(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice").isNotNull())


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def multi_source_union(spark, sf_dir):
    """SET-1, SET-2."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("origin"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin")))


@query(f"""{_scd_cte()}, d AS (SELECT row_number() OVER (ORDER BY Id) + (SELECT max(CustomerKey) FROM t) AS CustomerKey, Id FROM m WHERE step IN ('insert', 'type2')
 UNION ALL SELECT t.CustomerKey, t.Id FROM t LEFT JOIN m ON m.CustomerKey = t.CustomerKey WHERE coalesce(m.step, '') <> 'type2')
SELECT o_orderkey, o_custkey, CustomerKey FROM orders LEFT JOIN d ON Id = o_custkey""")
def lookup_active_version(spark, sf_dir):
    """JN-9 on a dimension with history: the active version of each customer."""
    r = load_scd(Customer, fx.mapped(fx.changed_customer(spark, sf_dir)), fx.existing_customer(spark, sf_dir), ["Id"], as_of())
    return lookup_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), r.next_state(["Id"]), {"o_custkey": "Id"}, "CustomerKey")


@query(f"SELECT o_orderkey, o_custkey, CustomerKey FROM orders LEFT JOIN ({fx.F3}) ON Id = o_custkey")
def fact_dimension_key_lookup(spark, sf_dir):
    """JN-9."""
    return lookup_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), fx.existing_customer(spark, sf_dir), {"o_custkey": "Id"}, "CustomerKey")


_BATCHES = "SELECT event_id, ts, user_id, event_type, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 1000) AS BIGINT) AS batch_no FROM events"


@query(f"""WITH f AS (SELECT * FROM ({_BATCHES}) QUALIFY row_number() OVER (PARTITION BY user_id, batch_no ORDER BY ts, event_id) = 1)
SELECT user_id, event_id, event_type, batch_no FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch_no DESC) = 1""")
def events_micro_batches(spark, sf_dir):
    """Micro-batches of a snapshot load: first wins in a batch, a later batch updates."""
    return fold_in_place(fx.micro_batches(spark, sf_dir), "user_id", "batch_no", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "batch_no")


@query("SELECT CAST(pos AS INT) AS pos, n_names FROM (SELECT rn - 1 AS pos, string_agg(n_name, ',' ORDER BY n_regionkey) AS n_names FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM nation) GROUP BY rn)")
def transpose_nations(spark, sf_dir):
    """AGG-8."""
    by = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return transpose(by, "n_regionkey", "names").select("pos", F.array_join("names", ",").alias("n_names"))


# Files and endpoints


def _temp(spark) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/cairn-{next(tempfile._get_candidate_names())}"


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size > 10")
def csv_roundtrip(spark, sf_dir):
    """SRC-2, SRC-13, SNK-3, FLT-1."""
    path = _temp(spark) + ".csv"
    CsvSink(path, fx.Part).insert(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"))
    return CsvReader(path, fx.Part, header=True, where="p_size > 10").read(spark)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def json_array_source(spark, sf_dir):
    """SRC-3, SRC-3a, FLT-2: a file that is one array."""
    path = _temp(spark) + ".json"
    n = table(spark, sf_dir, "nation")
    n.groupBy().agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).write.text(path)
    return JsonReader(path, "n_nationkey int, n_name string, n_regionkey int", where="n_regionkey = 1").read(spark).drop("n_regionkey")


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_header_order(spark, sf_dir):
    """SRC-2, SRC-2a: columns by the names in the header, which stand in another order and among others."""
    path = _temp(spark) + ".csv"
    table(spark, sf_dir, "part").select("p_size", "p_name", "p_brand", "p_retailprice", "p_partkey").write.csv(path, header=True)
    return CsvReader(path, fx.Part, header=True).read(spark)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size > 40")
def sqlite_roundtrip(spark, sf_dir):
    """SRC-5, SNK-4, SNK-8, SRC-11: a table of a SQLite file, for a single machine."""
    path = f"{tempfile.mkdtemp(prefix='cairn-')}/part.db"
    sink = SqliteSink(path, fx.Part)
    sink.create(spark)
    sink.insert(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").coalesce(1))
    return SqliteReader(path, 'SELECT * FROM "Part" WHERE p_size > @least', fx.Part).read(spark, [ExtractParameter("least", 40)])


@query("SELECT CAST(p_size AS INT) AS p_size, p_partkey FROM part WHERE p_size <> 7")
def bound_rows(spark, sf_dir):
    """SRC-9, SRC-10: texts as an entity's fields; rows with a size that is no number are left out, and counted."""
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") == 7, "seven").otherwise(F.col("p_size").cast("string")).alias("p_size"), F.col("p_retailprice").cast("string"))
    return SqlReader("SELECT * FROM raw", views={"raw": raw}, entity=fx.Part).read(spark).select("p_size", "p_partkey")


@query("SELECT * FROM (VALUES (1, 'Alice', 'Anderson'), (2, 'Bob', 'Brown')) t(\"Id\", \"First_Name\", \"Last_Name\")")
def list_source(spark, sf_dir):
    """SRC-1, EXT-2, SRC-12."""
    rows = ListReader([(1, "Alice", "Anderson"), (2, "Bob", "Brown")], "Id int, First_Name string, Last_Name string")
    return ex.extract_inline(spark, rows, lambda ctx, reader: reader.read(spark, ctx))


@query("SELECT e.k AS id, 'item ' || e.k AS name FROM range(25) e(k)")
def http_json_pages(spark, sf_dir):
    """SRC-4, EXT-4: pages of an opaque endpoint, one request after the other until an empty one."""
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Items) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        reader = HttpReader(f"http://127.0.0.1:{server.server_port}/items?offset=@Offset&limit=@BatchSize", "id bigint, name string")
        rows = [r for page in ex.pages(lambda params: [r.asDict() for r in reader.read(spark, params).collect()], ex.OffsetPager(), batch_size=10) for r in page]
        server.shutdown()
    return spark.createDataFrame(rows, "id bigint, name string")


class _Items(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        from urllib.parse import parse_qs, urlparse

        q = parse_qs(urlparse(self.path).query)
        low, n = int(q["offset"][0]), int(q["limit"][0])
        body = json.dumps([{"id": i, "name": f"item {i}"} for i in range(low, min(25, low + n))]).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
def frame_source_bound(spark, sf_dir):
    """SRC-0, SRC-9: rows bound to an entity through a reader."""
    reader = FrameReader(lambda s, args: table(s, sf_dir, "customer").where(F.col("c_nationkey") == args["nation"]))
    return ex.extract(spark, reader, [ExtractParameter("nation", 3)]).select("c_custkey", "c_mktsegment")
