"""Readers, pagers, finds, sinks."""

import http.server
import json
import sqlite3
import threading
from datetime import datetime
from typing import Annotated

import pytest
from pyspark.sql import functions as F

from cairn.entity import Bool, ColumnName, DateTime, Entity, Fact, ForeignKey, Identity, Int, Key, NotMapped, Required, String
from cairn.operators import extract as ex
from cairn.operators.find import deleted_rows, find, find_null_safe, lookup_key
from cairn.operators.merge import load_transaction
from cairn.params import ExtractParameter, context, get_value, rename_views, to_markers, user_parameter
from cairn.sinks import CatalogSink, CsvSink, ListSink, NullSink, SinkError, SqliteSink, TableSink
from cairn.sources import external
from cairn.sources.external import HttpReader, SqliteReader, fill_uri, get_json
from cairn.sources.readers import CsvReader, FrameReader, JdbcReader, JsonReader, ListReader, ParquetReader, SourceError, SqlReader, bind, file_path, literal, with_retry


class Item:
    Id: Annotated[Int, Key()]
    Name: Annotated[String, ColumnName("item_name")]
    Ok: Bool
    Note: Annotated[String, NotMapped()]


class Keyed(Fact):
    Key_: Annotated[Int, Key(), Identity()]
    Id: Int


class Child:
    Id: Annotated[Int, Key()]
    Parent: Annotated[Int, ForeignKey(Item)]
    Text: Annotated[String, Required()]


def items(spark, n=3):
    return spark.createDataFrame([(i, f"n{i}", i % 2 == 0) for i in range(n)], "Id int, Name string, Ok boolean")


def test_parameters():
    p = context(10, {"Id": 5, "a": 1}, [ExtractParameter("@a", 2)])
    assert [x.name for x in p] == ["BatchSize", "Id", "a", "a"]
    assert get_value(p, "a") == 1 and get_value(p, "none", 7) == 7 and get_value([ExtractParameter("x", None)], "x", 3) == 3
    assert ExtractParameter("x", 1) == ExtractParameter("@x", 1)
    with pytest.raises(ValueError):
        user_parameter("x", None)
    assert to_markers("SELECT '@no', @yes -- @no\n, \"@no\" FROM t WHERE a=@yes AND b = @b") == ("SELECT '@no', :yes -- @no\n, \"@no\" FROM t WHERE a=:yes AND b = :b", {"yes", "b"})
    assert [literal(x) for x in (None, True, 1, "it's")] == ["NULL", "1", "1", "'it''s'"]


def test_sql_reader(spark):
    views = {"items_v": items(spark)}
    reader = SqlReader("SELECT Id FROM items_v WHERE Id > @least AND Name <> '@least'", views=views)
    assert [r[0] for r in reader.read(spark, [ExtractParameter("least", 9), ExtractParameter("LEAST", 0)]).orderBy("Id").collect()] == [1, 2]
    with pytest.raises(SourceError):
        reader.read(spark, [])
    assert SqlReader(commands=["SELECT 1 AS a", "SELECT 2 AS a"]).read(spark).count() == 2
    with pytest.raises(SourceError):
        SqlReader()


def test_binding(spark):
    raw = spark.createDataFrame([("1", "a", "true"), ("x", "b", "true"), (None, "c", "false")], "id string, item_name string, ok string")
    good, bad = bind(raw, Item)
    assert [tuple(r) for r in good.collect()] == [(1, "a", True)]
    assert sorted((r["item_name"], r["_rejected"]) for r in bad.collect()) == [("b", ["Id"]), ("c", ["Id"])]
    with pytest.raises(SourceError):
        bind(raw.withColumn("more", F.lit(1)), Item)


def test_csv_files(spark, tmp_path):
    path = f"{tmp_path}/x.csv"
    sink = CsvSink(path, Item)
    sink.insert(items(spark))
    sink.insert(items(spark, 1))
    assert sink.read(spark).count() == 4
    assert "item_name" in next(tmp_path.glob("x.csv/part-*")).read_text().splitlines()[0]
    with pytest.raises(SinkError):
        sink.update(items(spark), "Id")
    assert sink.find(spark, items(spark, 1), ["Id"], ["Name"]).count() == 2
    plain = tmp_path / "plain.csv"
    plain.write_text("1,a\n2,b\n")
    assert CsvReader(str(plain), "Id int, Name string").read(spark).count() == 2
    assert CsvReader(str(plain), "Id int, Name string", where="Id > 1").read(spark).count() == 1
    with pytest.raises(SourceError):
        file_path("/tmp/noextension")


def test_json_files(spark, tmp_path):
    def read(text, where=None):
        path = tmp_path / f"{abs(hash(text))}.json"
        path.write_text(text)
        return [tuple(r) for r in JsonReader(str(path), "Id int, Name string, Parts array<int>", where=where).read(spark).collect()]

    assert read('[{"Id": 1, "Name": "a", "Parts": [1, 2]}, {"Id": 2}]') == [(1, "a", [1, 2]), (2, None, None)]
    assert read('{"Id": 1, "Name": "x\\\\\\"y"}') == [(1, 'x\\"y', None)]
    assert read("[]") == []
    assert read('[{"Id": 1}, {"Id": 2}]', "Id = 2") == [(2, None, None)]
    with pytest.raises(Exception):
        read('[{"Id": "word"}]')


def test_cursor_pages():
    data = [{"Id": i} for i in range(1, 26)]
    asked = []

    def fetch(params):
        after, n = get_value(params, "Id", 0), get_value(params, "BatchSize")
        asked.append(after)
        return [r for r in data if r["Id"] > after][:n]

    got = list(ex.pages(fetch, ex.CursorPager("Id"), "Id", 10))
    assert [len(p) for p in got] == [10, 10, 5] and asked == [0, 10, 20, 25]
    assert list(ex.pages(lambda p: [], ex.CursorPager("Id"), "Id", 10)) == []
    with pytest.raises(ex.PaginationError):
        list(ex.pages(lambda p: [{"Id": 3}], ex.CursorPager("Id"), "Id", 10))
    down = ex.CursorPager("Id", 9, ex.DESC)
    down.add([2, 1, None])
    assert down.value == 1 and down.total == 2
    down.add([None])
    assert down.done
    assert ex.CursorPager("s", kind=str).value == " "
    with pytest.raises(ValueError):
        ex.CursorPager("d", kind=datetime)


def test_offset_pages():
    data = [{"Id": i} for i in range(25)]
    got = list(ex.pages(lambda p: data[get_value(p, "Offset", 0) :][:10], ex.OffsetPager(), None, 10))
    assert [len(p) for p in got] == [10, 10, 5]
    down = ex.OffsetPager(5, ex.DESC)
    down.add(range(5))
    assert down.value == 0


def test_pages_of_tables(spark):
    df = spark.range(25).withColumnRenamed("id", "Id")
    assert sorted(r["page_no"] for r in ex.page_numbers(df, ["Id"], 10).collect()) == [0] * 10 + [1] * 10 + [2] * 5
    assert [r[0] for r in ex.cursor_page(df, "Id", 10, 2, ex.DESC).collect()] == [9, 8]
    assert ex.cursor_scan(df, "Id", 20).count() == 4
    assert [r[0] for r in ex.offset_page(df, ["Id"], 23, 10).collect()] == [23, 24]


def test_dependent_extracts(spark):
    outer = spark.createDataFrame([(i,) for i in range(1, 6)], "OrderId int")
    inner = spark.range(1, 6).withColumnRenamed("id", "n")
    assert ex.correlated_query(outer, "SELECT n FROM VALUES (1), (2), (3), (4), (5) t(n)", "orders_in").count() == 25
    assert ex.deferred_rows(outer, lambda r: [{"OrderId": r["OrderId"], "n": i} for i in range(5)], "OrderId int, n int").count() == 25
    assert ex.chained(outer, inner, {"OrderId": "n"}).count() == 5
    rows = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, 1)], "k int, v int")
    top = ex.correlated_top(outer, rows, {"OrderId": "k"}, [F.col("v").desc()], 2, ["v"])
    assert sorted(map(tuple, top.collect())) == [(1, 6), (1, 7), (2, 1)]


def test_finds(spark):
    t = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "a int, b string")
    k = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "a int, b string")
    assert [r["a"] for r in find(t, k, ["a", "b"]).collect()] == [2]
    assert sorted(r["a"] for r in find_null_safe(t, k, ["a", "b"]).collect()) == [1, 2]
    assert lookup_key(spark.createDataFrame([(2,), (9,)], "x int"), t, {"x": "a"}, "b", "name").orderBy("x").collect()[1]["name"] is None
    target = t.withColumn("IsDeleted", F.col("a") == 3)
    assert [r["a"] for r in deleted_rows(target, k.where("a = 2"), {"a": "a"}).collect()] == [1]


def test_table_versions(spark, tmp_path):
    sink = TableSink(f"file://{tmp_path}/t", Keyed)
    sink.create(spark)
    sink.create(spark)
    assert sink.version(spark) == 1 and sink.read(spark).count() == 0
    rows = spark.createDataFrame([(bytearray(b"a"), 7), (bytearray(b"b"), 8)], "KeyHash binary, Id int")
    for _ in range(2):
        sink.commit(spark, load_transaction(Keyed, rows, sink.read(spark), ["Id"], F.current_timestamp()), ["Id"])
    assert sorted((r["Key_"], r["Id"]) for r in sink.read(spark).collect()) == [(1, 7), (2, 8)]
    sink.update(sink.read(spark).where("Id = 7").withColumn("Id", F.lit(9)).withColumn("_changed", F.array(F.lit("Id"))), "Key_")
    assert sorted(r["Id"] for r in sink.read(spark).collect()) == [8, 9]
    assert sink.find(spark, spark.createDataFrame([(8,)], "Id int"), ["Id"], ["Key_"]).first()["Key_"] == 2
    version = sink.version(spark)
    with pytest.raises(Exception):
        sink.replace(sink.read(spark).where(F.assert_true(F.lit(False)).isNull()))
    assert sink.version(spark) == version and sink.read(spark).count() == 2
    sink.vacuum(spark, keep=1)
    assert [p.name for p in tmp_path.glob("t/_versions/*") if p.name.isdigit()] == [str(version)]
    assert sink.read(spark).count() == 2
    sink.truncate(spark)
    assert sink.read(spark).count() == 0


def test_a_load_that_is_cut_off_changes_nothing(spark, tmp_path, monkeypatch):
    sink = TableSink(f"file://{tmp_path}/t", Keyed)
    sink.insert(spark.range(40).select(F.col("id").cast("int").alias("Id")), ["Id"])
    before = sink.read(spark).collect()
    with monkeypatch.context() as m:
        m.setattr(TableSink, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError):
            sink.insert(spark.createDataFrame([(99,)], "Id int"), ["Id"])
    assert sink.version(spark) == 1 and sorted(sink.read(spark).collect()) == sorted(before)
    # A version is written once: a load that has read the same one fails.
    with pytest.raises(SinkError):
        sink._publish(spark, 1, {"parts": [], "batches": {}})
    assert sink.read(spark).count() == 40


def test_a_load_writes_the_buckets_that_it_touches(spark, tmp_path):
    sink = TableSink(f"file://{tmp_path}/t", Keyed, buckets=8)
    sink.insert(spark.range(200).select(F.col("id").cast("int").alias("Id")), ["Id"])
    first = {tuple(p) for p in sink._list(spark, 1)["parts"]}
    assert len(first) == 8
    sink.insert(spark.createDataFrame([(500,)], "Id int"), ["Id"], batch=("s", 4))
    second = {tuple(p) for p in sink._list(spark, 2)["parts"]}
    assert first < second and len(second) == 9 and sink.last_batch(spark, "s") == 4 and sink.last_batch(spark, "t") == -1
    one = sink.read(spark).where("Key_ = 7").withColumn("Id", F.lit(-1)).withColumn("_changed", F.array(F.lit("Id")))
    sink.update(one, "Key_")
    third = {tuple(p) for p in sink._list(spark, 3)["parts"]}
    assert len(third - second) == 1 and len(second - third) in (1, 2) and sink.last_batch(spark, "s") == 4
    got = {r["Key_"]: r["Id"] for r in sink.read(spark).collect()}
    assert len(got) == 201 and got[7] == -1 and got[201] == 500 and got[8] == 7
    sink.vacuum(spark, keep=1)
    assert sink.read(spark).count() == 201


def test_csv_columns_go_by_their_names(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("name, ID ,more\nAlice,1,x\nBob,2,y\n")
    assert [tuple(r) for r in CsvReader(str(path), "id int, name string", header=True).read(spark).orderBy("id").collect()] == [(1, "Alice"), (2, "Bob")]
    other = tmp_path / "items.csv"
    other.write_text("Ok,item_name,Id\ntrue,a,1\n")
    assert [tuple(r) for r in CsvReader(str(other), Item, header=True).read(spark).collect()] == [(1, "a", True)]
    with pytest.raises(SourceError, match="Id"):
        CsvReader(str(path), "id int, name string, Id2 int", header=True).read(spark)


def test_values_go_in_once(spark):
    reader = JdbcReader("jdbc:none", "SELECT * FROM t WHERE note = 'at :a @a' AND x = @a AND y = @b -- @a")
    assert reader.sql([ExtractParameter("a", "@b :b it's"), ExtractParameter("b", datetime(2020, 1, 2, 3))]) == "SELECT * FROM t WHERE note = 'at :a @a' AND x = '@b :b it''s' AND y = '2020-01-02 03:00:00' -- @a"
    with pytest.raises(SourceError):
        reader.sql([ExtractParameter("a", 1)])
    assert literal(bytearray(b"\x01\xff")) == "X'01ff'"
    tried, waits = [], []
    with pytest.raises(ValueError):
        with_retry(lambda: tried.append(1) or int("x"), sleep=waits.append)
    assert len(tried) == 5 and waits == [1, 2, 4, 8]
    assert with_retry(lambda: tried.append(1) or len(tried), sleep=waits.append) == 6
    assert rename_views("SELECT a.x, 'a', \"a\" FROM a -- a\n, aa WHERE @a", {"a": "b1"}) == "SELECT b1.x, 'a', \"a\" FROM b1 -- a\n, aa WHERE @a"


def test_rows_left_out_are_counted(spark, caplog):
    raw = spark.createDataFrame([("1", "a", "true"), ("x", "b", "true")], "id string, item_name string, ok string")
    reader = SqlReader("SELECT * FROM raw", views={"raw": raw}, entity=Item)
    assert reader.read(spark).count() == 1 and reader.report() == 1
    assert "1 of 2 rows" in caplog.text and reader.rejected.count() == 1


def test_lookups_take_one_version(spark):
    dim = spark.createDataFrame([(1, 7, datetime(2000, 1, 1), datetime(2001, 1, 1), False), (2, 7, datetime(2001, 1, 1), None, True)], "CustomerKey int, Id int, FromDate timestamp_ntz, ToDate timestamp_ntz, IsActive boolean")
    facts = spark.createDataFrame([(7, datetime(2000, 6, 1)), (7, datetime(2001, 1, 1)), (8, datetime(2001, 1, 1))], "Id int, day timestamp_ntz")
    assert sorted((r["Id"], r["day"].year, r["CustomerKey"]) for r in lookup_key(facts, dim, {"Id": "Id"}, "CustomerKey").collect() if r["Id"] == 7) == [(7, 2000, 2), (7, 2001, 2)]
    got = lookup_key(facts, dim, {"Id": "Id"}, "CustomerKey", at="day").collect()
    assert sorted((r["Id"], r["day"].year, r["CustomerKey"] or 0) for r in got) == [(7, 2000, 1), (7, 2001, 2), (8, 2001, 0)]


def test_plain_sinks(spark, tmp_path):
    out: list = []
    ListSink(out).insert(items(spark))
    assert len(out) == 3
    with pytest.raises(NotImplementedError):
        ListSink(out).find(spark, items(spark), ["Id"])
    NullSink().insert(items(spark))
    assert NullSink().find(spark, items(spark), ["Id"]).count() == 0
    assert ListReader([(1, "a", True)], Item).read(spark).first()["Name"] == "a"
    assert FrameReader(lambda s, args: s.range(args["n"])).read(spark, [ExtractParameter("n", 4)]).count() == 4
    items(spark).write.parquet(f"{tmp_path}/p.parquet")
    assert ParquetReader(f"{tmp_path}/p.parquet", ["Id"], "Id > 0").read(spark).columns == ["Id"]
    spark.sql("DROP TABLE IF EXISTS cat_items")
    cat = CatalogSink("cat_items", Item)
    cat.create(spark)
    cat.insert(items(spark))
    assert cat.read(spark).count() == 3
    cat.truncate(spark)
    assert cat.execute(spark, "SELECT count(*) FROM cat_items").first()[0] == 0
    spark.sql("DROP TABLE cat_items")


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    sink = SqliteSink(path, Item)
    sink.create(spark)
    sink.insert(items(spark, 25).coalesce(1))
    assert sink.read(spark).count() == 25
    got = SqliteReader(path, "SELECT Id, item_name AS Name FROM Item WHERE Id >= @low", "Id int, Name string", partition=("Id", 0, 25, 3)).read(spark, [ExtractParameter("low", 10)])
    assert got.rdd.getNumPartitions() == 3 and got.count() == 15
    change = items(spark, 2).withColumn("Name", F.lit("new")).withColumn("_changed", F.array(F.lit("Name")))
    sink.update(change.coalesce(1), "Id")
    assert sink.read(spark).where("Name = 'new'").count() == 2
    assert sink.execute("DELETE FROM Item WHERE Id > 20") == 4
    sink.truncate()
    assert sink.read(spark).count() == 0
    SqliteSink(path, Child).create(spark)
    with sqlite3.connect(path) as con:
        ddl = con.execute("SELECT sql FROM sqlite_master WHERE name = 'Child'").fetchone()[0]
    assert 'REFERENCES "Item" ("Id")' in ddl and "NOT NULL" in ddl and "length" in ddl
    assert Entity.of(Child).foreign_keys[0].name == "Parent"


def test_http(spark, monkeypatch):
    failures = {"n": 2}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/flaky" and failures["n"]:
                failures["n"] -= 1
                self.send_error(503)
                return
            if self.path == "/missing":
                self.send_error(404)
                return
            body = {"/one": {"id": 1, "name": "a"}, "/wrong": [{"id": "x"}]}.get(self.path, [{"ID": 2, "more": 0}, {"id": 3, "name": "c"}])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setattr(external.time, "sleep", lambda s: None)
    assert len(get_json(base + "/flaky")) == 2
    with pytest.raises(Exception):
        get_json(base + "/missing")
    schema = "id bigint, name string"
    assert [tuple(r) for r in HttpReader(base + "/one", schema).read(spark).collect()] == [(1, "a")]
    both = HttpReader([base + "/one", base + "/@Page"], schema).read(spark, [ExtractParameter("Page", "list")])
    assert sorted(map(tuple, both.collect()), key=str) == [(1, "a"), (2, None), (3, "c")]
    with pytest.raises(Exception):
        HttpReader(base + "/wrong", schema, base=0).read(spark).collect()
    server.shutdown()
    assert fill_uri("/a?x=@Id&y=@IdX", {"Id": 1, "IdX": "b c"}) == "/a?x=1&y=b%20c"


def test_dates_in_sqlite(spark, tmp_path):
    class Dated:
        pass

    Dated.__annotations__ = {"Id": Annotated[Int, Key()], "At": DateTime}
    sink = SqliteSink(f"{tmp_path}/d.db", Dated)
    sink.create(spark)
    sink.insert(spark.createDataFrame([(1, datetime(2020, 1, 2, 3, 4, 5))], "Id int, At timestamp_ntz").coalesce(1))
    assert sink.read(spark).first()["At"] == datetime(2020, 1, 2, 3, 4, 5)
