"""Loaders: decision tables, next states, keys."""

from typing import Annotated

import pytest
from pyspark.sql import functions as F

from cairn.entity import Date, Dimension, Fact, Identity, Int, Key, String, Type2
from cairn.operators.mapper import Mapper, MappingError
from cairn.operators.merge import fold_batches, fold_in_place, load_default, load_inline, load_scd, load_snapshot, load_transaction
from cairn.operators.surrogate import global_rank
import cairn.operators.surrogate as surrogate


class Customer(Dimension):
    CustomerKey: Annotated[Int, Key(), Identity()]
    Id: Int
    Name: Annotated[String | None, Type2()]
    DateOfBirth: Date | None


class Line(Fact):
    LineKey: Annotated[Int, Key(), Identity()]
    Id: Int
    Quantity: Int


def clock(day="2002-01-01"):
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def people(spark, *rows, **fixed):
    df = spark.createDataFrame(list(rows), "Id int, Name string, DateOfBirth string").withColumn("DateOfBirth", F.to_date("DateOfBirth"))
    m = Mapper(Customer).map("Id", "Id").map("Name", "Name").map("DateOfBirth", "DateOfBirth")
    m.hash("KeyHash", lambda h: h.include("Id")).hash("ChangeHash", lambda h: h.include("Name", "DateOfBirth"))
    out = m.apply(df, clock("2001-01-01"))
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()})


ALICE, BOB = (1, "Alice", "2000-01-01"), (2, "Bob", "1970-01-01")


@pytest.fixture(scope="module")
def dimension(spark):
    return load_scd(Customer, people(spark, ALICE, BOB), None, ["Id"], clock("2001-01-01")).next_state(["Id"]).cache()


def actions(result):
    return {r["CustomerKey"] if r["CustomerKey"] else "new": (r["action"], r["changed"]) for r in result.classified.collect()}


def test_same_rows_change_nothing(spark, dimension):
    r = load_scd(Customer, people(spark, ALICE, BOB), dimension, ["Id"], clock())
    assert actions(r) == {1: ("noop", []), 2: ("noop", [])}
    assert r.inserts.count() == r.updates.count() == 0


def test_type_1(spark, dimension):
    r = load_scd(Customer, people(spark, (1, "Alice", "1999-01-01"), BOB), dimension, ["Id"], clock())
    assert actions(r)[1] == ("type1", ["DateOfBirth", "ChangeHash"])
    state = r.next_state(["Id"])
    assert state.count() == 2 and str(state.where("Id = 1").first()["DateOfBirth"]) == "1999-01-01"


def test_type_2_with_type_1(spark, dimension):
    r = load_scd(Customer, people(spark, (1, "Alicia", "1999-01-01")), dimension, ["Id"], clock())
    assert actions(r)[1] == ("type2", ["IsActive", "ToDate", "ToDateKey"])
    rows = r.next_state(["Id"]).where("Id = 1").orderBy("CustomerKey").collect()
    assert [(x["Name"], str(x["DateOfBirth"]), x["IsActive"], x["ToDateKey"]) for x in rows] == [("Alice", "2000-01-01", False, 20020101), ("Alicia", "1999-01-01", True, None)]
    assert rows[0]["KeyHash"] == rows[1]["KeyHash"] and rows[1]["CustomerKey"] == 3


def test_delete_undelete(spark, dimension):
    r = load_scd(Customer, people(spark, ALICE, IsDeleted=True), dimension, ["Id"], clock())
    assert actions(r)[1] == ("delete", ["IsDeleted", "ToDate", "ToDateKey"])
    gone = r.next_state(["Id"]).cache()
    assert gone.where("IsDeleted and ToDate is not null").count() == 1
    again = load_scd(Customer, people(spark, ALICE, IsDeleted=True), gone, ["Id"], clock())
    assert actions(again)[1][0] == "noop"
    back = load_scd(Customer, people(spark, ALICE), gone, ["Id"], clock())
    assert actions(back)[1] == ("undelete", ["IsDeleted", "ToDate", "ToDateKey"])
    assert back.next_state(["Id"]).where("not IsDeleted and ToDate is null").count() == 2
    changed = load_scd(Customer, people(spark, (1, "Alicia", "2000-01-01")), gone, ["Id"], clock())
    assert actions(changed)[1][0] == "undelete+type2" and changed.updates.first()["_updates"] == 2
    row = changed.next_state(["Id"]).where("CustomerKey = 1").first()
    assert (row["IsDeleted"], row["IsActive"], row["ToDateKey"]) == (False, False, 20020101)


def test_delete_by_inactive_and_recreate(spark, dimension):
    changed = people(spark, (1, "Alice", "1980-01-01"), IsDeleted=True)
    r = load_scd(Customer, changed, dimension, ["Id"], clock(), override_delete=True, fields_on_delete=("DateOfBirth",))
    assert actions(r)[1] == ("delete", ["IsActive", "ToDate", "ToDateKey", "DateOfBirth"])
    gone = r.next_state(["Id"]).cache()
    row = gone.where("Id = 1").first()
    assert (row["IsDeleted"], row["IsActive"], str(row["DateOfBirth"])) == (False, False, "1980-01-01")
    back = load_scd(Customer, people(spark, ALICE, BOB), gone, ["Id"], clock()).next_state(["Id"])
    assert back.count() == 3 and back.where("IsActive").count() == 2


def test_first_row_of_a_key_wins(spark, dimension):
    rows = people(spark, (1, "B", None), (1, "A", None), (3, "C", None))
    r = load_scd(Customer, rows, dimension, ["Name"], clock())
    assert r.inserts.where("Id = 1").first()["Name"] == "A" and r.inserts.where("Id = 3").count() == 1


def test_interrupted_version_is_put_right(spark, dimension):
    """A closed row without its successor: the next load inserts one."""
    closed = dimension.withColumn("IsActive", F.col("Id") != 1)
    state = load_scd(Customer, people(spark, (1, "Alicia", "2000-01-01")), closed, ["Id"], clock()).next_state(["Id"])
    assert state.where("Id = 1").count() == 2 and state.where("Id = 1 and IsActive").count() == 1


def test_only_the_hash_differs(spark, dimension):
    stale = people(spark, ALICE).withColumn("ChangeHash", F.lit(b"other"))
    assert actions(load_scd(Customer, stale, dimension, ["Id"], clock()))[1] == ("noop", [])


def test_missing_key(spark, dimension):
    broken = dimension.withColumn("CustomerKey", F.lit(None).cast("int"))
    assert {r["action"] for r in load_scd(Customer, people(spark, ALICE), broken, ["Id"], clock()).classified.collect()} == {"no_key"}


def test_loads_are_idempotent_and_keep_one_active_row(spark, dimension):
    incoming = people(spark, (1, "Alicia", "1999-01-01"), (2, "Bob", "1971-01-01"), (3, "Cleo", None))
    once = load_scd(Customer, incoming, dimension, ["Id"], clock()).next_state(["Id"]).cache()
    twice = load_scd(Customer, incoming, once, ["Id"], clock()).next_state(["Id"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.where("IsActive").groupBy("KeyHash").count().where("count > 1").count() == 0


def lines(spark, *rows, **fixed):
    df = spark.createDataFrame(list(rows), "Id int, Quantity int")
    m = Mapper(Line).map("Id", "Id").map("Quantity", "Quantity").hash("KeyHash", lambda h: h.include("Id")).hash("ChangeHash", lambda h: h.all())
    return m.apply(df, clock()).withColumns({k: F.lit(v) for k, v in fixed.items()})


def snapshot_actions(r):
    return {x["LineKey"]: (x["action"], x["changed"]) for x in r.classified.collect()}


def test_snapshot_table(spark):
    state = load_snapshot(Line, lines(spark, (1, 1), (2, 2), (2, 3)), None, ["Quantity"], clock()).next_state(["Id"]).cache()
    assert state.count() == 2
    r = load_snapshot(Line, lines(spark, (1, 5), (2, 2), (3, 3)), state, ["Id"], clock())
    assert snapshot_actions(r) == {1: ("update", ["Quantity", "ChangeHash"]), 2: ("noop", []), None: ("insert", [])}
    state = r.next_state(["Id"]).cache()
    gone = load_snapshot(Line, lines(spark, (1, 5), IsDeleted=True), state, ["Id"], clock())
    assert snapshot_actions(gone)[1] == ("delete", ["IsDeleted"])
    state = gone.next_state(["Id"]).cache()
    assert state.where("IsDeleted").count() == 1
    assert snapshot_actions(load_snapshot(Line, lines(spark, (1, 5), IsDeleted=True), state, ["Id"], clock()))[1][0] == "delete"
    back = load_snapshot(Line, lines(spark, (1, 9)), state, ["Id"], clock())
    assert snapshot_actions(back)[1] == ("undelete", ["IsDeleted"])
    state = back.next_state(["Id"]).cache()
    assert state.where("Id = 1").first()["Quantity"] == 5
    assert load_snapshot(Line, lines(spark, (1, 9)), state, ["Id"], clock()).next_state(["Id"]).where("Id = 1").first()["Quantity"] == 9
    new_deleted = load_snapshot(Line, lines(spark, (8, 1), IsDeleted=True), state, ["Id"], clock())
    assert snapshot_actions(new_deleted)[None][0] == "insert"


def test_transactions_only_insert(spark):
    state = load_transaction(Line, lines(spark, (1, 1)), None, ["Id"], clock()).next_state(["Id"])
    r = load_transaction(Line, lines(spark, (1, 9), (2, 2), (2, 3)), state, ["Quantity"], clock())
    assert [(x["Id"], x["Quantity"]) for x in r.inserts.collect()] == [(2, 2)] and r.updates is None
    assert r.next_state(["Id"]).where("Id = 1").first()["Quantity"] == 1
    assert load_default(Line, lines(spark, (1, 1), (1, 1))).inserts.count() == 2
    assert load_inline(Line, lines(spark, (1, 1)), None, lambda rows, t: load_default(Line, rows)).inserts.count() == 1


def test_batches_fold(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 4, 1), (2, 4, 2)], "Id int, Quantity int, b int")
    hashed = lines(spark, (0, 0)).limit(0)
    m = Mapper(Line).map("Id", "Id").map("Quantity", "Quantity").hash("KeyHash", lambda h: h.include("Id")).hash("ChangeHash", lambda h: h.all())
    parts = [m.apply(rows.where(F.col("b") == b).drop("b"), clock()).withColumn("b", F.lit(b)) for b in range(3)]
    incoming = parts[0].unionByName(parts[1]).unionByName(parts[2])
    state = fold_batches(Line, incoming, hashed, "b", ["Quantity"], load_snapshot, ["Id"], lambda df, b: df.cache(), as_of=clock())
    direct = fold_in_place(rows, "Id", "b", ["Quantity"])
    assert sorted((r["Id"], r["Quantity"]) for r in state.collect()) == sorted((r["Id"], r["Quantity"]) for r in direct.collect()) == [(1, 3), (2, 4)]


@pytest.mark.parametrize("bucket", [3, 10**6])
def test_ranks_are_consecutive(spark, monkeypatch, bucket):
    monkeypatch.setattr(surrogate, "BUCKET_ROWS", bucket)
    df = spark.createDataFrame([(None, "z"), *[(i * 7 % 50, f"n{i % 9}") for i in range(50)]], "k int, s string")
    for keys in (["k", "s"], ["s", "k"]):
        got = [tuple(r[k] for k in keys) for r in global_rank(df, keys).orderBy("rank").collect()]
        assert got == sorted(got, key=lambda t: tuple((x is not None, x) for x in t))
        assert sorted(r["rank"] for r in global_rank(df, keys).collect()) == list(range(1, 52))


def test_mapper_rules(spark):
    df = spark.createDataFrame([(1, "a")], "Id int, Name string")
    with pytest.raises(MappingError):
        Mapper(Customer).map("Name", "Id").apply(df)
    with pytest.raises(MappingError):
        Mapper(Customer).map("Nope", "Id").apply(df)
    with pytest.raises(MappingError):
        Mapper(Customer, Customer).map("Id", "Id").apply(df)
    row = Mapper(Customer).map("Id", "Id").add_source("Name", F.upper("Name")).add_target("Name", lambda d: F.concat("Name", F.lit("!"))).obfuscate("Name").apply(df, clock()).first()
    assert (row["Name"], row["IsActive"], row["IsDeleted"], row["FromDate"].year) == ("**", True, False, 2002)
    same = Mapper(Customer, Customer).constant("Name", "X").apply(people(spark, ALICE)).first()
    assert same["Name"] == "X"


def test_a_merge_shuffles_by_key_hash_only(spark, dimension):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held = spark.createDataFrame(dimension.collect(), dimension.schema)
        r = load_transaction(Customer, people(spark, ALICE).repartition(3), held, ["Id"], clock())
        plan = r.inserts._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(KeyHash") == 2 and "Python" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
