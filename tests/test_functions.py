"""Hashing, comparison and entity rules."""

import base64
import hashlib
from datetime import date, datetime
from decimal import Decimal as D
from typing import Annotated

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.entity import (
    Bytes,
    ColumnName,
    DateTime,
    Decimal,
    Dimension,
    Entity,
    EntityError,
    ForeignKey,
    Identity,
    Int,
    Key,
    MaxLength,
    NotMapped,
    Precision,
    Required,
    RowVersion,
    String,
    Type2,
)
from cairn.functions.hashing import HashSpec, base64_view
from cairn.functions.scalars import changed_fields, chunk_by_sum, date_key, field_equals, obfuscate, transpose


class Principal:
    Id: Annotated[Int, Key()]


class Person(Dimension):
    Id: Annotated[Int, Key(), Identity()]
    First: Annotated[String | None, ColumnName("FirstName"), Type2(), MaxLength(5)]
    Born: DateTime | None
    Pay: Annotated[Decimal, Precision(10, 4)]
    Code: Annotated[String, Required()]
    Owner: Annotated[Int, ForeignKey(Principal)]
    Note: Annotated[String, NotMapped()]
    Others: list


class Composite:
    Name: Annotated[String, Key()]
    Id: Annotated[Int, Key()]


class Ordered:
    Id: Annotated[Int, Key(2)]
    Name: Annotated[String, Key(1)]


class BadVersion:
    Id: Annotated[Int, Key()]
    Stamp: Annotated[Int, RowVersion()]


class GoodVersion:
    Id: Annotated[Int, Key()]
    Stamp: Annotated[Bytes, RowVersion()]


@pytest.fixture(scope="module")
def person(spark):
    return spark.createDataFrame([(1, "Alice", "Anderson")], "Id int, First_Name string, Last_Name string")


@pytest.mark.parametrize(
    "names,golden",
    [(["Id"], "2kN1yKJgI+jtps3pmLygD+Dy1Vo="), (["Id", "First_Name", "Last_Name"], "Uubl482Z1ceGadgqYgFFAspmcOg="), (["Id", "Last_Name"], "lCja+09HsrDBDGG2MrucEYaBKfk=")],
)
def test_golden_hashes(person, names, golden):
    assert person.select(F.base64(HashSpec(person).include(*names).column())).first()[0] == golden


def test_seeds_and_exclusions(person):
    one = person.select(F.base64(HashSpec(person).with_seed(1).include("Id").column())).first()[0]
    two = person.select(F.base64(HashSpec(person).with_seed(2).include("Id").column())).first()[0]
    assert (one, two) == ("xLwHHlSznjndbRlM4aUKODIG6l0=", "3Kv65mg8gadCRsmQAq2TkGVvrKA=")
    spec = HashSpec(person).all().exclude("First_Name").include("Id", "Id", "KeyHash", "Nothing")
    assert spec.ordered() == ["Id", "Last_Name"]
    assert len(HashSpec(person).all().names) == 3


def text_of(spark, value, kind):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    return df.select(HashSpec(df).include("v").text()).first()[0]


@pytest.mark.parametrize(
    "value,kind,text",
    [
        (True, T.BooleanType(), "True"),
        (None, T.BooleanType(), ""),
        (datetime(2020, 1, 2, 3, 4, 5, 999), T.TimestampNTZType(), "01/02/2020 03:04:05"),
        (datetime(2020, 1, 2, 3, 4, 5), T.TimestampType(), "01/02/2020 03:04:05 \\u002B00:00"),
        (date(2020, 1, 2), T.DateType(), "01/02/2020"),
        (D("1.50"), T.DecimalType(18, 2), "1.50"),
        (1.0, T.DoubleType(), "1"),
        (-2.5, T.DoubleType(), "-2.5"),
        (1e16, T.DoubleType(), "1E\\u002B16"),
        (12345678.5, T.DoubleType(), "12345678.5"),
        ("it's <é> & \"q\"", T.StringType(), "it\\u0027s \\u003C\\u00E9\\u003E \\u0026 \\u0022q\\u0022"),
        ("abc\\", T.StringType(), "abc\\\\"),
        ("\\\"\n\x01", T.StringType(), "\\\\\\u0022\\n\\u0001"),
        ("😀", T.StringType(), "\\uD83D\\uDE00"),
        (None, T.StringType(), ""),
        (bytearray(b"\x01\xff"), T.BinaryType(), "01FF"),
    ],
)
def test_invariant_texts(spark, value, kind, text):
    assert text_of(spark, value, kind) == '{"h":["' + text + '"]}'


def test_times_hash_alike_in_every_session(spark):
    df = spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("v"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert df.select(HashSpec(df).include("v").text()).first()[0] == '{"h":["01/01/1970 00:00:00 \\u002B00:00"]}'
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_hash_runs_without_python(person):
    plan = person.select(HashSpec(person).all().column())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_base64_views(spark):
    df = spark.createDataFrame([(bytearray(20),), (bytearray(b""),), (bytearray(hashlib.sha1(b"x").digest()),)], "h binary")
    assert [r[0] for r in df.select(base64_view(F.col("h"))).collect()] == ["", "", base64.b64encode(hashlib.sha1(b"x").digest()).decode()]


def test_equality_and_changes(spark):
    df = spark.createDataFrame([(1, "a", None, None), (1, "b", 2.0, float("nan"))], "i int, s string, d double, n double")
    x = df.where("s = 'a'").alias("x").crossJoin(df.where("s = 'b'").alias("y"))
    assert x.select(changed_fields(["i", "s", "d", "n"], "x", "y")).first()[0] == ["s", "d", "n"]
    b = spark.createDataFrame([(None, None)], "a binary, b binary")
    assert b.select(field_equals(F.col("a"), F.col("b")), field_equals(F.col("a"), F.col("b"), strict_arrays=True)).first() == (True, False)


def test_small_functions(spark):
    df = spark.createDataFrame([(date(2002, 3, 4), "abc")], "d date, s string")
    assert df.select(date_key(F.col("d")), obfuscate(F.col("s"))).first() == (20020304, "***")
    assert list(chunk_by_sum([3, 4, 9, 1, 1], 7, lambda x: x)) == [[3, 4], [9], [1, 1]]
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "k int, v array<int>")
    assert sorted(map(tuple, transpose(rows, "k", "v").collect())) == [(0, [1, 4]), (1, [2]), (2, [3])]


def test_entity_schema():
    e = Entity.of(Person)
    assert [f.name for f in e.mapped][:6] == ["Id", "First", "Born", "Pay", "Code", "Owner"]
    assert "Others" not in [f.name for f in e.fields] and "Note" not in [f.name for f in e.mapped]
    assert e.schema()["Pay"].dataType == T.DecimalType(10, 4)
    assert not e.schema()["Code"].nullable and e.schema()["First"].metadata["scd"] == 2
    assert e.field("firstname").name == "First" and e.type2_fields == ["First"]
    assert e.principal("Owner") == ("Principal", "Id")
    with pytest.raises(KeyError):
        e.field("missing")
    with pytest.raises(EntityError):
        Entity.of(BadVersion)
    assert Entity.of(GoodVersion).field("Stamp").row_version


def test_composite_keys():
    assert [f.name for f in Entity.of(Composite).key_fields] == ["Id", "Name"]
    assert [f.name for f in Entity.of(Ordered).key_fields] == ["Name", "Id"]
    with pytest.raises(EntityError):
        Entity.of(Composite).single_key


def test_violations_and_orphans(spark):
    e = Entity.of(Person)
    rows = spark.createDataFrame([(1, "toolong", None, 7), (2, "ok", "c", 8)], "Id int, First string, Code string, Owner int")
    full = e.complete(rows, F.lit(None))
    assert [r[0] for r in full.orderBy("Id").select(e.violations()).collect()] == [["First", "Code"], []]
    principals = spark.createDataFrame([(8,)], "Id int")
    assert [r["Owner"] for r in e.orphans(full, "Owner", principals).collect()] == [7]
    assert e.rename_out(full).columns[1] == "FirstName"
