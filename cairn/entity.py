"""Entities: annotated classes that become Spark schemas (D1-D9, schema annotations).

    class Customer(Dimension):
        CustomerKey: Annotated[Int, Key(), Identity()]
        Id: Int
        Name: Annotated[String | None, MaxLength(100), Type2()]

A class attribute of an unsupported type is left out of the schema; ``Entity.supported``
may be widened. Base classes ``Row``, ``Fact`` and ``Dimension`` add bookkeeping columns.
"""

from __future__ import annotations

import typing
from dataclasses import dataclass, field, replace
from typing import Annotated, Any, NewType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LENGTH, DEFAULT_PRECISION, DEFAULT_SCALE = 300, 18, 2

Bool, Byte, SByte = NewType("Bool", bool), NewType("Byte", int), NewType("SByte", int)
Short, UShort, Int, UInt = NewType("Short", int), NewType("UShort", int), NewType("Int", int), NewType("UInt", int)
Long, ULong, Float, Double = NewType("Long", int), NewType("ULong", int), NewType("Float", float), NewType("Double", float)
Decimal, String, Char, Bytes = NewType("Decimal", object), NewType("String", str), NewType("Char", str), NewType("Bytes", bytes)
Date, DateTime, DateTimeOffset = NewType("Date", object), NewType("DateTime", object), NewType("DateTimeOffset", object)
Time, TimeSpan, Guid = NewType("Time", str), NewType("TimeSpan", object), NewType("Guid", str)

#: Property type -> Spark type.
SPARK_TYPES: dict[Any, T.DataType] = {
    Bool: T.BooleanType(),
    Byte: T.ShortType(),
    SByte: T.ByteType(),
    Short: T.ShortType(),
    UShort: T.IntegerType(),
    Int: T.IntegerType(),
    UInt: T.LongType(),
    Long: T.LongType(),
    ULong: T.DecimalType(20, 0),
    Float: T.FloatType(),
    Double: T.DoubleType(),
    Decimal: T.DecimalType(DEFAULT_PRECISION, DEFAULT_SCALE),
    String: T.StringType(),
    Char: T.StringType(),
    Bytes: T.BinaryType(),
    Date: T.DateType(),
    DateTime: T.TimestampNTZType(),
    DateTimeOffset: T.TimestampType(),
    Time: T.StringType(),
    TimeSpan: T.DayTimeIntervalType(),
    Guid: T.StringType(),
    bool: T.BooleanType(),
    int: T.IntegerType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
}


@dataclass(frozen=True)
class Key:
    order: int | None = None


@dataclass(frozen=True)
class Identity:
    """A key that the target assigns; left out of inserts from outside."""


@dataclass(frozen=True)
class ForeignKey:
    entity: type


@dataclass(frozen=True)
class ColumnName:
    name: str | None = None
    order: int | None = None


@dataclass(frozen=True)
class MaxLength:
    n: int


@dataclass(frozen=True)
class MinLength:
    n: int


@dataclass(frozen=True)
class Precision:
    precision: int
    scale: int


@dataclass(frozen=True)
class Required:
    pass


@dataclass(frozen=True)
class NotMapped:
    pass


@dataclass(frozen=True)
class RowVersion:
    """A concurrency stamp; must be bytes."""


@dataclass(frozen=True)
class Type2:
    """A change of this field makes a new version of the row."""


class EntityError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    kind: Any
    spark_type: T.DataType
    column: str
    order: int | None = None
    key: bool = False
    key_order: int | None = None
    identity: bool = False
    foreign_key: type | None = None
    required: bool = False
    nullable: bool = True
    ignored: bool = False
    max_length: int | None = None
    min_length: int | None = None
    type2: bool = False
    row_version: bool = False
    has_default: bool = False
    default: Any = None

    def struct_field(self) -> T.StructField:
        meta = {"column": self.column, "key": self.key, "identity": self.identity, "scd": 2 if self.type2 else 1}
        if self.max_length is not None:
            meta["max_length"] = self.max_length
        return T.StructField(self.name, self.spark_type, self.nullable and not self.required, meta)


def _unwrap(hint: Any) -> tuple[Any, list, bool]:
    marks: list = []
    nullable = False
    while True:
        if typing.get_origin(hint) is Annotated:
            hint, *more = typing.get_args(hint)
            marks += more
            continue
        options = typing.get_args(hint)
        if type(None) in options:
            nullable = True
            hint = next(o for o in options if o is not type(None))
            continue
        return hint, marks, nullable


@dataclass
class Entity:
    """Schema, keys and names of an entity class."""

    cls: type
    table: str
    schema_name: str | None
    fields: list[Field] = field(default_factory=list)

    supported: typing.ClassVar[dict[Any, T.DataType]] = dict(SPARK_TYPES)
    _known: typing.ClassVar[dict[type, Entity]] = {}

    @classmethod
    def of(cls, source: type | Entity) -> Entity:
        if isinstance(source, Entity):
            return source
        if source not in cls._known:
            cls._known[source] = cls._build(source)
        return cls._known[source]

    @classmethod
    def _build(cls, source: type) -> Entity:
        own = cls(source, getattr(source, "__table__", source.__name__).strip("[]"), getattr(source, "__schema__", None))
        hints = typing.get_type_hints(source, include_extras=True)
        # The class's own fields come first, then those of its bases.
        for name in dict.fromkeys(n for c in source.__mro__ for n in c.__dict__.get("__annotations__", {})):
            if name.startswith("_") or name not in hints:
                continue
            hint = hints[name]
            kind, marks, nullable = _unwrap(hint)
            by = {type(m): m for m in marks}
            if kind not in cls.supported:
                continue
            spark_type = cls.supported[kind]
            if kind is Decimal and Precision in by:
                spark_type = T.DecimalType(by[Precision].precision, by[Precision].scale)
            if RowVersion in by and kind not in (Bytes, bytes):
                raise EntityError(f"{source.__name__}.{name}: a row version must be bytes")
            sized = isinstance(spark_type, (T.StringType, T.BinaryType)) and kind not in (Time, Guid)
            named = by.get(ColumnName, ColumnName())
            own.fields.append(
                Field(
                    name,
                    kind,
                    spark_type,
                    named.name or name,
                    order=named.order,
                    key=Key in by,
                    key_order=by[Key].order if Key in by else None,
                    identity=Identity in by,
                    foreign_key=by[ForeignKey].entity if ForeignKey in by else None,
                    required=Required in by,
                    nullable=nullable or kind in (String, str, Bytes, bytes),
                    ignored=NotMapped in by,
                    max_length=(by[MaxLength].n if MaxLength in by else DEFAULT_LENGTH) if sized else None,
                    min_length=by[MinLength].n if MinLength in by and sized else None,
                    type2=Type2 in by,
                    row_version=RowVersion in by,
                    has_default=hasattr(source, name),
                    default=getattr(source, name, None),
                )
            )
        own._order_keys()
        return own

    def _order_keys(self) -> None:
        """Composite keys without an order follow those that have one, by name."""
        keys = [f for f in self.fields if f.key]
        taken = [f.key_order for f in keys if f.key_order is not None]
        after = max(taken, default=-1) + 1
        loose = sorted((f for f in keys if f.key_order is None), key=lambda f: f.name)
        placed = {f.name: after + i for i, f in enumerate(loose)}
        self.fields = [replace(f, key_order=placed[f.name]) if f.name in placed else f for f in self.fields]

    @property
    def mapped(self) -> list[Field]:
        return [f for f in self.fields if not f.ignored]

    @property
    def key_fields(self) -> list[Field]:
        return sorted((f for f in self.mapped if f.key), key=lambda f: f.key_order)

    @property
    def single_key(self) -> Field:
        keys = self.key_fields
        if len(keys) != 1:
            raise EntityError(f"{self.cls.__name__} needs exactly one key, has {len(keys)}")
        return keys[0]

    @property
    def foreign_keys(self) -> list[Field]:
        return [f for f in self.mapped if f.foreign_key]

    def principal(self, name: str) -> tuple[str, str]:
        """(table, key column) that a foreign key points to."""
        target = self.field(name).foreign_key
        if target is None:
            raise EntityError(f"{name} is not a foreign key")
        other = Entity.of(target)
        return other.table, other.single_key.column

    @property
    def type2_fields(self) -> list[str]:
        return [f.name for f in self.mapped if f.type2]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if name.lower() in (f.name.lower(), f.column.lower()):
                return f
        raise KeyError(f"{self.cls.__name__} has no field {name}")

    def select(self, *names: str) -> list[str]:
        """Field names, checked; all mapped fields if none are given."""
        return [self.field(n).name for n in names] if names else [f.name for f in self.mapped]

    def schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.mapped])

    def ddl_order(self) -> list[Field]:
        """Column order of a created table: explicit order, keys, then name."""
        return sorted(self.mapped, key=lambda f: (f.order is None, f.order or 0, not f.key, f.key_order or 0, f.name.lower()))

    def complete(self, df: DataFrame, as_of: Column | None = None) -> DataFrame:
        """``df`` with every mapped field, in order and cast; missing ones get their class default (PRJ-8)."""
        have = {c.lower(): c for c in df.columns}
        out = []
        for f in self.mapped:
            if f.name.lower() in have:
                value = F.col(have[f.name.lower()])
            elif f.has_default and f.default is NOW:
                value = as_of if as_of is not None else F.current_timestamp()
            elif f.has_default:
                value = F.lit(f.default)
            elif isinstance(f.spark_type, T.BinaryType) and not f.nullable:
                value = F.lit(b"")
            else:
                value = F.lit(None)
            out.append(value.cast(f.spark_type).alias(f.name))
        return df.select(*out)

    def violations(self) -> Column:
        """Names of fields of a row that break required, length or key rules."""
        found = []
        for f in self.mapped:
            if (f.required or f.key) and not f.identity:
                found.append(F.when(F.col(f.name).isNull(), F.lit(f.name)))
            if f.max_length is not None:
                found.append(F.when(F.length(f.name) > f.max_length, F.lit(f.name)))
            if f.min_length is not None:
                found.append(F.when(F.length(f.name) < f.min_length, F.lit(f.name)))
        return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")

    def rename_out(self, df: DataFrame) -> DataFrame:
        """Columns under their target names (PRJ-11); fields that are not mapped are left out."""
        return df.select(*[F.col(f.name).alias(f.column) for f in self.mapped if f.name in df.columns])

    def orphans(self, df: DataFrame, name: str, principal: DataFrame) -> DataFrame:
        """Rows whose foreign key has no principal row."""
        _, key = self.principal(name)
        return df.where(F.col(name).isNotNull()).join(principal.select(F.col(key).alias(name)), name, "left_anti")


NOW = object()


class Row:
    KeyHash: Bytes = b""
    ChangeHash: Bytes = b""
    IsDeleted: Bool = False


class Fact(Row):
    Created: DateTime = NOW


class Dimension(Row):
    FromDate: DateTime = NOW
    ToDate: DateTime | None = None
    FromDateKey: Int | None = None
    ToDateKey: Int | None = None
    IsActive: Bool = True


BOOKKEEPING = ("KeyHash", "ChangeHash", "IsDeleted", "KeyHashBase64", "ChangeHashBase64", "Created", "FromDate", "FromDateKey", "ToDate", "ToDateKey", "IsActive")
