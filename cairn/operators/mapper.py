"""The mapper (PRJ-1 to PRJ-14): property maps, constants, hashes and custom expressions as one projection.

Order of evaluation: property maps, then source expressions, then target expressions (constants,
hashes, custom), each by registration. Catalyst collapses the stages to one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..entity import Entity
from ..functions.hashing import HashSpec
from ..functions.scalars import date_key, obfuscate


class MappingError(ValueError):
    pass


class Mapper:
    def __init__(self, target: type | Entity, source: type | Entity | None = None):
        self.target = Entity.of(target)
        self.source = Entity.of(source) if source is not None else None
        self.properties: list[tuple[str, str]] = []
        self.source_steps: list[tuple[str, Callable[[DataFrame], Column] | Column]] = []
        self.target_steps: list[tuple[str, Callable[[DataFrame], Column]]] = []

    def map(self, source: str, target: str) -> Mapper:
        """PRJ-1: copies a property; types must be the same."""
        self.properties.append((source, self.target.field(target).name))
        return self

    def constant(self, target: str, value) -> Mapper:
        """PRJ-2."""
        f = self.target.field(target)
        self.target_steps.append((f.name, lambda df: F.lit(value).cast(f.spark_type)))
        return self

    def hash(self, target: str, configure: Callable[[HashSpec], HashSpec], ignore: tuple[str, ...] = ()) -> Mapper:
        """PRJ-3: a row hash over the target's properties; identity keys hash as their default."""

        def column(df: DataFrame) -> Column:
            given = {n for _, n in self.properties} | {n for n, _ in self.source_steps}
            spec = HashSpec(df.select(*self.target.select()), ignore)
            spec = configure(spec)
            for f in self.target.mapped:
                if f.identity and f.name in spec.names and f.name not in given:
                    spec.exclude(f.name).with_unset(f.name)
            return spec.column()

        self.target_steps.append((self.target.field(target).name, column))
        return self

    def add_source(self, target: str, expression: Callable[[DataFrame], Column] | Column) -> Mapper:
        """PRJ-4: an expression over the source row."""
        self.source_steps.append((self.target.field(target).name, expression))
        return self

    def add_target(self, target: str, expression: Callable[[DataFrame], Column]) -> Mapper:
        """PRJ-5: an expression over the projected row."""
        self.target_steps.append((self.target.field(target).name, expression))
        return self

    def obfuscate(self, target: str) -> Mapper:
        """PRJ-14."""
        name = self.target.field(target).name
        return self.add_target(name, lambda df: obfuscate(F.col(name)))

    def date_key(self, date: str, target: str) -> Mapper:
        """PRJ-12."""
        return self.add_target(target, lambda df: date_key(F.col(date)))

    def apply(self, df: DataFrame, as_of: Column | None = None) -> DataFrame:
        """Rows of ``df`` as target rows. Rows that are target rows already only get the target stage (PRJ-7)."""
        same = self.source is not None and self.source.cls is self.target.cls
        if same and (self.properties or self.source_steps):
            raise MappingError("rows of the target's own type take target expressions only")
        out = df if same else self._project(df, as_of)
        for name, step in self.target_steps:
            out = out.withColumn(name, step(out).cast(self.target.field(name).spark_type))
        return out

    def _project(self, df: DataFrame, as_of: Column | None) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        columns: dict[str, Column] = {}
        for source, target in self.properties:
            if source not in types:
                raise MappingError(f"the source has no column {source}")
            wanted = self.target.field(target).spark_type
            if not _same_type(types[source], wanted):
                raise MappingError(f"{source} is {types[source].simpleString()}, {target} is {wanted.simpleString()}")
            columns[target] = F.col(source)
        for target, step in self.source_steps:
            columns[target] = step(df) if callable(step) else step
        return self.target.complete(df.select(*[c.alias(n) for n, c in columns.items()]), as_of)


def _same_type(a: T.DataType, b: T.DataType) -> bool:
    return type(a) is type(b)
