"""Built-in sources (SRC-1 to SRC-13)."""

from __future__ import annotations

import logging
import os
import time
import uuid
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..entity import Entity
from ..params import ExtractParameter, as_args, fill_markers, rename_views, to_markers

log = logging.getLogger("cairn.sources")
MAX_LOG_COUNT = 10


class SourceError(ValueError):
    pass


def file_path(path: str) -> str:
    """SRC-13: a path to a file needs an extension."""
    if not os.path.splitext(path.rstrip("/"))[1]:
        raise SourceError(f"{path} has no file extension")
    return path


class Reader:
    def read(self, spark: SparkSession, params: list[ExtractParameter] | None = None) -> DataFrame:
        raise NotImplementedError


class ListReader(Reader):
    """SRC-1: rows in memory; parameters play no part."""

    def __init__(self, rows: list, schema: T.StructType | str | type):
        self.rows, self.schema = rows, Entity.of(schema).schema() if isinstance(schema, type) else schema

    def read(self, spark, params=None):
        return spark.createDataFrame(self.rows, self.schema)


class FrameReader(Reader):
    """A DataFrame, or a function that makes one of (spark, parameters as a dict)."""

    def __init__(self, source: DataFrame | Callable[[SparkSession, dict], DataFrame]):
        self.source = source

    def read(self, spark, params=None):
        return self.source if isinstance(self.source, DataFrame) else self.source(spark, as_args(params or []))


class ParquetReader(Reader):
    def __init__(self, path: str, columns: list[str] | None = None, where: str | Column | None = None):
        self.path, self.columns, self.where = path, columns, where

    def read(self, spark, params=None):
        df = spark.read.parquet(self.path)
        df = df if self.where is None else df.where(self.where)
        return df.select(*self.columns) if self.columns else df


class CsvReader(Reader):
    """SRC-2, SRC-2a, FLT-1: a header is read only where there is one; columns then go by its names, in any order and
    under field or column names. A field that the header lacks fails; columns that are no field are left out."""

    def __init__(self, path: str, schema: T.StructType | str | type, header: bool = False, where: str | Column | None = None, options: dict | None = None):
        self.path, self.header, self.where, self.options = file_path(path), header, where, options or {}
        entity = Entity.of(schema) if isinstance(schema, type) else None
        self.schema = entity.schema() if entity else T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = {f.column.lower(): f.name for f in entity.mapped} if entity else {}

    def _named(self, spark: SparkSession) -> DataFrame:
        header = spark.read.options(**self.options).csv(self.path, header=True).columns
        fields = {f.name.lower(): f for f in self.schema.fields}
        of = [fields.get(self.columns.get(h.strip().lower(), h.strip()).lower()) for h in header]
        missing = [f.name for f in self.schema.fields if f not in of]
        if missing:
            raise SourceError(f"{self.path} has no column for {', '.join(missing)}")
        # The file's own names, so that a file with another header fails instead of being read by position.
        there = T.StructType([T.StructField(h, f.dataType if f else T.StringType()) for h, f in zip(header, of, strict=True)])
        df = spark.read.schema(there).options(**{"enforceSchema": "false", **self.options}).csv(self.path, header=True)
        at = {f.name: h for h, f in zip(header, of, strict=True) if f}
        return df.select(*[F.col(f"`{at[f.name]}`").alias(f.name) for f in self.schema.fields])

    def read(self, spark, params=None):
        df = self._named(spark) if self.header else spark.read.schema(self.schema).options(**self.options).csv(self.path)
        return df if self.where is None else df.where(self.where)


class JsonReader(Reader):
    """SRC-3, SRC-3a, FLT-2: an array of objects or one object; missing properties are NULL; a wrong type fails."""

    def __init__(self, path: str, schema: T.StructType | str | type, where: str | Column | None = None, multi_line: bool = True, mode: str = "FAILFAST"):
        self.path, self.where, self.multi_line, self.mode = file_path(path), where, multi_line, mode
        self.schema = Entity.of(schema).schema() if isinstance(schema, type) else schema

    def read(self, spark, params=None):
        df = spark.read.schema(self.schema).json(self.path, multiLine=self.multi_line, mode=self.mode)
        return df if self.where is None else df.where(self.where)


class TableReader(Reader):
    """SRC-7: all fields of an entity's table."""

    def __init__(self, entity: type | Entity, table: str | None = None):
        self.entity = Entity.of(entity)
        self.table = table or self.entity.table

    def read(self, spark, params=None):
        return spark.table(self.table).select(*[F.col(f.column).alias(f.name) for f in self.entity.mapped])


class SqlReader(Reader):
    """SRC-5 to SRC-8, SRC-11 over Spark tables and views: a query with ``@name`` parameters, or several
    commands whose rows are put together (those take no parameters)."""

    def __init__(self, query: str | None = None, commands: list[str] | None = None, entity: type | Entity | None = None, views: dict[str, DataFrame] | None = None):
        if (query is None) == (not commands):
            raise SourceError("give either a query or commands")
        self.query, self.commands, self.views = query, commands, views or {}
        self.entity = Entity.of(entity) if entity is not None else None
        #: Rows of the last read that are not the entity's, with reasons; how many an action has seen.
        self.rejected: DataFrame | None = None
        self.seen: Observation | None = None

    def read(self, spark, params=None):
        # Views get names of their own for each read, so that readers side by side don't meet.
        names = {name: f"{name}_{uuid.uuid4().hex}" for name in self.views}
        for name, view in self.views.items():
            view.createOrReplaceTempView(names[name])
        if self.commands:
            df = reduce(DataFrame.unionByName, [spark.sql(rename_views(c, names)) for c in self.commands])
        else:
            sql, names = to_markers(rename_views(self.query, names))
            args = as_args(params or [])
            missing = sorted(n for n in names if n.lower() not in {a.lower() for a in args})
            if missing:
                raise SourceError(f"no value for parameter {', '.join(missing)}")
            by = {a.lower(): v for a, v in args.items()}
            df = spark.sql(sql, args={n: by[n.lower()] for n in names})
        if not self.entity:
            return df
        self.seen = Observation()
        good, self.rejected = bind(df, self.entity, self.seen)
        return good

    def report(self) -> int:
        """SRC-9: after an action on what was read, how many rows were left out; logs that and the first of them."""
        n = self.seen.get["rejected"] if self.seen is not None else 0
        if n:
            log.warning("%s of %s rows are no %s", n, self.seen.get["rows"], self.entity.cls.__name__)
            for row in self.rejected.limit(MAX_LOG_COUNT).collect():
                log.warning("left out %s", row.asDict())
        return n


def with_retry(run: Callable, tries: int = 5, first: float = 1.0, most: float = 20.0, sleep: Callable[[float], None] = time.sleep):
    """SRC-6: ``run()``, tried again after 1, 2, 4 ... seconds, ``most`` at most; the last error is raised."""
    for i in range(tries):
        try:
            return run()
        except Exception as e:  # noqa: BLE001
            if i == tries - 1:
                raise
            wait = min(most, first * 2**i)
            log.warning("try %s failed (%s), again in %s s", i + 1, e, wait)
            sleep(wait)


class JdbcReader(Reader):
    """SRC-6: a query through JDBC, tried again where the database does not answer; the driver's jar is the user's to supply.

    ``partition`` splits the read by ranges. Tasks that fail later are tried again by Spark.
    """

    def __init__(self, url: str, query: str, options: dict | None = None, partition: tuple[str, int, int, int] | None = None):
        self.url, self.query, self.options, self.partition = url, query, options or {}, partition

    def sql(self, params: list[ExtractParameter] | None = None) -> str:
        """The query with its parameters put in, each once, where it is marked."""
        values = as_args(params or [])
        missing = sorted(n for n in to_markers(self.query)[1] if n.lower() not in {v.lower() for v in values})
        if missing:
            raise SourceError(f"no value for parameter {', '.join(missing)}")
        out = fill_markers(self.query, values, literal)
        log.debug("query: %s", out)
        return out

    def read(self, spark, params=None):
        sql = self.sql(params)
        return with_retry(lambda: self._load(spark, sql))

    def _load(self, spark: SparkSession, sql: str) -> DataFrame:
        source = spark.read.format("jdbc").option("url", self.url).options(**self.options)
        if self.partition:
            column, low, high, n = self.partition
            return source.options(dbtable=f"({sql}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n).load()
        return source.option("query", sql).load()


def literal(value) -> str:
    """A parameter as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return "X'" + bytes(value).hex() + "'"
    if isinstance(value, (date, datetime)):
        return "'" + value.isoformat(" ") + "'" if isinstance(value, datetime) else "'" + value.isoformat() + "'"
    return "'" + str(value).replace("'", "''") + "'"


def bind(df: DataFrame, entity: type | Entity, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-9, SRC-10: rows as the entity's fields, and the rows that don't fit (bad values, NULL in a field
    that can't be null) with the reasons. A column that is no field fails at once. ``seen`` gets the numbers of rows
    and rejected from the action that reads the first."""
    entity = Entity.of(entity)
    fields = {}
    for c in df.columns:
        try:
            f = entity.field(c)
        except KeyError:
            raise SourceError(f"{entity.cls.__name__} has no field for column {c}") from None
        fields[c] = f
    cast = [(F.col(c), F.col(c).try_cast(f.spark_type), f) for c, f in fields.items()]
    bad = [F.when((old.isNotNull() & new.isNull()) | (new.isNull() & F.lit(not f.nullable or f.required)), F.lit(f.name)) for old, new, f in cast]
    checked = df.withColumn("_rejected", F.array_compact(F.array(*bad)))
    watched = checked if seen is None else checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_rejected") > 0).alias("rejected"))
    good = watched.where(F.size("_rejected") == 0).select(*[new.alias(f.name) for _, new, f in cast])
    return good, checked.where(F.size("_rejected") > 0)
