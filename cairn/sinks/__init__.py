"""Sinks: find, insert, update, create, truncate, commit (SNK-0 to SNK-13)."""

from __future__ import annotations

import json
import logging
import threading
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..entity import Entity
from ..operators.find import find, find_null_safe
from ..operators.merge import LoadResult, apply_updates
from ..operators.surrogate import assign_keys

log = logging.getLogger("cairn.sinks")
#: SNK-13: a lock for each target path.
_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)


class SinkError(RuntimeError):
    pass


class Sink:
    """SNK-0."""

    def read(self, spark: SparkSession) -> DataFrame | None:
        return None

    def create(self, spark: SparkSession, entity: Entity) -> None:
        pass

    def truncate(self, spark: SparkSession) -> None:
        raise NotImplementedError

    def find(self, spark: SparkSession, rows: DataFrame, compare: list[str], result: list[str] | None = None) -> DataFrame:
        return find(self.read(spark), rows, compare, result)

    def insert(self, df: DataFrame) -> None:
        raise NotImplementedError

    def update(self, updates: DataFrame, key: str) -> None:
        raise NotImplementedError

    def commit(self, spark: SparkSession, result: LoadResult, natural: list[str]) -> None:
        """Applies a load."""
        if result.updates is not None:
            self.update(result.updates, result.entity.single_key.name)
        self.insert(result.inserts)


class NullSink(Sink):
    """SNK-2: reads all rows and keeps none."""

    def insert(self, df):
        df.write.format("noop").mode("overwrite").save()

    def update(self, updates, key):
        self.insert(updates)

    def find(self, spark, rows, compare, result=None):
        return rows.limit(0)


class ListSink(Sink):
    """SNK-1: rows in a list on the driver; inserts only."""

    def __init__(self, rows: list):
        self.rows = rows

    def insert(self, df):
        self.rows += list(df.toLocalIterator())

    def find(self, *_, **__):
        raise NotImplementedError("a list cannot be searched")


class CsvSink(Sink):
    """SNK-3: appends under the target's column names; every file has its header; updates are refused."""

    def __init__(self, path: str, entity: type | Entity, header: bool = True, options: dict | None = None):
        self.path, self.entity, self.header, self.options = path, Entity.of(entity), header, options or {}

    def read(self, spark):
        from pyspark.sql import types as T

        fields = self.entity.mapped
        schema = T.StructType([T.StructField(f.column, f.spark_type) for f in fields])
        return spark.read.schema(schema).options(**self.options).csv(self.path, header=self.header).select(*[F.col(f.column).alias(f.name) for f in fields])

    def insert(self, df):
        with _LOCKS[self.path]:
            self.entity.rename_out(df).write.mode("append").options(**self.options).csv(self.path, header=self.header)

    def update(self, updates, key):
        raise SinkError("CSV files take no updates; write the next state instead")

    def find(self, spark, rows, compare, result=None):
        return find_null_safe(self.read(spark), rows, compare, result)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class TableSink(Sink):
    """A table kept as files that are never changed and a list of them for each version.

    Rows are dealt to ``buckets`` by a hash of the entity's key. A load writes new files: its new rows, and the buckets in which
    rows change; other buckets' files are listed again, not written. A version exists once its list has been
    created under a name that nothing else may have, which is one step: readers see all of a load or nothing, a load that
    fails or is cut off at any point leaves the table as it was, and of two loads of one version the later fails. Files
    that no list names stay until ``vacuum``.
    """

    def __init__(self, path: str, entity: type | Entity, buckets: int = 16):
        self.path, self.entity, self.buckets = path.rstrip("/"), Entity.of(entity), buckets

    def version(self, spark: SparkSession) -> int:
        return max(self._versions(spark), default=0)

    def _versions(self, spark: SparkSession) -> list[int]:
        fs, folder = _fs(spark, f"{self.path}/_versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _list(self, spark: SparkSession, version: int) -> dict:
        """parts: [folder, bucket] pairs; batches: the last batch of each stream."""
        if not version:
            return {"parts": [], "batches": {}}
        fs, at = _fs(spark, f"{self.path}/_versions/{version}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, spark: SparkSession, version: int, listed: dict) -> None:
        fs, folder = _fs(spark, f"{self.path}/_versions")
        fs.mkdirs(folder)
        fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/{version}.{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        # Hadoop's rename refuses a target that is there.
        if not fs.rename(fresh, spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/{version}")):
            fs.delete(fresh, False)
            raise SinkError(f"version {version} of {self.path} has been written by another load")

    def _bucket(self) -> Column:
        keys = [f.name for f in self.entity.key_fields] or [f.name for f in self.entity.mapped]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _write_parts(self, df: DataFrame) -> list[list]:
        """Writes rows beside the table, a folder for each bucket that has some."""
        spark, part = df.sparkSession, f"p-{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(f"{self.path}/{part}")
        fs, folder = _fs(spark, f"{self.path}/{part}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return [[f"{part}/{n}", int(n.split("=")[1])] for n in sorted(names) if n.startswith("_bucket=")]

    def _read_parts(self, spark: SparkSession, parts: list[list]) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], self.entity.schema())
        return spark.read.schema(self.entity.schema()).parquet(*[f"{self.path}/{p}" for p, _ in parts])

    def _next(self, spark: SparkSession, rows: DataFrame | None, updates: DataFrame | None = None, key: str | None = None, keep: bool = True, batch: tuple[str, int] | None = None) -> None:
        """Writes a version: what is there (if kept), updated, and new rows."""
        with _LOCKS[self.path]:
            version = self.version(spark)
            listed = self._list(spark, version)
            parts = listed["parts"] if keep else []
            if updates is not None:
                # As many as buckets at most.
                touched = {r[0] for r in updates.select(self._bucket().alias("b")).distinct().collect()}
                changed = [p for p in parts if p[1] in touched]
                if changed:
                    parts = [p for p in parts if p[1] not in touched]
                    state = apply_updates(self._read_parts(spark, changed), updates, key)
                    rows = state if rows is None else state.unionByName(rows)
            if rows is not None:
                parts = parts + self._write_parts(rows)
            batches = listed["batches"] | (dict([batch]) if batch else {})
            self._publish(spark, version + 1, {"parts": parts, "batches": batches})

    def last_batch(self, spark: SparkSession, stream: str) -> int:
        """The last micro-batch of a stream that a version holds, or -1."""
        return self._list(spark, self.version(spark))["batches"].get(stream, -1)

    def create(self, spark, entity=None):
        """SNK-8: an empty typed table, unless there is one."""
        if not self.version(spark):
            self._next(spark, None)

    def truncate(self, spark):
        """SNK-9, SNK-10."""
        self._next(spark, None, keep=False)

    def read(self, spark):
        version = self.version(spark)
        return self._read_parts(spark, self._list(spark, version)["parts"]) if version else None

    def replace(self, df: DataFrame) -> None:
        self._next(df.sparkSession, df, keep=False)

    def insert(self, df, natural: list[str] | None = None, batch: tuple[str, int] | None = None):
        """SNK-6: adds rows, and files for these alone; an identity key continues after the largest."""
        spark = df.sparkSession
        keys = [f.name for f in self.entity.key_fields if f.identity]
        rows = assign_keys(df, self.read(spark), keys[0], natural or [c for c in df.columns if c not in keys][:1]) if keys else df
        self._next(spark, self.entity.complete(rows).select(*[f.name for f in self.entity.mapped]), batch=batch)

    def update(self, updates, key):
        self._next(updates.sparkSession, None, updates, key)

    def commit(self, spark, result, natural, batch: tuple[str, int] | None = None):
        """Updates and inserts of a load as one version."""
        self._next(spark, result.keyed_inserts(natural), result.updates, result.entity.single_key.name, batch=batch)

    def vacuum(self, spark: SparkSession, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` versions, and the files that none of those names."""
        with _LOCKS[self.path]:
            versions = self._versions(spark)
            named = {p.split("/")[0]: p for v in versions[-keep:] for p, _ in self._list(spark, v)["parts"]}
            fs, root = _fs(spark, self.path)
            for v in versions[:-keep]:
                fs.delete(_fs(spark, f"{self.path}/_versions/{v}")[1], False)
            whole = {p for v in versions[-keep:] for p, _ in self._list(spark, v)["parts"]}
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if name.startswith("p-") and name not in named:
                    fs.delete(status.getPath(), True)
                elif name in named:
                    for own in fs.listStatus(status.getPath()):
                        if f"{name}/{own.getPath().getName()}" not in whole:
                            fs.delete(own.getPath(), True)


class SqliteSink(Sink):
    """SNK-4: a table of a SQLite file, for the driver's machine or a single node."""

    def __init__(self, path: str, entity: type | Entity):
        self.path, self.entity = path, Entity.of(entity)

    def create(self, spark, entity=None):
        import sqlite3

        kinds = {"boolean": "INTEGER", "byte": "INTEGER", "short": "INTEGER", "integer": "INTEGER", "long": "INTEGER", "float": "REAL", "double": "REAL", "binary": "BLOB"}
        keys = [f for f in self.entity.key_fields]
        parts = []
        for f in self.entity.ddl_order():
            kind = str(f.spark_type.simpleString()).upper() if f.spark_type.typeName() == "decimal" else kinds.get(f.spark_type.typeName(), "TEXT")
            own = " PRIMARY KEY" + (" AUTOINCREMENT" if f.identity else "") if len(keys) == 1 and f.key else ""
            null = " NOT NULL" if f.required and not own else ""
            check = f' CHECK(length("{f.column}") <= {f.max_length})' if f.max_length is not None and kind == "TEXT" else ""
            parts.append(f'"{f.column}" {kind}{own}{null}{check}')
        if len(keys) > 1:
            parts.append("PRIMARY KEY (" + ", ".join(f'"{f.column}"' for f in keys) + ")")
        for f in self.entity.foreign_keys:
            table, column = self.entity.principal(f.name)
            parts.append(f'FOREIGN KEY ("{f.column}") REFERENCES "{table}" ("{column}")')
        with sqlite3.connect(self.path) as con:
            con.execute(f'CREATE TABLE IF NOT EXISTS "{self.entity.table}" ({", ".join(parts)})')
            if any(f.name == "KeyHash" for f in self.entity.mapped):
                con.execute(f'CREATE INDEX IF NOT EXISTS "IX_{self.entity.table}_KeyHash" ON "{self.entity.table}" ("KeyHash")')

    def truncate(self, spark=None):
        self.execute(f'DELETE FROM "{self.entity.table}"')

    def execute(self, command: str) -> int:
        """SNK-11, SNK-12."""
        import sqlite3

        log.debug("command: %s", command)
        with _LOCKS[self.path], sqlite3.connect(self.path) as con:
            return con.execute(command).rowcount

    def read(self, spark):
        from ..sources.external import SqliteReader

        columns = ", ".join(f'"{f.column}" AS "{f.name}"' for f in self.entity.mapped)
        return SqliteReader(self.path, f'SELECT {columns} FROM "{self.entity.table}"', self.entity.schema()).read(spark)

    def insert(self, df):
        from ..sources.external import SqliteSource

        df.sparkSession.dataSource.register(SqliteSource)
        own = [f.name for f in self.entity.mapped if not f.identity and f.name in df.columns]
        out = df.select(*own)
        self.entity.rename_out(out).write.format(SqliteSource.name()).options(path=self.path, table=self.entity.table).mode("append").save()

    def update(self, updates, key):
        from ..sources.external import SqliteSource

        held = self.read(updates.sparkSession)
        changed = apply_updates(held.join(updates.select(key), key, "left_semi"), updates, key)
        rows = self.entity.rename_out(changed.select(*[f.name for f in self.entity.mapped]))
        updates.sparkSession.dataSource.register(SqliteSource)
        rows.write.format(SqliteSource.name()).options(path=self.path, table=self.entity.table).mode("append").save()


class JdbcSink(Sink):
    """SNK-5: appends through JDBC in batches; the driver's jar is the user's to supply."""

    def __init__(self, url: str, table: str, entity: type | Entity, options: dict | None = None, batch_size: int = 10_000):
        self.url, self.table, self.entity, self.options, self.batch_size = url, table, Entity.of(entity), options or {}, batch_size

    def read(self, spark):
        return spark.read.format("jdbc").options(url=self.url, dbtable=self.table, **self.options).load()

    def insert(self, df):
        self.entity.rename_out(df).write.format("jdbc").options(url=self.url, dbtable=self.table, batchsize=self.batch_size, **self.options).mode("append").save()

    def truncate(self, spark):
        spark.createDataFrame([], self.entity.schema()).write.format("jdbc").options(url=self.url, dbtable=self.table, truncate=True, **self.options).mode("overwrite").save()


class CatalogSink(Sink):
    """Rows appended to a table of the catalogue; commands run as SQL (SNK-11)."""

    def __init__(self, table: str, entity: type | Entity, buckets: int | None = None):
        self.table, self.entity, self.buckets = table, Entity.of(entity), buckets

    def create(self, spark, entity=None):
        columns = ", ".join(f"`{f.column}` {f.spark_type.simpleString()}" for f in self.entity.ddl_order())
        clustered = f" CLUSTERED BY (KeyHash) INTO {self.buckets} BUCKETS" if self.buckets else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet{clustered}")

    def truncate(self, spark):
        spark.sql(f"TRUNCATE TABLE {self.table}")

    def execute(self, spark: SparkSession, command: str) -> DataFrame:
        log.debug("command: %s", command)
        return spark.sql(command)

    def update(self, updates, key):
        """Rewrites the table with the changed rows; they are written beside it first, as it cannot be read while it is replaced."""
        spark, beside = updates.sparkSession, f"{self.table}_next"
        state = self.entity.rename_out(apply_updates(self.read(spark), updates, key)).select(*[f.column for f in self.entity.ddl_order()])
        state.write.mode("overwrite").saveAsTable(beside)
        spark.table(beside).write.mode("overwrite").insertInto(self.table, overwrite=True)
        spark.sql(f"DROP TABLE {beside}")

    def read(self, spark):
        return spark.table(self.table).select(*[F.col(f.column).alias(f.name) for f in self.entity.mapped])

    def insert(self, df):
        rows = self.entity.complete(df)
        self.entity.rename_out(rows).select(*[f.column for f in self.entity.ddl_order()]).write.insertInto(self.table)
