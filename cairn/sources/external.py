"""Python data sources: HTTP JSON endpoints (SRC-4, SRC-4a) and SQLite files (SRC-5, SNK-4)."""

from __future__ import annotations

import json
import re
import time
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..entity import Entity
from ..params import as_args
from .readers import Reader

#: Waits between tries, in seconds: 2, 4, ... 64.
RETRIES = 6
TRANSIENT = (408, 429, 500, 502, 503, 504)


def fill_uri(uri: str, args: dict) -> str:
    """``@name`` replaced by quoted values, longest names first."""
    names = "|".join(re.escape(n) for n in sorted(args, key=len, reverse=True))
    return re.sub(f"@({names})(?!\\w)", lambda m: quote(str(args[m[1]]), safe=""), uri) if names else uri


def get_json(uri: str, headers: dict | None = None, retries: int = RETRIES, base: float = 2.0, timeout: float = 100.0) -> list[dict]:
    """Objects of a GET: an array's, or the one. Transient errors are tried again; others raise."""
    import urllib.error
    import urllib.request

    for n in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(uri, headers=headers or {}), timeout=timeout) as reply:
                got = json.loads(reply.read())
                return got if isinstance(got, list) else [got]
        except urllib.error.HTTPError as e:
            if e.code not in TRANSIENT or n == retries:
                raise
        except urllib.error.URLError:
            if n == retries:
                raise
        time.sleep(base ** (n + 1))
    return []


class _Uri(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _HttpReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self):
        return [_Uri(u) for u in json.loads(self.options["uris"])]

    def read(self, partition):
        o = self.options
        rows = get_json(partition.uri, json.loads(o.get("headers", "{}")), int(o.get("retries", RETRIES)), float(o.get("base", 2)))
        for row in rows:
            by = {k.lower(): v for k, v in row.items()}
            yield tuple(_value(by.get(f.name.lower()), f.dataType) for f in self.schema.fields)


def _value(v, kind):
    name = kind.typeName()
    if v is None:
        return None
    if name == "string":
        return v if isinstance(v, str) else json.dumps(v)
    if name in ("byte", "short", "integer", "long"):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v):
            raise ValueError(f"{v!r} is not a {name}")
        return int(v)
    if name in ("float", "double"):
        return float(v)
    return v


class HttpJsonSource(DataSource):
    @classmethod
    def name(cls):
        return "cairn_http_json"

    def schema(self):
        raise ValueError("a schema is needed")

    def reader(self, schema):
        return _HttpReader(schema, self.options)


class HttpReader(Reader):
    """SRC-4: rows of one URI, or of several, each a partition."""

    def __init__(self, uri: str | list[str], schema: StructType | type, headers: dict | None = None, retries: int = RETRIES, base: float = 2.0):
        self.uris = [uri] if isinstance(uri, str) else uri
        self.schema = Entity.of(schema).schema() if isinstance(schema, type) else schema
        self.headers, self.retries, self.base = headers or {}, retries, base

    def read(self, spark: SparkSession, params=None) -> DataFrame:
        spark.dataSource.register(HttpJsonSource)
        uris = [fill_uri(u, as_args(params or [])) for u in self.uris]
        o = {"uris": json.dumps(uris), "headers": json.dumps(self.headers), "retries": str(self.retries), "base": str(self.base)}
        return spark.read.format(HttpJsonSource.name()).schema(self.schema).options(**o).load()


class _Range(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self):
        o = self.options
        if "column" not in o:
            return [_Range(None, None)]
        low, high, n = int(o["lower"]), int(o["upper"]), int(o["parts"])
        cuts = [low + (high - low) * i // n for i in range(1, n)]
        return [_Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition):
        import sqlite3

        o = self.options
        sql, args = o["query"], json.loads(o.get("args", "{}"))
        if partition.low is not None or partition.high is not None:
            low = f"{o['column']} >= {partition.low}" if partition.low is not None else f"({o['column']} IS NULL OR 1=1)"
            high = f"{o['column']} < {partition.high}" if partition.high is not None else "1=1"
            if partition.low is None:
                sql = f"SELECT * FROM ({sql}) WHERE {o['column']} IS NULL OR {high}"
            else:
                sql = f"SELECT * FROM ({sql}) WHERE {low} AND {high}"
        con = sqlite3.connect(f"file:{o['path']}?mode=ro", uri=True)
        try:
            cursor = con.execute(sql, args)
            at = {d[0].lower(): i for i, d in enumerate(cursor.description)}
            for row in cursor:
                yield tuple(_sqlite_value(row[at[f.name.lower()]], f.dataType) for f in self.schema.fields)
        finally:
            con.close()


def _sqlite_value(v, kind):
    from datetime import date, datetime
    from decimal import Decimal

    name = kind.typeName()
    if v is None:
        return None
    if name == "boolean":
        return bool(v)
    if name == "date":
        return date.fromisoformat(v[:10])
    if name in ("timestamp", "timestamp_ntz"):
        return datetime.fromisoformat(v)
    if name == "decimal":
        return Decimal(str(v))
    if name == "string":
        return str(v)
    return v


class _Count(WriterCommitMessage):
    def __init__(self, n):
        self.n = n


class _SqliteWriter(DataSourceWriter):
    """Rows go in in one transaction a task; a task that is repeated replaces the rows it wrote before by their key."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.options = schema, options
        if overwrite:
            import sqlite3

            with sqlite3.connect(options["path"]) as con:
                con.execute(f'DELETE FROM "{options["table"]}"')

    def write(self, rows):
        import sqlite3

        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        marks = ", ".join("?" for _ in self.schema.fields)
        con, n = sqlite3.connect(self.options["path"], timeout=60), 0
        try:
            with con:
                for row in rows:
                    con.execute(f'INSERT OR REPLACE INTO "{self.options["table"]}" ({names}) VALUES ({marks})', [_to_sqlite(v) for v in row])
                    n += 1
        finally:
            con.close()
        return _Count(n)


def _to_sqlite(v):
    from datetime import date, datetime
    from decimal import Decimal

    if isinstance(v, datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, bytearray):
        return bytes(v)
    return str(v) if isinstance(v, Decimal) else v


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "cairn_sqlite"

    def schema(self):
        raise ValueError("a schema is needed")

    def reader(self, schema):
        return _SqliteReader(schema, self.options)

    def writer(self, schema, overwrite):
        return _SqliteWriter(schema, self.options, overwrite)


class SqliteReader(Reader):
    """SRC-5: a query with ``@name`` parameters on a SQLite file; ``partition`` (column, lower, upper, parts) splits it."""

    def __init__(self, path: str, query: str, schema: StructType | type, partition: tuple[str, int, int, int] | None = None):
        self.path, self.query, self.partition = path, query, partition
        self.schema = Entity.of(schema).schema() if isinstance(schema, type) else schema

    def read(self, spark, params=None):
        from ..params import to_markers

        spark.dataSource.register(SqliteSource)
        sql, names = to_markers(self.query)
        by = {k.lower(): v for k, v in as_args(params or []).items()}
        o = {"path": self.path, "query": sql, "args": json.dumps({n: by.get(n.lower()) for n in names})}
        if self.partition:
            o |= dict(zip(("column", "lower", "upper", "parts"), map(str, self.partition), strict=True))
        return spark.read.format(SqliteSource.name()).schema(self.schema).options(**o).load()
