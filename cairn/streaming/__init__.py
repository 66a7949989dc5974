"""Structured Streaming forms: merge loads of micro-batches and keyset pages as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import LoadResult, load_default
from ..sinks import TableSink


def merge_stream(stream: DataFrame, entity: type, sink: TableSink, loader: Callable[..., LoadResult], natural: list[str], checkpoint: str, order: list, prepare: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None, **loader_args) -> StreamingQuery:
    """Each micro-batch is one load into ``sink``, whose state is the table itself.

    Each version records the batch that made it, under the checkpoint's name; a batch that is tried again after
    it has been written is passed over, whatever the loader.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sink.create(spark)
        if batch_id <= sink.last_batch(spark, checkpoint):
            return
        rows = prepare(batch) if prepare else batch
        result = loader(entity, rows, sink.read(spark)) if loader is load_default else loader(entity, rows, sink.read(spark), order, **loader_args)
        sink.commit(spark, result, natural, batch=(checkpoint, batch_id))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Page(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


class _CursorStream(DataSourceStreamReader):
    """Offsets are cursor values: a batch is the keys above the last one up to the largest known."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def initialOffset(self):
        return {"cursor": json.loads(self.options.get("initial", "0"))}

    def latestOffset(self):
        con = self._connect()
        try:
            top = con.execute(f"SELECT max({self.options['cursor']}) FROM ({self.options['query']})").fetchone()[0]
        finally:
            con.close()
        return {"cursor": top} if top is not None else self.initialOffset()

    def partitions(self, start, end):
        return [_Page(start["cursor"], end["cursor"])]

    def read(self, partition):
        o = self.options
        con = self._connect()
        try:
            names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
            sql = f"SELECT {names} FROM ({o['query']}) WHERE {o['cursor']} > ? AND {o['cursor']} <= ? ORDER BY {o['cursor']}"
            yield from con.execute(sql, (partition.low, partition.high))
        finally:
            con.close()

    def commit(self, end):
        pass


class CursorStreamSource(DataSource):
    """EXT-3 as a stream over a SQLite query: ``path``, ``query``, ``cursor``, ``initial``."""

    @classmethod
    def name(cls):
        return "cairn_cursor_stream"

    def schema(self):
        raise ValueError("a schema is needed")

    def streamReader(self, schema):
        return _CursorStream(schema, self.options)
