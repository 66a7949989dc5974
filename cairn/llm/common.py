"""What the operators share: reading tables, the shared folder, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Ids that may be broadcast, at most: 16 MB of them.
BROADCAST_ROWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of texts that go to Python at a time: with Spark's 10,000 a batch of long texts takes tens of MB, several times over.
TEXT_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """Has Arrow batches hold no more than TEXT_ROWS rows from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine, one of our own if that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cairn.shared.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("cairn.shared.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own switch: shuffle files go when the query that wrote them has ended.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's own setting: the keys that its generated hash table for aggregates has room for, as a power of two.
FAST_KEYS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: Spark's own switch: whether it may read a table in buckets without them.
KEEP_BUCKETS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(LET_GO, None)
    spark.conf.set(LET_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(LET_GO) if before is None else spark.conf.set(LET_GO, before)


@contextmanager
def counted_in_place(spark: SparkSession, bits: int) -> Iterator[None]:
    """Aggregates by up to 2^bits keys in Spark's generated hash table, which is faster, but by default small."""
    before = spark.conf.get(FAST_KEYS, None)
    spark.conf.set(FAST_KEYS, str(bits))
    try:
        yield
    finally:
        spark.conf.unset(FAST_KEYS) if before is None else spark.conf.set(FAST_KEYS, before)


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back; cuts lineage and survives lost executors.

    The shuffle files behind it are let go as soon as it is written.
    """
    path = fresh_path(df.sparkSession, name)
    with shuffles_let_go(df.sparkSession):
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing will read it again."""
    delete_path(df.sparkSession, df._cairn_path)


class Shelf:
    """A table in the shared folder that grows and stays dealt out by ``key``, so that grouping it by the key shuffles only what is added, once."""

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.key, self.buckets = spark, key, max(1, min(shuffle_partitions(spark), 100_000))
        self.path, self.name = fresh_path(spark, "shelf"), f"cairn_shelf_{uuid.uuid4().hex}"

    def __enter__(self) -> Shelf:
        # Otherwise Spark may read the buckets as plain files and shuffle them again.
        self.before = self.spark.conf.get(KEEP_BUCKETS, None)
        self.spark.conf.set(KEEP_BUCKETS, "false")
        return self

    def add(self, df: DataFrame) -> None:
        with shuffles_let_go(self.spark):
            dealt = df.repartition(self.buckets, self.key)
            dealt.write.format("parquet").bucketBy(self.buckets, self.key).option("path", self.path).option("compression", "zstd").mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def like(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns of the table, null where it has none."""
        return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.read().schema])

    def __exit__(self, *_) -> None:
        self.spark.conf.unset(KEEP_BUCKETS) if self.before is None else self.spark.conf.set(KEEP_BUCKETS, self.before)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of lower-cased words; empty for null or blank text."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def if_small(df: DataFrame, longs: int = 1) -> DataFrame:
    """``df``, of about ``longs`` numbers a row, marked for broadcast if it is counted to be within BROADCAST_ROWS numbers."""
    most = BROADCAST_ROWS // longs
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``ids`` (distinct): by broadcast up to BROADCAST_ROWS, counted first, else by a shuffle."""
    return df.join(if_small(ids), on, "left_semi")


#: Rows of one key from which on it is joined by broadcast; there are no more such keys than rows over this.
HOT_ROWS = 10_000


def join_hot(rows: DataFrame, keyed: DataFrame, on: str, count: str, longs: int = 2) -> DataFrame:
    """``rows`` joined with ``keyed``, a row for each key with the ``count`` of its rows (dropped): hot keys by broadcast, the rest by a shuffle."""
    hot, few = keyed.where(F.col(count) >= HOT_ROWS).drop(count), keyed.where(F.col(count) < HOT_ROWS).drop(count)
    if not hot.limit(1).count():
        return rows.join(few, on)
    cold = rows.join(if_small(hot.select(on)), on, "left_anti").join(few, on)
    return cold.unionByName(rows.join(if_small(hot, longs), on))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until ``df`` has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(column, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of about ``most`` bytes of an Arrow column of texts, a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto - at
        at = upto


def tidy(run):
    """A function of Arrow batches that gives free memory back to the system when its task ends, for workers live on."""

    def wrapped(batches):
        yield from run(batches)
        _give_back()

    return wrapped


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with this C library
        pass
