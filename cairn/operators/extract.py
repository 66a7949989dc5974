"""How a source is driven (EXT-1 to EXT-7) and dependent extracts (JN-5, JN-6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import DEFAULT_BATCH_SIZE, ExtractParameter, context
from ..sources.readers import Reader
from .surrogate import global_rank

ASC, DESC = "asc", "desc"


class PaginationError(RuntimeError):
    pass


def extract(spark: SparkSession, reader: Reader, params: list[ExtractParameter] | None = None, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """EXT-1: one query."""
    return reader.read(spark, context(batch_size, user=params))


def extract_inline(spark: SparkSession, reader: Reader, fn: Callable[[list[ExtractParameter], Reader], DataFrame], params: list[ExtractParameter] | None = None, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """EXT-2: a function of the context and the reader."""
    return fn(context(batch_size, user=params), reader)


class CursorPager:
    """EXT-3: keyset pages for opaque sources; the cursor is the largest (smallest) value of a page."""

    def __init__(self, name: str, initial: Any = None, order: str = ASC, kind: type = int):
        if initial is None:
            if kind not in (int, float, str, bool):
                raise ValueError("a cursor without an initial value must be a number or a text")
            initial = " " if kind is str else kind()
        self.name, self.value, self.order, self.seen, self.asked = name, initial, order, set(), False
        self.done = False

    def parameter(self) -> ExtractParameter:
        return ExtractParameter(self.name, self.value, "pager")

    def add(self, values: list[Any]) -> None:
        """Takes a page's cursor values; NULLs are ignored and a page of only those ends the query."""
        known = [v for v in values if v is not None]
        if not known:
            self.done = True
            return
        self.seen.update(known)
        self._move(max(known) if self.order == ASC else min(known))

    def _move(self, value: Any) -> None:
        if value == self.value:
            raise PaginationError(f"the parameter {self.name} did not change after a page")
        self.value = value

    @property
    def total(self) -> int:
        return len(self.seen)


class OffsetPager:
    """EXT-4: offset pages for opaque sources."""

    def __init__(self, initial: int = 0, order: str = ASC, name: str = "Offset"):
        self.name, self.value, self.order, self.total, self.done = name, initial, order, 0, False

    def parameter(self) -> ExtractParameter:
        return ExtractParameter(self.name, self.value, "pager", int)

    def add(self, values: list[Any]) -> None:
        if not values:
            self.done = True
            return
        self.total += len(values)
        self.value += len(values) if self.order == ASC else -len(values)


def pages(fetch: Callable[[list[ExtractParameter]], list[dict]], pager: CursorPager | OffsetPager, cursor: str | None = None, batch_size: int = DEFAULT_BATCH_SIZE) -> Iterator[list[dict]]:
    """Pages of an opaque source, one request after the other, until an empty one."""
    while True:
        rows = fetch([*context(batch_size), pager.parameter()])
        if not rows:
            return
        yield rows
        pager.add([r.get(cursor) for r in rows] if cursor else rows)
        if pager.done:
            return


def cursor_page(df: DataFrame, cursor: str, after: Any, size: int, order: str = ASC) -> DataFrame:
    """One keyset page of a table."""
    c = F.col(cursor)
    return df.where(c > after if order == ASC else c < after).orderBy(c.asc() if order == ASC else c.desc()).limit(size)


def cursor_scan(df: DataFrame, cursor: str, after: Any, order: str = ASC) -> DataFrame:
    """All keyset pages of a table at once: one range scan, which the source can prune."""
    return df.where(F.col(cursor) > after if order == ASC else F.col(cursor) < after)


def page_numbers(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``df`` with page_no, the page of ``size`` rows that each row falls on in the order of ``keys``.

    Row numbers come from quantile buckets and their sizes, so no task gets all rows.
    """
    return global_rank(df, keys, "_rank").withColumn("page_no", F.expr(f"(_rank - 1) div {size}")).drop("_rank")


def offset_page(df: DataFrame, keys: list[str | Column], offset: int, size: int) -> DataFrame:
    """One offset page of a table."""
    return df.orderBy(*keys).offset(offset).limit(size)


def correlated_top(outer: DataFrame, inner: DataFrame, on: dict[str, str], order: list[Column], size: int, keep: list[str]) -> DataFrame:
    """JN-5: for each outer row, the first ``size`` inner rows that match it, in ``order``.

    The inner side is ranked once by its keys and joined: no query for each outer row.
    """
    w = Window.partitionBy(*on.values()).orderBy(*order)
    ranked = inner.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size)
    renamed = ranked.select(*[F.col(i).alias(f"_k_{o}") for o, i in on.items()], *[F.col(c) for c in keep], "_rn")
    condition = [outer[o] == renamed[f"_k_{o}"] for o in on]
    return outer.join(renamed, condition).drop(*[f"_k_{o}" for o in on], "_rn")


def correlated_query(outer: DataFrame, sql: str, view: str = "input") -> DataFrame:
    """JN-5 as SQL: ``sql`` is a LATERAL subquery that refers to the outer row as ``view``."""
    outer.createOrReplaceTempView(view)
    return outer.sparkSession.sql(f"SELECT {view}.*, q.* FROM {view}, LATERAL ({sql}) q")


def chained(outer: DataFrame, inner: DataFrame, on: dict[str, str]) -> DataFrame:
    """JN-6: an extract whose parameters are properties of the upstream row, as an equi-join."""
    return outer.join(inner, [outer[o] == inner[i] for o, i in on.items()])


def deferred_rows(outer: DataFrame, fetch: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """JN-5 for opaque sources: ``fetch`` is called for each upstream row, where that row is."""
    import pandas as pd
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(batches):
        for batch in batches:
            rows = [r for row in batch.to_dict("records") for r in fetch(row)]
            yield pd.DataFrame(rows, columns=names)

    return outer.mapInPandas(run, schema)
