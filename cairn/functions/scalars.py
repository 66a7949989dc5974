"""Comparison and small column functions (D5, FLT-7, PRJ-12, PRJ-14, AGG-8)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_equals(a: Column, b: Column, strict_arrays: bool = False) -> Column:
    """Null-safe equality; with ``strict_arrays``, two NULL binaries differ."""
    return (a.isNotNull() & b.isNotNull() & (a == b)) if strict_arrays else a.eqNullSafe(b)


def changed_fields(names: Iterable[str], left: str, right: str) -> Column:
    """Names of the fields in which two aliased rows differ, in the given order."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")), F.lit(n)) for n in names]))


def rows_equal(names: Iterable[str], left: str, right: str) -> Column:
    return F.size(changed_fields(names, left, right)) == 0


def date_key(value: Column) -> Column:
    """A date as the integer yyyyMMdd."""
    return F.date_format(value, "yyyyMMdd").cast("int")


def obfuscate(value: Column) -> Column:
    """As many stars as the text has characters."""
    return F.repeat(F.lit("*"), F.length(value))


def chunk_by_sum(items: Iterable, most: int, size) -> Iterator[list]:
    """Lists of consecutive items whose sizes sum to ``most`` at the most; a larger item stands alone."""
    chunk: list = []
    held = 0
    for x in items:
        n = size(x)
        if chunk and held + n > most:
            yield chunk
            chunk, held = [], 0
        chunk.append(x)
        held += n
    if chunk:
        yield chunk


def transpose(df: DataFrame, row: str, values: str) -> DataFrame:
    """(pos, values): ragged rows turned to columns, in the order of ``row``."""
    cells = df.select(F.col(row).alias("_row"), F.posexplode(values).alias("pos", "_value"))
    gathered = cells.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("_row", "_value"))).alias("_cells"))
    return gathered.select("pos", F.transform("_cells", lambda c: c["_value"]).alias(values))
