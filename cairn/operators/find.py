"""Find and lookups (JN-1 to JN-9): semi-joins of a target with rows to look for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(target: DataFrame, rows: DataFrame, compare: list[str], result: list[str] | None = None) -> DataFrame:
    """JN-1: target rows that match any of ``rows`` on the compare fields; NULL matches nothing."""
    keep = list(dict.fromkeys([*compare, *(result or target.columns)]))
    return target.join(rows.select(*compare), compare, "left_semi").select(*keep)


def find_null_safe(target: DataFrame, rows: DataFrame, compare: list[str], result: list[str] | None = None) -> DataFrame:
    """JN-2: the same, with NULL matching NULL."""
    keep = list(dict.fromkeys([*compare, *(result or target.columns)]))
    wanted = rows.select(*[F.col(c).alias(f"_f_{c}") for c in compare])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in compare])
    return target.join(wanted, on, "left_semi").select(*keep)


def lookup_key(rows: DataFrame, dimension: DataFrame, on: dict[str, str], key: str, alias: str | None = None, at: str | None = None) -> DataFrame:
    """JN-9: rows with a dimension's surrogate key; NULL where there is none. ``on``: row column -> dimension column.

    Of a dimension with versions the active one counts, or, with ``at`` (a date column of the rows), the one that was valid
    then: from its FromDate until before its ToDate.
    """
    kept = [F.col(d).alias(f"_l_{r}") for r, d in on.items()]
    condition = [F.col(r) == F.col(f"_l_{r}") for r in on]
    if at is not None:
        kept += [F.col("FromDate").alias("_l_from"), F.col("ToDate").alias("_l_to")]
        condition += [F.col(at) >= F.col("_l_from"), F.col("_l_to").isNull() | (F.col(at) < F.col("_l_to"))]
    elif "IsActive" in dimension.columns:
        dimension = dimension.where("IsActive")
    dim = dimension.select(*kept, F.col(key).alias("_l_key"))
    return rows.join(dim, condition, "left").select(*rows.columns, F.col("_l_key").alias(alias or key))


def deleted_rows(target: DataFrame, source: DataFrame, on: dict[str, str]) -> DataFrame:
    """JN-8: rows of the target that are not deleted and that the source no longer has. ``on``: target column -> source column."""
    gone = source.select(*[F.col(s).alias(f"_d_{t}") for t, s in on.items()])
    return target.where(~F.col("IsDeleted")).join(gone, [target[t] == gone[f"_d_{t}"] for t in on], "left_anti")
