"""Data tests (FLT-5, FLT-6)."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("cairn.quality")
MAX_LOG_COUNT = 10


class EnsureError(AssertionError):
    pass


@dataclass
class TestOutcome:
    rows: int
    failed: int
    first_ids: list


def failing(predicate: Column) -> Column:
    """Rows for which a predicate is false or unknown."""
    return ~F.coalesce(predicate, F.lit(False))


def observe_test(df: DataFrame, name: str, predicate: Column, identifier: str) -> tuple[DataFrame, Observation]:
    """FLT-5: rows pass unchanged; counts and the least failing id come with the action that reads them."""
    seen = Observation(name)
    bad = failing(predicate)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("failed"), F.min(F.when(bad, F.col(identifier))).alias("first")), seen


def log_failures(df: DataFrame, seen: Observation, predicate: Column, identifier: str, level: int = logging.WARNING, max_log_count: int = MAX_LOG_COUNT) -> TestOutcome:
    """FLT-5 after the action: logs up to ``max_log_count`` failing ids; reads the rows again only if some failed."""
    got = seen.get
    ids = [r[0] for r in df.where(failing(predicate)).select(identifier).orderBy(identifier).limit(max_log_count).collect()] if got["failed"] else []
    for i in ids:
        log.log(level, "test failed for %s", i)
    return TestOutcome(got["rows"], got["failed"], ids)


def report_test(df: DataFrame, predicate: Column, identifier: str, level: int = logging.WARNING, max_log_count: int = MAX_LOG_COUNT) -> TestOutcome:
    """FLT-5 as an action: counts, and up to ``max_log_count`` ids, logged."""
    bad = failing(predicate)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("failed")).first()
    ids = [r[0] for r in df.where(bad).select(identifier).orderBy(identifier).limit(max_log_count).collect()] if counts["failed"] else []
    for i in ids:
        log.log(level, "test failed for %s", i)
    return TestOutcome(counts["rows"], counts["failed"], ids)


def ensure(df: DataFrame, predicate: Column, message: str = "a row failed a test") -> DataFrame:
    """FLT-6: the rows; reading a failing one raises."""
    return df.where(F.assert_true(F.coalesce(predicate, F.lit(False)), F.lit(message)).isNull())


def ensure_now(df: DataFrame, predicate: Column, message: str = "a row failed a test") -> None:
    """FLT-6 as an action that ends in no sink."""
    if df.where(failing(predicate)).limit(1).count():
        raise EnsureError(message)
