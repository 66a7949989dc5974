"""Surrogate keys and global ranks without a single-task window (SNK-6)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_ROWS, MOST_BUCKETS, SAMPLE_EACH = 200_000, 1 << 14, 20


def global_rank(df: DataFrame, keys: list[str], name: str = "rank", start: int = 1) -> DataFrame:
    """``df`` with consecutive ranks in ascending order of ``keys`` (NULLs first).

    Rows fall in buckets by quantiles of the first key (a time by its microseconds, a text by a sample of the values
    itself); sizes of the buckets before it and the rank within it make a row's rank.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[keys[0]]
    first = F.col(keys[0])
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    place = first.cast("double") if numeric else F.unix_micros(first.cast("timestamp")).cast("double") if kind.startswith("timestamp") or kind == "date" else first.cast("string")
    text = not numeric and not (kind.startswith("timestamp") or kind == "date")
    n = df.count()
    buckets = min(MOST_BUCKETS, math.ceil(n / BUCKET_ROWS)) if n else 1
    if buckets <= 1:
        bucket = F.lit(0)
    else:
        shares = [i / buckets for i in range(1, buckets)]
        if text:
            # About SAMPLE_EACH values a bucket, by the hash of the value.
            upto = int(2**31 * min(1.0, SAMPLE_EACH * buckets / n))
            picked = df.select(place.alias("v")).where(F.col("v").isNotNull() & (F.pmod(F.xxhash64("v"), F.lit(2**31)) < upto)).orderBy("v").collect()
            bounds = sorted({picked[int(len(picked) * x)]["v"] for x in shares}) if picked else []
            table = F.lit(bounds) if bounds else F.array().cast("array<string>")
        else:
            bounds = sorted(set(df.select(F.percentile_approx(place, shares, 10 * buckets + 10_000).alias("q")).first()["q"] or []))
            table = F.split(F.lit(",".join(repr(b) for b in bounds)), ",").cast("array<double>") if bounds else F.array().cast("array<double>")
        bucket = F.size(F.filter(table, lambda b: b <= place))
        bucket = F.when(place.isNull(), -1).otherwise(bucket)
    placed = df.withColumn("_bucket", bucket)
    within = Window.partitionBy("_bucket").orderBy(*keys)
    ranked = placed.withColumn("_r", F.row_number().over(within))
    if buckets <= 1:
        return ranked.withColumn(name, (F.col("_r") + (start - 1)).cast("long")).drop("_bucket", "_r")
    # One row for each bucket.
    sizes = sorted((r["_bucket"], r["count"]) for r in placed.groupBy("_bucket").count().collect())
    ahead, rows = 0, []
    for b, size in sizes:
        rows.append((b, ahead))
        ahead += size
    before = spark.createDataFrame(rows, "_bucket int, _before long")
    return ranked.join(F.broadcast(before), "_bucket").withColumn(name, F.col("_before") + F.col("_r") + (start - 1)).drop("_bucket", "_r", "_before")


def assign_keys(new: DataFrame, target: DataFrame | None, key: str, natural: list[str]) -> DataFrame:
    """``new`` with ``key`` continuing after the target's largest, in the order of ``natural``."""
    last = (target.agg(F.max(key)).first()[0] or 0) if target is not None else 0
    kind = dict(target.dtypes)[key] if target is not None else "bigint"
    return global_rank(new.drop(key), natural, key, last + 1).withColumn(key, F.col(key).cast(kind))
