"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in the order of a hash of their id, are cut into blocks of ``block_rows``.
Weights are whole shares; their sum Q is the length of a frame of slots. Block j of a source
with share a is released at slot floor(j Q / a) and due by slot ceil((j + 1) Q / a); in each
slot the released block with the earliest deadline is taken. Every block then runs within its
window, so after any number of slots each source is less than one block from its weight, for
as long as it has rows. The windows repeat with each frame, so the schedule of one frame (Q
entries, computed from the shares alone) gives the slot of any block by arithmetic.

Sources run out at different times; slots that would be theirs stay empty and the others keep
their shares against each other. No row is dropped or repeated.

Ranks within a source come in two steps (counts of hash buckets, then ranks within a bucket),
so no task gets more than a bucket of a source, whatever its share of the rows.

Cases: a null source is a source of its own; null and repeated ids are kept, ties going by the
``tie`` columns (by a hash of the row, if none are named; equal rows are alike); sources without a given share get one share; shares of absent sources are
unused; an empty table gives an empty result. Columns named like the three added ones are replaced by ``mix``
and kept by ``in_mixed_order``; all others are kept, whatever their names. A row for each source, and the
frame of Q slots, go through the driver: their number is that of sources and shares, not of rows.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, unused

#: Rows of a block; rows that a hash bucket holds on average; sum of the default shares, about.
BLOCK_ROWS, BUCKET_ROWS, DEFAULT_SHARES = 16, 256, 1000


def default_shares(counts: dict[str | None, int]) -> dict[str | None, int]:
    """Shares in proportion to the square root of the rows, one at least."""
    total = sum(math.sqrt(n) for n in counts.values()) or 1.0
    return {s: max(1, round(DEFAULT_SHARES * math.sqrt(n) / total)) for s, n in counts.items()}


def frame(shares: list[int]) -> list[tuple[int, int]]:
    """(source index, its block within the frame) for each slot of a frame, earliest deadline first."""
    q = sum(shares)
    waiting = [(0, -(-q // a), s, 0) for s, a in enumerate(shares)]
    heapq.heapify(waiting)
    ready: list = []
    slots = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        slots.append((s, j))
        if j + 1 < shares[s]:
            heapq.heappush(waiting, ((j + 1) * q // shares[s], -(-(j + 2) * q // shares[s]), s, j + 1))
    return slots


ADDED = ("mix_block", "mix_slot", "mix_position")


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 42, source: str = "source", doc_id: str = "doc_id", tie: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with mix_block (of its source), mix_slot and mix_position (its place in the mixture)."""
    spark = docs.sparkSession
    # One row for each source.
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n")).collect()}
    given = default_shares(counts) if shares is None else shares
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    own = [max(1, int(given.get(s, 1))) for s in names]
    bits = max(1, math.ceil(math.log2(max(2, sum(counts.values()) / BUCKET_ROWS))))
    kept = docs.drop(*ADDED)
    h, bucket, src, size, ahead, r, rank, j, share, slot, last = unused(kept, "h", "bucket", "src", "size", "ahead", "r", "rank", "j", "share", "slot", "last")
    ties = [F.xxhash64(*[c for c, kind in kept.dtypes if "map<" not in kind])] if tie is None else [F.col(c) for c in tie]
    hashed = kept.withColumns({h: F.xxhash64(F.col(doc_id), F.lit(seed)), src: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))}).withColumn(bucket, F.shiftrightunsigned(h, 64 - bits))
    for i, t in enumerate(ties):
        hashed = hashed.withColumn(f"{last}{i}", t)
    ties = [f"{last}{i}" for i in range(len(ties))]
    sized = hashed.groupBy(src, bucket).agg(F.count("*").alias(size))
    before = Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select(src, bucket, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(ahead))
    within = Window.partitionBy(src, bucket).orderBy(h, doc_id, *ties)
    ranked = hashed.withColumn(r, F.row_number().over(within)).join(offsets, [src, bucket])
    ranked = ranked.withColumn(rank, F.col(ahead) + F.col(r) - 1).withColumn("mix_block", F.floor(F.col(rank) / block_rows))
    keys = ["" if s is None else f"={s}" for s in names]
    q = sum(own)
    rows = [(keys[s], k, own[s], t) for t, (s, k) in enumerate(frame(own))] if own else []
    # Q entries: fixed by the shares, whatever the rows.
    plan = spark.createDataFrame(rows, f"`{src}` string, `{j}` long, `{share}` long, `{slot}` long")
    shared = plan.groupBy(src).agg(F.first(share).alias(share))
    placed = (
        ranked.join(F.broadcast(shared), src)
        .withColumn(j, F.col("mix_block") % F.col(share))
        .join(F.broadcast(plan.drop(share)), [src, j])
        .withColumn("mix_slot", F.floor(F.col("mix_block") / F.col(share)) * q + F.col(slot))
        .withColumn("mix_position", F.col("mix_slot") * block_rows + F.col(rank) % block_rows)
    )
    return placed.select(*kept.columns, *ADDED)


def in_mixed_order(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, its columns only, dealt to partitions and sorted in the order of the mixture."""
    names = unused(docs, *ADDED)
    mixed = mix(docs.withColumnsRenamed({c: n for c, n in zip(ADDED, names, strict=True) if c != n}), **kw)
    ordered = mixed.repartitionByRange(shuffle_partitions(docs.sparkSession), "mix_position").sortWithinPartitions("mix_position").drop(*ADDED)
    return ordered.withColumnsRenamed({n: c for c, n in zip(ADDED, names, strict=True) if c != n}).select(*docs.columns)
