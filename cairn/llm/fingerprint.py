"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A text's sketch is the sorted set of its shingle hashes whose ``BITS`` leading bits are zero,
the same fixed fraction of hash values for every text. So sketches of any two texts can be
compared (likeness, containment) or merged, however unequal the texts. A text of at most ``WHOLE``
distinct shingles keeps the others too. Two such sketches are compared whole; any other two by the hashes
below the threshold, which both have all of. Where a text has none there, its containment is not known from its sketch: null.
(A sketch all of which lies below the threshold passes for a sampled one, whatever its size.)

Cases: a null text counts as empty; a text without words has the empty sketch, like only to
other empty ones; fewer words than a shingle make one shingle; repeated words and rows change
nothing; an empty table gives an empty result. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import words

SHINGLE, BITS, WHOLE = 5, 3, 64
#: Rows of a bucket in ``with_next``, on average; buckets at most (beyond, buckets grow and spill).
BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """64-bit hashes of all word shingles of a text, in order."""
    none = F.array().cast("array<bigint>")

    def of(h: Column) -> Column:
        # Elements one by one: a slice would copy the whole array for each shingle.
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[F.get(h, i + j if j else i) for j in range(shingle)]))
        return F.when(F.size(h) >= shingle, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _below(s: Column, bits: int) -> Column:
    return F.filter(s, lambda x: F.shiftrightunsigned(x, 64 - bits) == 0)


def _whole(s: Column, bits: int) -> Column:
    """Whether a sketch is known to hold all hashes of its text."""
    return (F.size(s) == 0) | F.exists(s, lambda x: F.shiftrightunsigned(x, 64 - bits) != 0)


def sketch(text: Column, shingle: int = SHINGLE, bits: int = BITS, whole: int = WHOLE) -> Column:
    """The sketch of a text: array<bigint>, sorted."""

    def of(d: Column) -> Column:
        return F.sort_array(F.when(F.size(d) <= whole, d).otherwise(_below(d, bits)))

    return let(F.array_distinct(shingle_hashes(text, shingle)), of)


def merged(a: Column, b: Column, bits: int = BITS, whole: int = WHOLE) -> Column:
    """The sketch of two texts' shingles together."""

    def of(u: Column) -> Column:
        return F.when(_whole(a, bits) & _whole(b, bits) & (F.size(u) <= whole), u).otherwise(_below(u, bits))

    return let(F.sort_array(F.array_union(a, b)), of)


def _shared(a: Column, b: Column, bits: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the parts of two sketches that can be compared."""
    both = F.when(_whole(a, bits) & _whole(b, bits), F.array(a, b)).otherwise(F.array(_below(a, bits), _below(b, bits)))
    return let(both, lambda p: body(F.get(p, 0), F.get(p, 1)))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity; 1 for two equal sketches, 0 for others without a hash to compare."""

    def of(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) > 0, n / (F.size(x) + F.size(y) - n)).otherwise(F.lit(0.0)))

    return F.when(a == b, F.lit(1.0)).otherwise(_shared(a, b, bits, of))


def containment(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty, null if no hash of a can be compared."""
    share = _shared(a, b, bits, lambda x, y: F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(share)


def as_text(s: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, in order."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(rows: DataFrame, key: str, tie: Column, carry: dict[str, str]) -> DataFrame:
    """``rows`` with, under new names, columns of the next row in descending ``key``; the last row's next is the first.

    Rows are bucketed by quantiles of the key. Each bucket also gets a copy of the row that
    follows its last one, so each next row is found within a bucket: one shuffle.
    """
    spark = rows.sparkSession
    k = F.coalesce(F.col(key), F.lit(-(2**63)))
    n = rows.select(key).count()
    buckets = min(MOST_BUCKETS, max(1, math.ceil(n / BUCKET_ROWS)))
    bounds: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = rows.select(F.percentile_approx(k, shares, 10 * buckets + 10_000).alias("q")).first()["q"]
        bounds = sorted(set(found))
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def down(at: Column, step: Column) -> Column:
        fits = at + step <= len(bounds)
        return F.when(fits & (F.element_at(table, F.when(fits, at + step).otherwise(F.lit(1))) <= k), at + step).otherwise(at)

    bucket = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), down) if bounds else F.lit(0)
    placed = rows.withColumn("_k", k).withColumn("_bucket", bucket).withColumn("_copy", F.lit(0))
    # A row for each bucket.
    heads = sorted(((r["_bucket"], r["m"]) for r in placed.groupBy("_bucket").agg(F.max("_k").alias("m")).collect()), reverse=True)
    copies = [(heads[(i + 1) % len(heads)][1], b) for i, (b, _) in enumerate(heads)]
    to = spark.createDataFrame(copies, "_k long, _to int")
    ghosts = placed.drop("_bucket", "_copy").join(F.broadcast(to), "_k").withColumnRenamed("_to", "_bucket").withColumn("_copy", F.lit(1))
    w = Window.partitionBy("_bucket").orderBy("_copy", F.col("_k").desc(), F.col("_tie").desc())
    whole = placed.unionByName(ghosts).withColumn("_tie", tie)
    out = whole.select(*rows.columns, "_copy", *[F.lead(c).over(w).alias(name) for c, name in carry.items()])
    return out.where("_copy = 0").drop("_copy")


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with likeness to that and to the next document."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = chosen.withColumn("sketch", sketch(F.col("text")))
    paired = with_next(own, "doc_id", F.xxhash64("text"), {"text": "next_text", "sketch": "next_sketch"})
    cut = F.expr("n_chars div 3")
    edited = (
        paired.withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr("next_text", F.lit(1), cut.cast("int"))))
        .withColumn("edited_sketch", sketch(F.col("edited")))
    )
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("edited_contains"),
    )
