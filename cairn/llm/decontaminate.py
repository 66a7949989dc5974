"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over runs of ``SPAN`` words say which positions count and which are ignored,
so that a run still matches where a word was put in another's place. The masks hit whatever
verification accepts: a stretch of 20 words or more that agrees in ``MIN_SHARE`` has a part of 10 to
19 words that does; that has 10 words with at most two others, or 15 with at most three, and for each
such pattern some mask lies on agreeing words (shown by enumeration in the tests).

The masked runs of the benchmark are a table of hashes. A table of bits, of a size bounded by ``MOST_BITS``, tells
which hashes it may hold; documents are scanned once, and what passes is joined with the table. Both sides bring
the words around the run, 16 bits of each: only a document and an item that agree there well enough for a part of
MIN_WORDS to 2 * MIN_WORDS - 1 words go on. Their texts are fetched and verified: along each diagonal of a hit the overlap of
document and item is scored, word for word, and counts as a leak where a stretch of at least ``MIN_WORDS`` words (or
the whole item, if shorter) agrees in ``MIN_SHARE`` of its words. Documents with one text, told by its 64-bit hash, are
judged once. (Beyond some millions of masked runs the bits let ever more hashes pass to the join, which sorts them out.)

Cases: null or empty texts, of documents or items, match nothing; an item of fewer than
``MIN_WORDS`` words is sought by its halves, one of which is whole if the item agrees in its share, and below five
words, where no word may differ, as a whole; a null item_id is reported as null; repeated
items are reported once for each id, repeated documents each; an empty table on either side gives no leaks.
Words are lower-cased (A-Z); punctuation at a word's ends is ignored. Texts are read whole. Other columns are
kept, whatever their names, but for one named as ``find_leaks`` is told to name its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, if_small, materialize, semi, slices, tidy, unused

#: Masks of six words that count, all within the first MIN_WORDS.
MASKS = ("110101011000", "111100110000", "110111100000", "111111000000", "111001011000")
SPAN = 12
MIN_WORDS, MIN_SHARE = 10, 0.8
#: Bits of the table for each masked run, and the power of two that bounds it (16 MB); that of a part in which it is put together.
BITS_EACH, MOST_BITS, CHUNK_BITS = 256, 27, 15
#: Words before and from a hit on that a part it lies in may take.
BEFORE, AFTER = 2 * MIN_WORDS - 2, 2 * MIN_WORDS - 1
#: Text that is scanned at a time.
SLICE_BYTES = 4 << 20
EDGE = b".,;:!?\"'()[]"

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_codes(text: str) -> np.ndarray:
    """A 64-bit code for each word of a text."""
    from xxhash import xxh64_intdigest

    words = [w.strip(EDGE) for w in text.encode("utf-8", "surrogatepass").lower().split()]
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def masked(codes: np.ndarray, mask: str, salt: int = 0) -> np.ndarray:
    """The hash of every run under ``mask``, ignoring its zeros."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            total += codes[i : i + n] * _FACTORS[i]
    return _mix(total)


def short_masks(size: int) -> tuple[str, ...]:
    """Masks of an item of ``size`` words, less than MIN_WORDS: at most one word of five or more may differ."""
    half = size // 2
    return ("1" * half + "0" * (size - half), "0" * half + "1" * (size - half)) if size >= 5 else ("1" * size,)


def padded(codes: np.ndarray, room: int = SPAN - 1) -> np.ndarray:
    """``codes`` with room for the ignored end of a mask."""
    return np.concatenate([codes, np.zeros(room, np.uint64)])


def around(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of each word from BEFORE before to AFTER after each place; 0 where there is none."""
    small = np.where(codes > 0, np.maximum(codes >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype("<u2")
    room = np.concatenate([np.zeros(BEFORE, "<u2"), small, np.zeros(AFTER, "<u2")])
    return room[at[:, None] + np.arange(BEFORE + AFTER)]


def may_agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two rows of words agree in MIN_SHARE of some part of MIN_WORDS to 2 * MIN_WORDS - 1."""
    sums = np.cumsum(np.pad((a == b) & (a > 0), ((0, 0), (1, 0))), axis=1)
    out = np.zeros(len(a), bool)
    for n in range(MIN_WORDS, 2 * MIN_WORDS):
        out |= (sums[:, n:] - sums[:, :-n] >= MIN_SHARE * n - 1e-9).any(axis=1)
    return out


def _rows(arrays: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in arrays], pa.binary())


def seeds(codes: np.ndarray, sizes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes by position for each mask: of padded ``codes``, and of those of short items of ``sizes``."""
    own = [masked(codes, mask, 1 + i) for i, mask in enumerate(MASKS)]
    return own + [masked(codes, mask, 100 + 2 * size + i) for size in sizes for i, mask in enumerate(short_masks(size))]


def item_seeds(codes: np.ndarray) -> list[np.ndarray]:
    if len(codes) >= MIN_WORDS:
        return seeds(padded(codes))
    return seeds(codes, (len(codes),))[len(MASKS) :] if len(codes) else []


def diagonals(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where, in a document, an item would begin by any hit."""
    out = []
    short = (len(own),) if len(own) < MIN_WORDS else ()
    mine = seeds(codes, short)[len(MASKS) :] if short else seeds(padded(codes))
    for got, h in zip(mine, item_seeds(own), strict=True):
        order = np.argsort(h, kind="stable")
        left, right = np.searchsorted(h[order], got, "left"), np.searchsorted(h[order], got, "right")
        at = np.nonzero(right > left)[0]
        n = (right - left)[at]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.unique(np.repeat(at, n) - order[np.repeat(left[at], n) + place]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def leak(codes: np.ndarray, own: np.ndarray) -> tuple[int, int, int] | None:
    """The longest verified stretch of an item in a document: (words that agree, start, end)."""
    best = None
    for shift in diagonals(codes, own).tolist():
        lo, hi = max(0, shift), min(len(codes), shift + len(own))
        got = stretch(codes[lo:hi] == own[lo - shift : hi - shift], min(MIN_WORDS, len(own)))
        if got and (best is None or got[0] > best[0]):
            best = (got[0], lo + got[1], lo + got[2])
    return best


def stretch(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """The longest stretch that begins and ends in agreement and agrees in MIN_SHARE of its words: (agreeing, start, end)."""
    good = np.nonzero(same)[0]
    if len(good) < MIN_SHARE * least:
        return None
    # Agreeing words less their due share, up to each end: a stretch qualifies where this does not fall.
    level = np.cumsum(same) - MIN_SHARE * np.arange(1, len(same) + 1)
    before = np.concatenate([[0.0], level])[good]
    lowest = np.minimum.accumulate(before)
    best = None
    for e in good[::-1]:
        if best and e + 1 <= best[2] - best[1]:
            break
        s = good[np.searchsorted(-lowest, -(level[e] + 1e-9))] if lowest[-1] <= level[e] + 1e-9 else None
        if s is not None and e + 1 - s >= least and (best is None or e + 1 - s > best[2] - best[1]):
            best = (int(same[s : e + 1].sum()), int(s), int(e + 1))
    return best


def _seed_batches(batches):
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = word_codes(text)
            got = item_seeds(codes)
            if got:
                at = np.concatenate([np.arange(len(h)) for h in got])
                h, n = np.concatenate(got), len(at)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, item, np.int64)), pa.array(np.full(n, len(codes), np.int32)), _rows(around(padded(codes), at))], names=["h", "item", "size", "own"])


def _chunk_bits(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << CHUNK_BITS, bool)
    bits[table.column("off").to_numpy()] = True
    return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _bit_table(table: DataFrame) -> tuple[int, np.ndarray]:
    """How many leading bits of a hash tell its place, and the packed bits: a bound for any benchmark."""
    n = table.count()
    size = min(MOST_BITS, max(CHUNK_BITS, (BITS_EACH * n).bit_length()))
    place = F.shiftrightunsigned("h", 64 - size)
    placed = table.select(F.shiftright(place, CHUNK_BITS).cast("int").alias("chunk"), place.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int").alias("off")).distinct()
    packed = np.zeros(1 << (size - 3), np.uint8)
    step = 1 << (CHUNK_BITS - 3)
    # 2^(MOST_BITS - 3) bytes at most.
    for r in placed.groupBy("chunk").applyInArrow(_chunk_bits, "chunk int, bits binary").toLocalIterator():
        packed[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return size, packed


def _hit_batches(held, sizes: tuple[int, ...]):
    """(th, h, words): of each text the hashes that the benchmark may hold, and the words around them; repeats once."""

    def run(batches):
        size, packed = held.value
        for batch in batches:
            for at, rows in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(at, rows)
                codes = [padded(word_codes(t), BEFORE + AFTER) for t in part.column(1).to_pylist()]
                ends = np.cumsum([len(c) for c in codes])
                flat, names, found = np.concatenate(codes), part.column(0).to_numpy(), []
                for h in seeds(flat, sizes):
                    place = (h >> np.uint64(64 - size)).astype(np.int64)
                    hit = np.nonzero(packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)[0]
                    found.append((hit, h[hit]))
                hit, h = (np.concatenate(x) for x in zip(*found, strict=True))
                th, words = names[np.searchsorted(ends, hit, side="right")], around(flat, hit)
                told = _mix(th.view(np.uint64) * _FACTORS[0] + h * _FACTORS[1] + (words * _FACTORS[2 : 2 + BEFORE + AFTER]).sum(axis=1, dtype=np.uint64))
                _, first = np.unique(told, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(th[first]), pa.array(h[first].view(np.int64)), _rows(words[first])], names=["th", "h", "words"])

    return run


def _agree_batches(batches):
    for batch in batches:
        words, own = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BEFORE + AFTER) for c in (2, 3))
        keep = may_agree(words, own) | (batch.column(4).to_numpy() < MIN_WORDS)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _verify_batches(batches):
    last, codes = None, None
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for th, item, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if th != last:
                last, codes = th, word_codes(text)
            got = leak(codes, word_codes(own))
            if got:
                for column, value in zip(rows, (th, item, *got), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows[:2]), *(pa.array(r, pa.int32()) for r in rows[2:])], names=["th", "item", "matched", "start", "end"])


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def leaked_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """th (the hash of a text) and leaks, an array of (item_id, matched, start, end), of each text that holds some of the benchmark."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), _text(item_text).alias("text")).distinct().withColumn("item", F.xxhash64("text"))
    own = materialize(items.select("item", "text").dropDuplicates(["item"]), "items")
    table = materialize(own.select("item", "text").mapInArrow(tidy(_seed_batches), "h long, item long, size int, own binary").dropDuplicates(["h", "item", "own"]), "seeds")
    # At most MIN_WORDS - 1 of them.
    sizes = tuple(sorted(r["size"] for r in table.where(F.col("size") < MIN_WORDS).select("size").distinct().collect()))
    held = spark.sparkContext.broadcast(_bit_table(table))
    rows = docs.select(F.xxhash64(_text(text)).alias("th"), _text(text).alias("text"))
    hits = rows.mapInArrow(tidy(_hit_batches(held, sizes)), "th long, h long, words binary").distinct()
    beside = hits.join(table, "h").select("th", "item", "words", "own", "size")
    pairs = materialize(beside.mapInArrow(tidy(_agree_batches), "th long, item long").distinct(), "pairs")
    met = materialize(pairs.select("th").distinct(), "met")
    texts = semi(rows, met, "th").groupBy("th").agg(F.min("text").alias("text"))
    told = pairs.join(own.select("item", F.col("text").alias("own")), "item").join(texts, "th").select("th", "item", "text", "own")
    leaks = told.mapInArrow(tidy(_verify_batches), "th long, item long, matched int, start int, end int").join(items.select("item", "id"), "item")
    entry = F.struct(F.col("id").alias("item_id"), "matched", "start", "end")
    out = materialize(leaks.groupBy("th").agg(F.array_sort(F.collect_list(entry)).alias("leaks")), "leaks")
    for part in (own, table, pairs, met):
        discard(part)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "leaks") -> DataFrame:
    """All columns of ``docs`` and ``into``: an array of (item_id, matched, start, end), in words of the document."""
    found = leaked_texts(docs, benchmark, text, item_id, item_text)
    rows = docs.drop(into)
    th, got = unused(rows, "th", "leaks")
    leaks = found.toDF(th, got)
    joined = rows.withColumn(th, F.xxhash64(_text(text))).join(if_small(leaks, 16), th, "left")
    return joined.select(*rows.columns, F.coalesce(got, F.array().cast(leaks.schema[got].dataType)).alias(into))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, most_words and item_ids (text) of every document."""
    found = leaked_texts(docs, benchmark, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(_text(text)).alias("th"))
    told = rows.join(if_small(found, 16), "th", "left")
    ids = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return told.select(
        "doc_id",
        F.col("leaks").isNotNull().alias("contaminated"),
        F.coalesce(F.size(ids), F.lit(0)).alias("n_items"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["matched"])), F.lit(0)).alias("most_words"),
        F.coalesce(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark."""
    th = unused(docs, "th")[0]
    found = leaked_texts(docs, benchmark, text).select("th").toDF(th)
    return docs.withColumn(th, F.xxhash64(_text(text))).join(if_small(found), th, "left_anti").select(*docs.columns)
