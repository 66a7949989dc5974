"""Substring dedup: near-duplicate passages through compact windows.

A document is the sequence of its word-shingle hashes. For each of ``HASHES`` hash functions,
position c with the window [l, r] stands for all subsequences within [l, r] that contain c:
they share c's hash as their min-hash. These compact windows are the nodes of the Cartesian
tree over the hashes; only those at least ``MIN_WORDS`` words long are kept, about two for
every length of passage. Documents with windows of equal min-hash are paired, the pairs that
meet in ``NEEDED`` hash functions over a common interval are verified on their texts, and
stretches with a Jaccard similarity of ``SIMILARITY`` or more are repeated passages.

Exact copies are put together first, by the 64-bit hash of the text, and only one of each is searched. In a group of
at most ``SMALL_GROUP`` documents with one min-hash, all are paired. In a larger one each is paired with the least, and
again within the groups of those that also share the min-hash of another function near by, by the same rule. What
that links is one component. All pairs that two functions' min-hashes bring together and that are not yet in one component
are then compared too, whatever the size of their groups (see ``_large_across``): no two documents that meet and hold
a passage in common are in different components. Pairs within a component need not all be listed as partners.

Cases: null and empty texts, and those shorter than a passage, have no windows; rows with one text, whatever
their ids, are one class, searched even if none has an id (it is then nobody's partner by id); rows with one id and
different texts are told apart; an empty table gives an empty result. Texts are read whole, of any length: a text of
more than ``BATCH_WORDS`` words is taken by itself. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, if_small, join_hot, materialize, semi, tidy
from .components import components

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
HASHES, NEEDED = 4, 2
#: Documents of a min-hash that are all paired, at most; windows to either side that give second groups of a large one.
SMALL_GROUP, NEIGHBOURS = 32, 4
#: Windows of a pair beyond which it goes to verification as it is.
MANY = 12
BATCH_WORDS = 1 << 20

_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) for i in range(64)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def shingles(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += codes[i : i + n] * _ODD[i]
    return _mix(total)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width``."""
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def whole_runs(lengths: list[int], width: int) -> np.ndarray:
    """Which runs of ``width`` over documents laid end to end lie within one document."""
    n = np.array(lengths, dtype=np.int64)
    left = np.repeat(np.cumsum(n), n) - np.arange(int(n.sum()))
    return left[: max(0, len(left) - width + 1)] >= width


def compact_windows(values: np.ndarray, lengths: list[int], width: int, inside: np.ndarray | None = None):
    """(document, l, c, r, value) of all windows of ``width`` or more, over documents laid end to end.

    The nodes of the Cartesian tree with such windows are just the minima of runs of that width,
    and what bounds their windows are such minima too; so the tree is built over these alone.
    """
    n = len(values)
    if n < width:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    inside = whole_runs(lengths, width) if inside is None else inside
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # The place breaks ties: as many low bits as the batch is long take it.
    at_bits = np.uint64(max(1, int(n).bit_length()))
    keyed = (values >> at_bits << at_bits) | np.arange(n, dtype=np.uint64)
    kept = sliding_least(keyed, width)[inside]
    if not len(kept):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    # Neighbouring runs mostly share their minimum.
    fresh = np.concatenate([[True], kept[1:] != kept[:-1]])
    nodes = np.unique((kept[fresh] & np.uint64((1 << int(at_bits)) - 1)).astype(np.int64))
    owner = np.searchsorted(ends, nodes, side="right")
    left, right = starts[owner].tolist(), (ends[owner] - 1).tolist()
    keys, places, owners = keyed[nodes].tolist(), nodes.tolist(), owner.tolist()
    stack: list[int] = []
    for i in range(len(places)):
        if stack and owners[stack[-1]] != owners[i]:
            stack.clear()
        while stack and keys[stack[-1]] > keys[i]:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    base = starts[owner]
    return owner, np.array(left) - base, nodes - base, np.array(right) - base, values[nodes]


def _bucket_bits(size: int) -> int:
    """Leading bits of a shingle's hash that make its bucket, for texts of ``size`` bytes: a bucket has some four million shingles."""
    return min(14, max(2, (size // 6 >> 22).bit_length()))


def _collected(batches, lead: int = 0):
    """Texts (doc, text, ...) long enough for a passage, as (rows of their first ``lead`` columns but the text, shingles) of about BATCH_WORDS shingles."""
    rows, seqs, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            more = [part.column(c).to_pylist() for c in (0, *range(2, 2 + lead))]
            for row, text in zip(zip(*more, strict=True), part.column(1).to_pylist(), strict=True):
                seq = shingles(word_codes(text or ""))
                if len(seq) >= MIN_WORDS - SHINGLE + 1:
                    rows.append(row)
                    seqs.append(seq)
                    size += len(seq)
                if size >= BATCH_WORDS:
                    yield rows, seqs
                    rows, seqs, size = [], [], 0
    if seqs:
        yield rows, seqs


BUCKETED = "batch long, bucket int, docs array<long>, counts binary, grps binary, data binary"
_BUCKETED = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("docs", pa.list_(pa.int64())), ("counts", pa.binary()), ("grps", pa.binary()), ("data", pa.binary())])


def _bucket_batches(bits: int, grouped: bool):
    """Of each batch of texts (doc, text, and grp or nothing) a row for each bucket of hashes: 32 bits of each, in order, and as many of
    their groups'; and a row with bucket -1: the bucket of each place.

    Of a shingle that a text has at several places one place counts; the others are in no bucket (2^16 - 1).
    """

    def run(batches):
        for rows, seqs in _collected(batches, int(grouped)):
            flat, lengths = np.concatenate(seqs), np.array([len(x) for x in seqs], np.int64)
            owner = np.repeat(np.arange(len(seqs), dtype=np.uint64), lengths)
            keyed = (flat >> np.uint64(24) << np.uint64(24)) | owner
            order = np.argsort(keyed)
            again = order[1:][keyed[order[1:]] == keyed[order[:-1]]]
            bucket = (flat >> np.uint64(64 - bits)).astype(np.uint16)
            bucket[again] = np.iinfo(np.uint16).max
            order = np.argsort(bucket, kind="stable")[: len(flat) - len(again)]
            ends = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            values = (flat[order] >> np.uint64(32 - bits)).astype("<u4")
            full = np.nonzero(np.diff(ends))[0].tolist()
            grps = [None] * len(full)
            if grouped:
                own = _mix(np.array([r[1] for r in rows], np.int64).view(np.uint64)).astype("<u4")[owner[order].astype(np.int64)]
                grps = [own[ends[i] : ends[i + 1]].tobytes() for i in full]
            batch = int(np.bitwise_xor.reduce(_mix(np.array([r[0] for r in rows], np.int64).view(np.uint64))).view(np.int64))
            data = [bucket.astype("<u2").tobytes(), *(values[ends[i] : ends[i + 1]].tobytes() for i in full)]
            n = len(full) + 1
            listed = [[r[0] for r in rows], *[None] * (n - 1)]
            counts = [lengths.astype("<i8").tobytes(), *[None] * (n - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([batch] * n, pa.int64()), pa.array([-1, *full], pa.int32()), pa.array(listed, pa.list_(pa.int64())), pa.array(counts, pa.binary()), pa.array([None, *grps], pa.binary()), pa.array(data, pa.binary())], schema=_BUCKETED)

    return run


def _told_twice(table: pa.Table) -> pa.Table:
    """For each row (batch, bucket, grps, data) of a bucket, a bit for each hash: whether it is there more than once, and of more than one group if they have such."""
    data = [np.frombuffer(x.as_py(), "<u4") for x in table.column("data")]
    flat = np.concatenate(data)
    if table.column("grps").null_count:
        order = np.argsort(flat)
        same = flat[order[1:]] == flat[order[:-1]]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    else:
        grps = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("grps")])
        order = np.argsort(flat.astype(np.uint64) << np.uint64(32) | grps)
        start = np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])
        first = np.flatnonzero(start)
        last = np.concatenate([first[1:], [len(flat)]]) - 1
        shared = (grps[order[first]] != grps[order[last]])[np.cumsum(start) - 1]
    bits = np.zeros(len(flat), bool)
    bits[order] = shared
    ends = np.cumsum([len(x) for x in data])
    masks = [np.packbits(bits[e - len(x) : e]).tobytes() for e, x in zip(ends.tolist(), data, strict=True)]
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "data": pa.array(masks, pa.binary())})


def dense_starts(live: np.ndarray, lengths: list[int]) -> np.ndarray:
    """By place, over documents laid end to end: whether a run as long as a passage starts there of which enough is ``live``.

    Of a passage's places at most the rest to SIMILARITY have shingles that no other text has. A run of twice ``width`` places
    or more has a part of ``width`` or more of which as large a share is live: so runs of less than that tell.
    """
    width = MIN_WORDS - SHINGLE + 1
    out = np.zeros(len(live), bool)
    ends = np.cumsum(lengths)
    num, den = round(SIMILARITY * 20), 20
    gain = np.concatenate([[0], np.cumsum(den * live.astype(np.int64) - num)])
    left = np.repeat(ends, lengths) - np.arange(len(live))
    for length in range(width, 2 * width):
        here = len(live) - length + 1
        if here <= 0:
            break
        out[:here] |= (gain[length:] >= gain[:-length]) & (left[:here] >= length)
    return out


def _edges(flags: np.ndarray) -> np.ndarray:
    """Start, end (exclusive), start, end ... of the runs of ``flags``."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))


def _dense_ranges(table: pa.Table) -> pa.Table:
    """(doc, dense) of a batch's rows: pairs start, end (exclusive) of where runs of ``dense_starts`` start; only texts with such."""
    bucket = table.column("bucket").to_numpy()
    head = int(np.nonzero(bucket == -1)[0][0])
    at = np.frombuffer(table.column("data")[head].as_py(), "<u2")
    lengths = np.frombuffer(table.column("counts")[head].as_py(), "<i8")
    docs = np.array(table.column("docs")[head].as_py(), np.int64)
    sizes = np.bincount(at, minlength=1 << 16)
    places = np.argsort(at, kind="stable")
    first = np.cumsum(sizes) - sizes
    live = np.ones(len(at), bool)
    for i in np.nonzero(bucket >= 0)[0].tolist():
        k = int(bucket[i])
        mask = np.unpackbits(np.frombuffer(table.column("data")[i].as_py(), np.uint8), count=int(sizes[k]))
        live[places[first[k] : first[k] + sizes[k]]] = mask.astype(bool)
    flags = dense_starts(live, lengths.tolist())
    # A run of starts ends before the last place of its text: so no run goes from one text to the next.
    edges = _edges(flags)
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, edges[::2], side="right")
    local = edges - np.repeat((ends - lengths)[owner], 2)
    own, where = np.unique(owner, return_index=True)
    offsets = np.concatenate([2 * where, [len(local)]]).astype(np.int32)
    return pa.table({"doc": pa.array(docs[own]), "dense": pa.ListArray.from_arrays(pa.array(offsets), pa.array(local.astype(np.int32)))})


def _dense(texts: DataFrame, size: int) -> DataFrame:
    """(doc, dense) of the ``texts`` (doc, text), of ``size`` bytes in all, that may hold a passage that another one has; if they have a grp, one of another group.

    A shingle that no other text has is in no passage in common. Hashes meet by buckets, as bits go back to their batches; nothing
    is held whole anywhere.
    """
    grouped = "grp" in texts.columns
    rows = texts.select("doc", "text", *["grp"] * grouped)
    held = materialize(rows.mapInArrow(tidy(_bucket_batches(_bucket_bits(size), grouped)), BUCKETED), "hashes", compression="uncompressed")
    told = held.where("bucket >= 0").select("batch", "bucket", "grps", "data").groupBy("bucket").applyInArrow(_told_twice, "batch long, bucket int, data binary")
    every = held.where("bucket < 0").drop("grps").unionByName(told, allowMissingColumns=True)
    out = materialize(every.groupBy("batch").applyInArrow(_dense_ranges, "doc long, dense array<int>"), "dense")
    discard(held)
    return out


def _holds(left: str, right: str) -> Column:
    """Whether a run that starts within ``dense`` lies from ``left`` to ``right``."""
    last = F.col(right) - (MIN_WORDS - SHINGLE)
    at = F.filter("dense", lambda _, i: i % 2 == 0)
    return F.exists(F.arrays_zip(at.alias("s"), F.filter("dense", lambda _, i: i % 2 == 1).alias("e")), lambda x: F.greatest(x["s"], F.col(left)) < F.least(x["e"], last))


def _window_batches(batches):
    """Windows of texts (doc, text, dense) in which a run of ``dense_starts`` lies."""
    width = MIN_WORDS - SHINGLE + 1
    for rows, seqs in _collected(batches, 1):
        lengths, ids = [len(s) for s in seqs], np.array([r[0] for r in rows], np.int64)
        flat, inside = np.concatenate(seqs), whole_runs(lengths, width)
        starts = np.cumsum(lengths) - lengths
        turns = np.zeros(len(flat) + 1, np.int64)
        for start, (_, dense) in zip(starts.tolist(), rows, strict=True):
            turns[start + np.array(dense[::2], np.int64)] += 1
            turns[start + np.array(dense[1::2], np.int64)] -= 1
        before = np.concatenate([[0], np.cumsum(np.cumsum(turns[:-1]))])
        for k in range(HASHES):
            owner, left, at, right, value = compact_windows(_mix(flat ^ _ODD[10 + k]), lengths, width, inside)
            if len(owner):
                base = starts[owner]
                kept = before[base + right - width + 2] > before[base + left]
                owner, left, at, right, value = (x[kept] for x in (owner, left, at, right, value))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_mix(value + _ODD[30 + k]).view(np.int64)), pa.array(ids[owner]), pa.array(np.full(len(owner), k, np.int8)), *(pa.array(x.astype(np.int32)) for x in (left, at, right))],
                    names=["v", "doc", "k", "l", "c", "r"],
                )


def meeting(sizes: np.ndarray, k: np.ndarray, la: np.ndarray, ra: np.ndarray, lb: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """For each pair, with ``sizes`` windows (k, la, ra, lb, rb) laid end to end: whether NEEDED hash functions' meet.

    What two functions agree on as the least of a passage, the passage lies within the windows of both: so those overlap by
    its length, in either document. Pairs of more than MANY windows are taken to meet; verification tells.
    """
    width, out = MIN_WORDS - SHINGLE + 1, sizes > MANY
    few = np.nonzero(~out)[0]
    n, starts = sizes[few], (np.cumsum(sizes) - sizes)[few]
    # Each window of a pair beside each of the same pair.
    of = np.repeat(np.arange(len(few)), n * n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
    i, j = starts[of] + place // n[of], starts[of] + place % n[of]
    over = (np.minimum(ra[i], ra[j]) - np.maximum(la[i], la[j]) + 1 >= width) & (np.minimum(rb[i], rb[j]) - np.maximum(lb[i], lb[j]) + 1 >= width)
    # By window: the functions that overlap it, as bits.
    functions = np.zeros(int(n.sum()) if len(n) else 0, np.int64)
    np.bitwise_or.at(functions, (np.cumsum(n) - n)[of[over]] + place[over] // n[of[over]], np.int64(1) << k[j[over]].astype(np.int64))
    enough = np.bitwise_count(functions) >= NEEDED
    out[few[np.repeat(np.arange(len(few)), n)[enough]]] = True
    return out


def verify(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Passages (a_from, a_to, b_from, b_to), in words, end exclusive, of the shingle sequences a and b.

    A stretch of a that b shares, and each place where b has of it, are compared; where they are too unlike, the
    stretch is divided at its widest gap and its parts are tried, down to the length of a passage.
    """
    width, out = MIN_WORDS - SHINGLE + 1, []
    if len(a) < width or len(b) < width:
        return out
    values, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = codes[: len(a)], codes[len(a) :]
    mark = np.zeros(len(values), bool)
    mark[cb] = True
    shared = mark[ca]
    todo = _stretches(shared, width)
    while todo:
        s, e = todo.pop()
        piece, found = np.zeros(len(values), bool), False
        piece[ca[s:e]] = True
        size = np.count_nonzero(piece)
        for p, q in _stretches(piece[cb], width):
            other = np.zeros(len(values), bool)
            other[cb[p:q]] = True
            inter = np.count_nonzero(piece & other)
            if inter >= SIMILARITY * (size + np.count_nonzero(other) - inter):
                out.append((s, e + SHINGLE - 1, p, q + SHINGLE - 1))
                found = True
        if not found:
            hits = s + np.nonzero(shared[s:e])[0]
            gaps = np.diff(hits)
            if len(gaps) and gaps.max() > 1:
                i = int(np.argmax(gaps))
                todo += [(x, y) for x, y in ((s, int(hits[i]) + 1), (int(hits[i + 1]), e)) if y - x >= width]
    return sorted(set(out))


def _stretches(hit: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches of ``width`` or more that start and end in a hit and have no gap longer than a fifth of it."""
    return _runs(np.nonzero(hit)[0], width)


def _runs(at: np.ndarray, width: int) -> list[tuple[int, int]]:
    if not len(at):
        return []
    most = round((1 - SIMILARITY) * MIN_WORDS)
    cut = np.nonzero(np.diff(at) > most)[0]
    return [(int(at[s]), int(at[e]) + 1) for s, e in zip([0, *(cut + 1)], [*cut, len(at) - 1], strict=True) if at[e] + 1 - at[s] >= width]


PASSAGE = "array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>"
_PASSAGE_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to")]))


def _meet_batches(batches):
    for batch in batches:
        ws = batch.column(batch.num_columns - 1)
        flat = ws.flatten()
        keep = meeting(np.diff(ws.offsets.to_numpy()), *(flat.field(n).to_numpy(zero_copy_only=False) for n in ("k", "la", "ra", "lb", "rb")))
        yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))


def _sequence_batches(batches):
    """The shingles of each text, 32 bits of each: enough to compare two texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            seqs = [(shingles(word_codes(t)) >> np.uint64(32)).astype("<u4").tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seqs, pa.binary())], names=["doc", "seq"])


def _verify_batches(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            a, b, star, af, bf, sa, sb = (batch.column(c)[i].as_py() for c in range(7))
            got = verify(np.frombuffer(sa, "<u4"), np.frombuffer(sb, "<u4"))
            if got:
                rows = pa.array([[dict(zip(("a_from", "a_to", "b_from", "b_to"), (x[0] + af, x[1] + af, x[2] + bf, x[3] + bf), strict=True)) for x in got]], _PASSAGE_ARROW)
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), pa.array([star]), rows], names=["a", "b", "star", "passages"])


def _pair_rows(x: str, y: str, star: bool) -> list[Column]:
    ends = [F.col(f"{s}.{c}").alias(f"{c}{n}") for s, n in ((x, "a"), (y, "b")) for c in ("l", "r")]
    return [F.col(f"{x}.doc").alias("a"), F.col(f"{y}.doc").alias("b"), F.col(f"{y}.k").alias("k"), *ends, F.lit(star).alias("star")]


def _within(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of the rows of each ``key``: all of groups of at most SMALL_GROUP documents, with the least document in larger ones."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("doc", "k", "l", "r")).alias("lead"))
    sizes = materialize(sizes.where("n > 1"), "sizes")
    large, small = sizes.where(F.col("n") > SMALL_GROUP).select(key, "lead"), sizes.where(F.col("n") <= SMALL_GROUP).select(key)
    cold = rows.join(if_small(large.select(key)), key, "left_anti").join(small, key, "left_semi")
    every = cold.alias("x").join(cold.alias("y"), F.col(f"x.{key}") == F.col(f"y.{key}")).where("x.doc < y.doc").select(*_pair_rows("x", "y", False))
    hot = rows.join(if_small(large, 5), key).where("doc > lead.doc").select("lead", F.struct("doc", "k", "l", "r").alias("own"))
    return every.unionByName(hot.select(*_pair_rows("lead", "own", True)))


PAIR = "a long, b long, star boolean, af int, at int, bf int, bt int"


def _spans(windows: DataFrame) -> DataFrame:
    """What the windows of one min-hash that a document has span, for min-hashes of more than one document."""
    shared = materialize(windows.groupBy("v").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("v"), "shared")
    met = materialize(windows.join(shared, "v", "left_semi"), "met")
    discard(windows)
    spans = materialize(met.groupBy("v", "doc").agg(F.first("k").alias("k"), F.min("l").alias("l"), F.max("r").alias("r"), F.min("c").alias("c")), "spans")
    discard(met)
    discard(shared)
    return spans


def _meeting(pairs: DataFrame) -> DataFrame:
    """Of rows for each pair and window, the pairs whose windows of enough hash functions meet, and what those span."""
    ends = [f("l" + x if f is F.min else "r" + x).alias(x + t) for x in "ab" for f, t in ((F.min, "f"), (F.max, "t"))]
    listed = pairs.groupBy("a", "b").agg(F.collect_list(F.struct("k", "la", "ra", "lb", "rb")).alias("ws"), F.min("star").alias("star"), F.bit_or(F.expr("shiftleft(1, k)")).alias("ks"), *ends)
    enough = listed.where(F.bit_count("ks") >= NEEDED).select("a", "b", "star", "af", "at", "bf", "bt", "ws")
    return materialize(enough.mapInArrow(tidy(_meet_batches), PAIR), "pairs")


def candidates(spans: DataFrame) -> DataFrame:
    """(a, b, star, af, at, bf, bt), a < b: documents whose windows of enough hash functions meet, and what those span.

    star: known from a large group only.
    """
    hot = materialize(spans.groupBy("v").count().where(F.col("count") > SMALL_GROUP).select("v"), "hot")
    # In a large group, those that also share the min-hash of another function near by make groups of their own.
    within = spans.join(if_small(hot), "v", "left_semi").select("doc").distinct()
    near = F.collect_list(F.struct("v", "k", "l", "r")).over(Window.partitionBy("doc").orderBy("c", "k", "v").rowsBetween(-NEIGHBOURS, NEIGHBOURS))
    around = semi(spans, within, "doc").withColumn("near", near).join(if_small(hot), "v", "left_semi").withColumn("o", F.explode("near"))
    width = MIN_WORDS - SHINGLE + 1
    around = around.where((F.col("o.k") != F.col("k")) & (F.least("r", "o.r") - F.greatest("l", "o.l") + 1 >= width))
    second = around.select(F.xxhash64("v", "o.v").alias("w"), "doc", "k", "l", "r").dropDuplicates(["w", "doc"])
    out = _meeting(_within(spans.drop("c"), "v").unionByName(_within(second, "w")))
    discard(hot)
    return out


def _divided(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc, grp) of the keys whose documents are in more than one group; main: the group of most of them, size: their number."""
    sizes = rows.groupBy(key, "grp").count().groupBy(key).agg(F.max_by("grp", F.struct("count", "grp")).alias("main"), F.sum("count").alias("size"), F.count("*").alias("n"))
    return rows.join(sizes.where("n > 1").drop("n"), key)


def _crossed(met: DataFrame) -> DataFrame:
    """Pairs (a, b, af, at, bf, bt) of joined rows x and y (doc, l, r)."""
    ahead = F.col("x.doc") < F.col("y.doc")
    ends = [F.when(ahead, F.col(f"{s}.{c}")).otherwise(F.col(f"{t}.{c}")).alias(n) for s, t, n in (("x", "y", "a"), ("y", "x", "b")) for c, n in (("l", n + "f"), ("r", n + "t"))]
    return met.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"), *ends)


def _all_across(rows: DataFrame) -> DataFrame:
    """All pairs of the ``rows`` of each w, as of ``_divided``, that are in different groups: those outside the main one meet all."""
    met = rows.where("grp != main").alias("x").join(rows.alias("y"), F.col("x.w") == F.col("y.w"))
    return _crossed(met.where((F.col("x.grp") != F.col("y.grp")) & ((F.col("y.grp") == F.col("y.main")) | (F.col("x.doc") < F.col("y.doc")))))


def _shingle_batches(batches):
    """(doc, grp, s, at): a row for each shingle of each text (doc, grp, part: its shingles), with one of its places."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            seqs = [np.frombuffer(x, "<u4") for x in part.column(2).to_pylist()]
            of = np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])
            flat = np.concatenate(seqs)
            place = np.arange(len(of)) - np.searchsorted(of, of)
            fresh = np.unique(of.astype(np.uint64) << np.uint64(32) | flat, return_index=True)[1]
            rows = [part.column(c).take(pa.array(of[fresh])) for c in range(2)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(flat[fresh].view(np.int32)), pa.array(place[fresh].astype(np.int32))], names=["doc", "grp", "s", "at"])


def _long_batches(batches):
    """(doc, dense) of the rows (doc, l, size, dead), of so many places from l on, of which enough are not ``dead`` for a passage."""
    for batch in batches:
        found = []
        for start, size, dead in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            live = np.ones(size, bool)
            live[np.array(dead, np.int64)] = False
            found.append((start + _edges(dense_starts(live, [size]))).tolist())
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc", "dense"])
        yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))


def _large_across(rows: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """All pairs of the ``rows`` of each w, as ``_all_across``, of which ``verify`` may find a passage.

    The texts' shingles are looked at once, whatever the number of their rows. Shingles that at most SMALL_GROUP texts have make
    groups, of which those meet that have a w in common. A pair without such a shingle can only have a passage of the others: then
    both have enough of these in a run as long as a passage, and all those meet by w.
    """
    spans = materialize(rows.groupBy("doc", "grp").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.collect_set("w").alias("ws")), "whole")
    held = semi(texts, spans.select("doc"), "doc").select("doc", "text").mapInArrow(tidy(_sequence_batches), "doc long, seq binary")
    parts = spans.drop("ws").join(held, "doc").select("doc", "grp", F.expr("substring(seq, l * 4 + 1, (r - l + 1) * 4)").alias("part"))
    every = materialize(parts.mapInArrow(tidy(_shingle_batches), "doc long, grp long, s int, at int"), "every")
    keys = every.groupBy("s").agg(F.count("*").alias("n"), (F.min("grp") != F.max("grp")).alias("mixed"))
    keys = materialize(keys.where("n > 1 and mixed"), "keys")
    rare = materialize(every.join(if_small(keys.where(F.col("n") <= SMALL_GROUP).select("s")), "s").select("s", "doc", "grp"), "rare")
    met = rare.alias("x").join(rare.alias("y"), "s").where((F.col("x.doc") < F.col("y.doc")) & (F.col("x.grp") != F.col("y.grp")))
    met = materialize(met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct(), "near")
    sides = [spans.select(F.col("doc").alias(x), F.col("l").alias(x + "f"), F.col("r").alias(x + "t"), F.col("ws").alias("w" + x)) for x in "ab"]
    near = met.join(sides[0], "a").join(sides[1], "b").where(F.arrays_overlap("wa", "wb")).select("a", "b", "af", "at", "bf", "bt")
    common = if_small(keys.where(F.col("n") > SMALL_GROUP).select("s"))
    # What is not common is dead; a text without such is not missing.
    dead = every.join(common, "s", "left_anti").groupBy("doc").agg(F.collect_list("at").alias("dead"))
    sized = spans.select("doc", "l", (F.col("r") - F.col("l") + 1).alias("size")).join(dead, "doc", "left").withColumn("dead", F.coalesce("dead", F.array().cast("array<int>")))
    long = materialize(sized.select("doc", "l", "size", "dead").mapInArrow(tidy(_long_batches), "doc long, dense array<int>"), "long")
    again = rows.select("w", "doc", "grp", "l", "r").join(if_small(long, 4), "doc").where(_holds("l", "r")).drop("dense")
    again = materialize(_divided(again, "w"), "again")
    out = [materialize(x, "across") for x in (near, _all_across(again).distinct())]
    for part in (spans, every, keys, rare, met, long, again):
        discard(part)
    return out


def _across(spans: DataFrame, groups: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Candidates, as of ``candidates``, between all documents that are not in one group (node, root) yet.

    Those that share the min-hashes of two functions over a common interval meet, whatever their number; pairs within a group
    are never made. Where a text has no run of shingles of other groups, none of these has a passage of it.
    """
    own = spans.join(if_small(groups.select(F.col("node").alias("doc"), "root"), 2), "doc", "left")
    own = materialize(own.select("v", "doc", "k", "l", "r", F.coalesce("root", "doc").alias("grp")), "grouped")
    met = materialize(_divided(own, "v").drop("main", "size"), "divided")
    involved = materialize(met.select("doc", "grp").distinct(), "involved")
    dense = _dense(semi(texts, involved.select("doc"), "doc").join(if_small(involved, 2), "doc"), size)
    # Others of a min-hash may have no such run.
    first = materialize(_divided(met.join(if_small(dense, 4), "doc").where(_holds("l", "r")), "v").drop("main", "size"), "divided")
    width = MIN_WORDS - SHINGLE + 1
    two = first.alias("x").join(first.alias("y"), F.col("x.doc") == F.col("y.doc")).where((F.col("x.k") < F.col("y.k")) & (F.least("x.r", "y.r") - F.greatest("x.l", "y.l") + 1 >= width))
    two = two.select(F.xxhash64("x.v", "y.v").alias("w"), "x.doc", F.greatest("x.l", "y.l").alias("l"), F.least("x.r", "y.r").alias("r"), "x.grp", "x.dense")
    two = materialize(two.where(_holds("l", "r")).drop("dense"), "two")
    told = materialize(_divided(two, "w"), "told")
    parts = [_all_across(told.where(F.col("size") <= SMALL_GROUP)), *_large_across(told.where(F.col("size") > SMALL_GROUP), texts)]
    pairs = reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(*[f(c).alias(c) for c, f in (("af", F.min), ("at", F.max), ("bf", F.min), ("bt", F.max))])
    out = materialize(pairs.select("a", "b", F.lit(False).alias("star"), "af", "at", "bf", "bt"), "pairs")
    for part in (own, met, involved, dense, first, two, told, *parts[1:]):
        discard(part)
    return out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, star, passages) of the ``pairs`` that have passages in common."""
    involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "involved")
    held = materialize(semi(texts, involved, "doc").select("doc", "text").mapInArrow(tidy(_sequence_batches), "doc long, seq binary"), "held")

    def part(side: str) -> Column:
        return F.substring("seq", F.col(f"{side}f") * 4 + 1, (F.col(f"{side}t") - F.col(f"{side}f") + 1) * 4).alias(f"s{side}")

    # Of either sequence only what the windows span goes on.
    with_a = pairs.join(held.withColumnRenamed("doc", "a"), "a").select("a", "b", "star", "af", "bf", "bt", part("a"))
    both = with_a.join(held.withColumnRenamed("doc", "b"), "b").select("a", "b", "star", "af", "bf", "sa", part("b"))
    found = materialize(both.mapInArrow(tidy(_verify_batches), f"a long, b long, star boolean, passages {PASSAGE}"), "found")
    for done in (involved, held, pairs):
        discard(done)
    return found


def repeated_passages(texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Verified passages (a, b, star, passages) of pairs of ``texts`` (doc, text: distinct numbers and texts, of about ``size`` bytes), a < b, and the groups (node, root) that they link."""
    dense = _dense(texts, size)
    searched = semi(texts, dense.select("doc"), "doc").join(if_small(dense, 4), "doc")
    windows = materialize(searched.select("doc", "text", "dense").mapInArrow(tidy(_window_batches), "v long, doc long, k byte, l int, c int, r int"), "windows")
    discard(dense)
    spans = _spans(windows)
    found = _verified(candidates(spans), texts)
    groups = components(found)
    rest = _verified(_across(spans, groups, texts, size), texts)
    discard(spans)
    found = found.unionByName(rest)
    if rest.limit(1).count():
        groups = components(found)
    return found, groups


def passage_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, copy_of, repeated, n_passages, passages (text), partners (list of ids), component_id.

    ``copy_of`` is the least id with the same text. ``passages`` are word ranges start-end of the
    document (end exclusive); ``partners`` are least ids of other texts that hold one of them. ``component_id`` is the
    least id that passages link the document to, directly or through others, its own copies included.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("doc", F.xxhash64("text"))
    # No more of a text is split than it takes to tell.
    long = F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+", MIN_WORDS)) >= MIN_WORDS
    narrow = materialize(rows.select("doc_id", "doc", long.alias("long"), F.octet_length("text").alias("bytes")), "copies")
    size = narrow.agg(F.sum("bytes")).first()[0] or 0
    order = F.struct(F.col("doc_id").isNull().alias("nd"), F.coalesce("doc_id", F.lit(0)).alias("k"))
    classes = materialize(narrow.groupBy("doc").agg(F.min("doc_id").alias("copy_of"), F.min(order).alias("rep"), F.count("*").alias("copies"), F.first("long").alias("long")), "classes")
    # One row of each class is searched: of the least id, and any of its equal rows.
    reps = classes.where("long").select("doc", F.col("rep.nd").alias("nd"), F.col("rep.k").alias("k"))
    keyed = rows.select("doc", "text", F.col("doc_id").isNull().alias("nd"), F.coalesce("doc_id", F.lit(0)).alias("k"))
    texts = keyed.join(if_small(reps, 3), ["doc", "nd", "k"], "left_semi").select("doc", "text")
    own = narrow.select("doc", F.col("doc_id").isNull().alias("nd"), F.coalesce("doc_id", F.lit(0)).alias("k"))
    if own.join(if_small(reps, 3), ["doc", "nd", "k"], "left_semi").groupBy("doc").count().where("count > 1").limit(1).count():
        texts = texts.groupBy("doc").agg(F.min("text").alias("text"))
    found, groups = repeated_passages(texts, size)
    p = found.select("a", "b", "star", F.explode("passages").alias("p"))
    ours = p.select(F.col("b").alias("doc"), F.col("a").alias("other"), F.col("p.b_from").alias("s"), F.col("p.b_to").alias("e"))
    theirs = p.select(F.col("a").alias("doc"), F.col("b").alias("other"), F.col("p.a_from").alias("s"), F.col("p.a_to").alias("e"), "star")
    # The least holder of a large group lists its own ranges once, with the least partner; all others list the holders they met.
    lead = theirs.where("star").groupBy("doc", "s", "e").agg(F.min("other").alias("other")).select("doc", "other", "s", "e")
    spans = ours.unionByName(theirs.where("not star").drop("star")).unionByName(lead)
    told = spans.join(classes.select(F.col("doc").alias("other"), F.col("copy_of").alias("partner")), "other")
    told = told.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"), F.array_sort(F.collect_set("partner")).alias("partners"))
    # A root has no row of its own.
    every = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    linked = every.join(classes.select(F.col("doc").alias("node"), "copy_of"), "node")
    linked = linked.join(linked.groupBy("root").agg(F.min("copy_of").alias("component_id")), "root").select(F.col("node").alias("doc"), "component_id")
    told = classes.join(told, "doc", "left").join(linked, "doc", "left").withColumn("component_id", F.coalesce("component_id", "copy_of"))
    members = join_hot(narrow.select("doc_id", "doc"), told.select("doc", "copy_of", "long", "copies", F.col("copies").alias("rows"), "spans", "partners", "component_id"), "doc", "rows", 64)
    return members.select(
        "doc_id",
        "copy_of",
        (F.col("spans").isNotNull() | (F.col("long") & (F.col("copies") > 1))).alias("repeated"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_passages"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["s"], x["e"])), ",").alias("passages"),
        F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"),
        "component_id",
    )
