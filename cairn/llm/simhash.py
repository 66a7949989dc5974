"""SimHash near-duplicates, linked through vantage-point trees.

A text's fingerprint is the bitwise majority of the XXH64 of its word shingles.
Fingerprints within ``radius`` bits are linked and components of links are groups.

The 64 bits are taken as ``halves`` blocks. Two fingerprints at most ``radius`` bits
apart are at most ``radius // halves`` apart in some block, so each block gets a
vantage-point tree over the distance in that block alone, which prunes far better than
the distance over all bits. The top of each tree is built from a bounded sample of
fingerprints and only routes: a fingerprint has one home shard and is also sent to each
shard whose boundary its ball crosses. Shards are counted, and those that are too large get a sample of
their own and are divided again, round by round, until none is (or none of its points divides it). A shard
grows its own tree below, prunes branches by the triangle inequality, verifies over all 64 bits, and returns a
spanning forest of the links it found, never the pairs themselves.

Cases: a null text counts as empty; texts without words have fingerprint zero and are
linked like any other; fewer words than a shingle make one shingle; repeated rows and
ids are all kept by ``simhash_groups``; a component of null ids only has a null component_id; an empty table
gives an empty result. ``keep_one`` keeps one row of each group: of the least id (null last), then the least
hash of the text, then of the whole row. Texts are read whole. Other columns, whatever their names, are kept by
``keep_one`` and ignored otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, if_small, join_hot, materialize, tidy, unused
from .components import components

SHINGLE, RADIUS, HALVES, SEED = 4, 4, 2, 42
#: Fingerprints that a shard should have at home, and how many times that it may have; those of the sample for each shard, and at most in a round.
SHARD_SIZE, SHARD_EXCESS, SAMPLE_EACH, SAMPLE_MOST = 8192, 4, 64, 1 << 18
LEAF = 64
#: Least share by which a node's larger side must shrink for it to be split.
MIN_SPLIT = 0.05


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):
        total += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprint_batches(shingle: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = np.array([fingerprint(t, shingle) for t in part.column(2).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got.view(np.int64))], names=["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text, null as empty) and fp of every row."""
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(words).alias("th"), words.alias("text"))
    return chosen.mapInArrow(tidy(_fingerprint_batches(shingle)), "doc_id long, th long, fp long")


def _distance(a: np.ndarray, b, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).astype(np.int16)


def _split(points: np.ndarray, mask: np.uint64):
    """A vantage point, its radius and the distances; None if no point divides them well."""
    best = None
    for i in np.linspace(0, len(points) - 1, 5).astype(int):
        d = _distance(points, points[i], mask)
        mu = int(np.median(d))
        inner = np.count_nonzero(d <= mu)
        if inner == len(points):
            mu -= 1
            inner = np.count_nonzero(d <= mu)
        even = min(inner, len(points) - inner) / len(points)
        if best is None or even > best[0]:
            best = (even, points[i], mu, d)
    return best[1:] if best[0] >= MIN_SPLIT else None


def grow(sample: np.ndarray, mask: np.uint64, levels: int, first: int = 0):
    """The routing top of a tree: nested (vantage, mu, inner, outer), shard numbers at the leaves; and the next number."""
    found = _split(sample, mask) if levels and len(sample) >= 8 else None
    if found is None:
        return first, first + 1
    vantage, mu, d = found
    inner, first = grow(sample[d <= mu], mask, levels - 1, first)
    outer, first = grow(sample[d > mu], mask, levels - 1, first)
    return (int(vantage), mu, inner, outer), first


def route(node, fps: np.ndarray, index: np.ndarray, home: np.ndarray, mask: np.uint64, radius: int, out: list) -> None:
    """Appends (shard, index, home) for every shard that the balls around ``fps[index]`` reach."""
    if not len(index):
        return
    if isinstance(node, int):
        out.append((node, index, home))
        return
    vantage, mu, inner, outer = node
    d = _distance(fps[index], np.uint64(vantage), mask)
    near, far = d - radius <= mu, d + radius > mu
    route(inner, fps, index[near], home[near] & (d[near] <= mu), mask, radius, out)
    route(outer, fps, index[far], home[far] & (d[far] > mu), mask, radius, out)


class Forest:
    """Least-label union of index pairs, a chunk of pairs at a time."""

    def __init__(self, n: int):
        self.label, self.held, self.size = np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.held.append((i, j))
            self.size += len(i)
            if self.size > 1_000_000:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            i, j = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            label = self.label
            while True:
                a, b = label[i], label[j]
                apart = a != b
                if not apart.any():
                    break
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = label[label]
                    if np.array_equal(up, label):
                        break
                    label = up
            self.label = label
        return self.label


def search(points: np.ndarray, own: np.ndarray, asked: np.ndarray, forest: Forest, mask: np.uint64, near: int, radius: int) -> None:
    """Links ``points[own]`` with all of ``points[asked]`` within ``radius``: a tree over own, branches pruned by ``near`` in the block."""
    stack = [(own, asked)]
    while stack:
        own, asked = stack.pop()
        if not len(own) or not len(asked):
            continue
        found = _split(points[own], mask) if len(own) > LEAF else None
        if found is None:
            step = max(1, 2_000_000 // len(own))
            for at in range(0, len(asked), step):
                q = asked[at : at + step]
                for part in range(0, len(own), 4096):
                    p = own[part : part + 4096]
                    i, j = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[p][None, :]) <= radius)
                    different = q[i] != p[j]
                    forest.add(q[i[different]], p[j[different]])
            continue
        vantage, mu, d = found
        dq = _distance(points[asked], vantage, mask)
        stack.append((own[d <= mu], asked[dq - near <= mu]))
        stack.append((own[d > mu], asked[dq + near > mu]))


def blocks(halves: int) -> list[np.uint64]:
    """Masks that share the 64 bits out."""
    edge = [64 * i // halves for i in range(halves + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edge, edge[1:], strict=False)]


def replace_leaves(node, fresh: dict):
    """The tree with the leaves named in ``fresh`` replaced."""
    if isinstance(node, int):
        return fresh.get(node, node)
    vantage, mu, inner, outer = node
    return vantage, mu, replace_leaves(inner, fresh), replace_leaves(outer, fresh)


def leaves(node) -> list[int]:
    return [node] if isinstance(node, int) else leaves(node[2]) + leaves(node[3])


def _homes(trees, masks):
    """(shard, fp): where each fingerprint is at home, in each tree."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree, mask in zip(trees, masks, strict=True):
                out: list = []
                route(tree, fps, np.arange(len(fps)), np.ones(len(fps), bool), mask, 0, out)
                for shard, index, home in out:
                    index = index[home]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), shard, np.int32)), pa.array(fps[index].view(np.int64))], names=["shard", "fp"])

    return run


def plant(nodes: DataFrame, masks: list[np.uint64]) -> list:
    """The routing top of a tree for each mask, grown in rounds until no shard that can be divided is too large."""
    trees, first, whole = list(range(len(masks))), len(masks), set()
    n = nodes.count()
    sizes = dict.fromkeys(trees, n)
    while True:
        large = [k for k, size in sizes.items() if size > (SHARD_SIZE if size == n else SHARD_EXCESS * SHARD_SIZE) and k not in whole]
        if not large:
            return trees
        room = max(1, int(math.log2(max(2, SAMPLE_MOST // (SAMPLE_EACH * len(large))))))
        levels = {k: min(room, math.ceil(math.log2(sizes[k] / SHARD_SIZE))) for k in large}
        homes = nodes.select("fp").mapInArrow(tidy(_homes(trees, masks)), "shard int, fp long")
        # Of each shard the share that gives its sample, by the fingerprints' own hash: about SAMPLE_MOST in all.
        share = nodes.sparkSession.createDataFrame([(k, int(2**31 * min(1.0, (SAMPLE_EACH << levels[k]) / sizes[k]))) for k in large], "shard int, upto long")
        picked = homes.join(F.broadcast(share), "shard").where(F.pmod(F.xxhash64("fp"), F.lit(2**31)) < F.col("upto")).select("shard", "fp").collect()
        by: dict[int, list[int]] = {k: [] for k in large}
        for r in picked:
            by[r["shard"]].append(r["fp"])
        owner = {k: t for t, tree in enumerate(trees) for k in leaves(tree)}
        fresh = {}
        for k in large:
            grown, after = grow(np.sort(np.array(by[k], dtype=np.int64)).view(np.uint64), masks[owner[k]], levels[k], first)
            if isinstance(grown, int):
                whole.add(k)
            else:
                fresh[k], first = grown, after
        trees = [replace_leaves(tree, fresh) for tree in trees]
        sizes = {r["shard"]: r["count"] for r in nodes.select("fp").mapInArrow(tidy(_homes(trees, masks)), "shard int, fp long").groupBy("shard").count().collect()}


def link(nodes: DataFrame, radius: int = RADIUS, halves: int = HALVES) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of links between the distinct ``fp`` of ``nodes``."""
    masks, near = blocks(halves), radius // halves
    trees = plant(nodes, masks)
    routing = nodes.sparkSession.sparkContext.broadcast((trees, masks))
    owner = {k: t for t, tree in enumerate(trees) for k in leaves(tree)}

    def deal(batches):
        trees, masks = routing.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree, mask in zip(trees, masks, strict=True):
                out: list = []
                route(tree, fps, np.arange(len(fps)), np.ones(len(fps), bool), mask, near, out)
                for shard, index, home in out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), shard, np.int32)), pa.array(fps[index].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def solve(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        points = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        forest = Forest(len(points))
        search(points, np.nonzero(home)[0], np.arange(len(points)), forest, masks[owner[shard]], near, radius)
        label = forest.settle()
        moved = np.nonzero(label != np.arange(len(points)))[0]
        return pa.table({"a": pa.array(points[moved].view(np.int64)), "b": pa.array(points[label[moved]].view(np.int64))})

    return nodes.select("fp").mapInArrow(tidy(deal), "shard int, fp long, home boolean").groupBy("shard").applyInArrow(solve, "a long, b long")


def _rooted(nodes: DataFrame, radius: int, halves: int) -> DataFrame:
    """``nodes`` with root, which tells their component."""
    roots = components(link(nodes, radius, halves))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def group_fingerprints(prints: DataFrame, radius: int = RADIUS, halves: int = HALVES) -> DataFrame:
    """doc_id, fp, component_id of every row of ``prints`` (doc_id, fp)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    rooted = materialize(_rooted(nodes, radius, halves), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = materialize(rooted.join(names, "root").select("fp", "component_id", "copies"), "placed")
    discard(nodes)
    discard(rooted)
    return join_hot(prints, placed, "fp", "copies").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = materialize(fingerprints(docs, doc_id, text, shingle), "prints")
    found = group_fingerprints(prints, radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``docs``, all columns: the least by id (null last), text hash and row."""
    prints = materialize(fingerprints(docs, doc_id, text, shingle), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("nd"), F.coalesce("doc_id", F.lit(0)).alias("k"), "th")
    nodes = materialize(prints.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("copies")), "nodes")
    best = _rooted(nodes, radius, HALVES).groupBy("root").agg(F.min("least").alias("least")).select("least.nd", "least.k", "least.th")
    names = unused(docs, "nd", "k", "th")
    best = materialize(best, "kept").toDF(*names)
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = (F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.xxhash64(words))
    out = docs.withColumns(dict(zip(names, keys, strict=True))).join(if_small(best, 3), names, "left_semi")
    own = prints.select(F.col("doc_id").isNull().alias("nd"), F.coalesce("doc_id", F.lit(0)).alias("k"), "th").toDF(*names)
    repeated = own.join(if_small(best, 3), names, "left_semi").groupBy(*names).count().where("count > 1").limit(1).count()
    discard(prints)
    discard(nodes)
    if not repeated:
        return out.select(*docs.columns)
    # Rows with one id and one text: the least of the rows' hashes, found before any shuffle of whole groups.
    hashed = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    least = out.groupBy(*names).agg(F.min_by(F.struct(*docs.columns), hashed).alias(unused(docs, "row")[0]))
    return least.select(f"{least.columns[-1]}.*")
