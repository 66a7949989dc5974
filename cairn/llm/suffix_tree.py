"""LM scoring with a probabilistic suffix tree over words.

Symbols are lower-cased words and one end symbol after each text; a text starts in the context
of an end. The root gives each symbol (c + 1) / (N + V + 1), from exact counts over all training
text. A context of up to ``DEPTH`` symbols that precedes ``LEAST`` training symbols or more becomes a
state if its next-symbol distribution diverges from that of the longest state it ends with by at
least ``DIVERGENCE`` (Kullback-Leibler, nats). A state keeps the symbols that follow it ``LEAST`` times
or more, less a discount; what is left over goes to the distribution of the state below. Each symbol
of a text is scored in the longest suffix of what came before that is a state. Every distribution
sums to one over the vocabulary and one unknown symbol. These are counts, not shares: the same context
with the same counts is a state in a corpus of any size, and the tree grows with the corpus.

So no process holds the tree. Texts are cut into blocks of about ``BLOCK_TOKENS`` symbols. In each of a few
rounds every block asks for what it cannot know by itself: how often its runs of d + 1 symbols occur in all
training text, and what is left over in the states of its contexts of d symbols. Requests are dealt out
by the hash of the run or context, a row for each block and part, answered there from those of all
blocks, and the answers go back in the order of the request. Only runs whose beginning and end are both known to occur
``LEAST`` times are asked for. Up to ``TREE_SYMBOLS`` training symbols the same tree is made on the driver instead.
Words, runs and contexts are told apart by 64-bit hashes: m of them collide with a chance of about m^2 / 2^65.

Cases: a null text counts as empty and has one symbol, the end; null ids are learned from and
kept; repeated rows count each time; an empty training set gives every symbol the chance 1; an empty
table gives an empty result. Texts are read whole; a text longer than a block is one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, discard, materialize, tidy

DEPTH = 3
#: Occurrences of a context, and of a symbol after it, from which on they count, at least.
LEAST = 2
#: Shares of the training symbols that they must have besides: none, so that rare contexts are not cut off.
CONTEXT_SHARE, JOINT_SHARE = 0.0, 0.0
DIVERGENCE, DISCOUNT = 0.02, 0.75
BLOCK_TOKENS = 1 << 21
#: Training symbols up to which the tree is made on the driver; symbols for each part of the requests.
TREE_SYMBOLS, PART_SYMBOLS = 1 << 20, 1 << 21
END = 0

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, often binary, codes binary, train long"


def pack(x: np.ndarray, steps: bool = False) -> bytes:
    """The bytes of numbers by their place (of the steps between sorted ones, with ``steps``), compressed, so that shuffles are small too."""
    if steps:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(blob: bytes, dtype: str, steps: bool = False) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=n * size, codec="zstd")
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if steps else x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ones of 64-bit hashes, sorted, a place of each, and the number of each place's. Sorts leading bits and places as one number."""
    low = np.uint64(max(1, len(x) - 1).bit_length())
    order = (x >> low << low) | np.arange(len(x), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << low) - np.uint64(1)
    order = order.astype(np.int32)
    ranked = x[order]
    if (ranked[1:] < ranked[:-1]).any():  # different ones with the same leading bits
        again = np.argsort(ranked, kind="stable")
        order, ranked = order[again], ranked[again]
    new = np.ones(len(x), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ranked[new], order[new], number


def symbols(text: str) -> np.ndarray:
    """Hashes of a text's words and the end."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _block_batches(batches):
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    ids: list = []
    held: list = []
    texts: list[np.ndarray] = []
    size = 0

    def flush():
        nonlocal seq, size
        flat = np.concatenate(texts)
        words, _, codes = distinct(flat)
        often = np.bincount(codes, minlength=len(words))
        # Codes by frequency compress better; the counts tell the order again.
        rank = np.empty(len(words), "<u4")
        rank[np.argsort(-often, kind="stable")] = np.arange(len(words))
        del flat
        lengths = [len(t) for t in texts]
        train = sum(n for n, h in zip(lengths, held, strict=True) if not h)
        row = pa.RecordBatch.from_arrays(
            [
                pa.array([part << 32 | seq]),
                pa.array([list(ids)], pa.list_(pa.int64())),
                pa.array([list(held)], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int32())),
                pa.array([pack(words, steps=True)], pa.binary()),
                pa.array([pack(often.astype("<u4"))], pa.binary()),
                pa.array([pack(rank[codes])], pa.binary()),
                pa.array([train]),
            ],
            names=["block", "doc_ids", "held", "lengths", "words", "often", "codes", "train"],
        )
        ids.clear(), held.clear(), texts.clear()
        seq, size = seq + 1, 0
        return row

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            cols = [c.to_pylist() for c in batch.slice(at, 512).columns]
            for doc_id, apart, text in zip(*cols, strict=True):
                got = symbols(text or "")
                ids.append(doc_id)
                held.append(bool(apart))
                texts.append(got)
                size += len(got)
                if size >= BLOCK_TOKENS:
                    yield flush()
    if ids:
        yield flush()


class Block:
    """One row of the blocks table."""

    def __init__(self, row: dict):
        self.ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.words = unpack(row["words"], "<u8", steps=True)
        self.codes = np.argsort(-unpack(row["often"], "<u4").astype(np.int64), kind="stable").astype(np.int32)[unpack(row["codes"], "<u4")]
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _entry_batches(batches):
    """(h, n): each word of a block's dictionary that its training texts have, and its count there."""
    for row in _rows(batches):
        b = Block(row | {"doc_ids": []})
        n = np.bincount(b.codes[b.training()], minlength=len(b.words))
        yield pa.RecordBatch.from_arrays([pa.array(b.words[n > 0].view(np.int64)), pa.array(n[n > 0])], names=["h", "n"])


class Tree:
    """States by depth. ``keys[d]`` sorts the contexts of depth d as symbol * contexts[d - 1] + context."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, types: int):
        order = np.argsort(words)
        self.words, self.counts, self.total, self.types = words[order], counts[order], total, types
        self.keys: list[np.ndarray] = []
        self.left: list[np.ndarray] = []  # by context: share left to the state below; 1 where it is no state
        self.pairs: list[np.ndarray] = []  # sorted (context * symbols + symbol)
        self.shares: list[np.ndarray] = []  # of the discounted count of each pair

    @property
    def sizes(self) -> list[int]:
        return [1, *(len(k) for k in self.keys)]

    def symbol_ids(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among those known, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def contexts(self, ids: np.ndarray, since: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each depth up to ``depth``, the context before each position, or -1; ``since``: symbols of the text before it."""
        out = [np.zeros(len(ids), np.int64)]
        end = self.symbol_ids(np.array([END], np.uint64))[0]
        for d in range(1, depth + 1):
            earlier = np.full(len(ids), -1, np.int64)
            earlier[d:] = ids[:-d] if d else ids
            earlier = np.where(since >= d, earlier, np.where(since == d - 1, end, -1))
            key = earlier * self.sizes[d - 1] + out[d - 1]
            known = self.keys[d - 1]
            if not len(known):
                out.append(np.full(len(ids), -1, np.int64))
                continue
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            out.append(np.where((earlier >= 0) & (out[d - 1] >= 0) & (known[at] == key), at, -1))
        return out

    def chances(self, ids: np.ndarray, since: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Chance of each symbol in its longest suffix state, given its chance at the root."""
        p = root.copy()
        for d, ctx in enumerate(self.contexts(ids, since, len(self.left))[1:]):
            on = np.nonzero(ctx >= 0)[0]
            if not len(on) or not len(self.left[d]):
                continue
            c = ctx[on]
            own = np.zeros(len(on))
            if len(self.pairs[d]):
                key = np.where(ids[on] >= 0, c * len(self.words) + ids[on], -1)
                at = np.minimum(np.searchsorted(self.pairs[d], key), len(self.pairs[d]) - 1)
                own = np.where(self.pairs[d][at] == key, self.shares[d][at], 0.0)
            p[on] = own + self.left[d][c] * p[on]
        return p


def _since(block: Block) -> np.ndarray:
    return np.arange(len(block.codes)) - np.repeat(block.starts, block.lengths)


def _follow_batches(tree: Tree, depth: int, what: str):
    """Counts over training positions. "contexts": of the contexts of ``depth``; "next": of what follows them."""

    def run(batches):
        for row in _rows(batches):
            b = Block(row)
            ids, since = tree.symbol_ids(b.words)[b.codes], _since(b)
            train = b.training()
            if what == "contexts":
                below = tree.contexts(ids, since, depth - 1)[-1]
                earlier = np.full(len(ids), -1, np.int64)
                earlier[depth:] = ids[:-depth]
                end = tree.symbol_ids(np.array([END], np.uint64))[0]
                earlier = np.where(since >= depth, earlier, np.where(since == depth - 1, end, -1))
                keep = train & (below >= 0) & (earlier >= 0)
                key = earlier[keep] * tree.sizes[depth - 1] + below[keep]
            else:
                ctx = tree.contexts(ids, since, depth)[-1]
                keep = train & (ctx >= 0) & (ids >= 0)
                key = ctx[keep] * len(tree.words) + ids[keep]
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return run


def _sums(blocks: DataFrame, tree: Tree, depth: int, what: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys with at least ``least`` occurrences, sorted, and their counts."""
    counted = blocks.select("lengths", "held", "words", "often", "codes", F.array().cast("array<long>").alias("doc_ids")).mapInArrow(tidy(_follow_batches(tree, depth, what)), "key long, n long")
    rows = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def judge(ctx: np.ndarray, joint: np.ndarray, under: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the pairs that contexts keep, and what each context leaves to the state below: 1 where it is no state.

    A pair: its context, its count, and its chance in the longest state that the context ends with; ``n``: counts of the contexts.
    """
    shares = (joint - DISCOUNT) / n[ctx]
    left = np.maximum(1 - np.bincount(ctx, weights=shares, minlength=len(n)), 1e-9)
    full = shares + left[ctx] * under
    # What the kept symbols and the rest, as one, contribute to the divergence.
    rest, rest_under = np.maximum(1 - np.bincount(ctx, weights=full, minlength=len(n)), 1e-12), np.maximum(1 - np.bincount(ctx, weights=under, minlength=len(n)), 1e-12)
    kl = np.bincount(ctx, weights=full * np.log(full / under), minlength=len(n)) + rest * np.log(rest / rest_under)
    return shares, np.where(kl >= DIVERGENCE, left, 1.0)


def learn(blocks: DataFrame, words: np.ndarray, counts: np.ndarray, total: int, types: int) -> Tree:
    """The tree over ``blocks``, whose words and counts are given."""
    tree = Tree(words, counts, total, types)
    base = (tree.counts + 1) / (total + types + 1)
    below = np.zeros(0)
    for depth in range(1, DEPTH + 1):
        if not total or not len(tree.words):
            break
        keys, n = _sums(blocks, tree, depth, "contexts", max(LEAST, CONTEXT_SHARE * total))
        tree.keys.append(keys)
        if not len(keys):
            tree.keys.pop()
            break
        pairs, joint = _sums(blocks, tree, depth, "next", max(LEAST, JOINT_SHARE * total))
        ctx, sym = pairs // len(tree.words), pairs % len(tree.words)
        # The chance of each pair in the longest state that the context ends with.
        parent = keys % tree.sizes[depth - 1]
        under = base[sym]
        if depth > 1:
            under = below_chance(tree, depth - 1, parent[ctx], sym, base)
        shares, left = judge(ctx, joint, under, n)
        state = left < 1
        on = state[ctx]
        tree.left.append(left)
        tree.pairs.append(pairs[on])
        tree.shares.append(shares[on])
    return tree


def below_chance(tree: Tree, depth: int, ctx: np.ndarray, sym: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Chance of ``sym`` in the longest state of a context at ``depth``."""
    chain = [ctx]
    for d in range(depth, 1, -1):
        chain.append(tree.keys[d - 1][chain[-1]] % tree.sizes[d - 1])
    p = base[sym]
    for d, c in enumerate(reversed(chain)):
        own = np.zeros(len(sym))
        if len(tree.pairs[d]):
            key = c * len(tree.words) + sym
            at = np.minimum(np.searchsorted(tree.pairs[d], key), len(tree.pairs[d]) - 1)
            own = np.where(tree.pairs[d][at] == key, tree.shares[d][at], 0.0)
        p = own + tree.left[d][c] * p
    return p


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What a block asks part ``to`` for. Even kinds 2d: counts of runs of d + 1 symbols (``keys``; ``n``: its own training counts). Odd
#: kinds 2d + 1: what contexts of d symbols leave (``keys``, ``n``: their counts), and the pairs it tells of: ``at`` among the keys, ``joint``, ``under``.
ASKED = "block long, kind int, to int, keys binary, n binary, at binary, joint binary, under binary"
#: The answer, in the order of the keys. Even kinds: count * 2 (0 below LEAST, but for words), plus 1 for the one block that is to tell of the pair; ``fresh``: different runs in training text.
ANSWERS = "block long, kind int, part int, got binary, fresh long"
_ODD, _ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs with one more word."""
    x = run * _ODD + word * _ODDER + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rounds:
    """What the tasks of a round need to know: number of parts as a power of two, training symbols, rounds ``done``, and after the first different symbols.

    Round 1 answers kind 0, round d + 1 kinds 2d and 2d - 1.
    """

    def __init__(self, bits: int, total: int, done: int = 0, types: int = 0):
        self.bits, self.total, self.done, self.types = bits, total, done, types
        self.least, self.joint = max(LEAST, CONTEXT_SHARE * total), max(LEAST, JOINT_SHARE * total)

    def cuts(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(part, from, to) of sorted keys; parts go by the leading bits."""
        begins = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits) if self.bits else np.zeros(1, np.uint64)
        at = np.append(np.searchsorted(keys, begins), len(keys))
        return [(k, int(at[k]), int(at[k + 1])) for k in range(1 << self.bits) if at[k] < at[k + 1]]

    def replay(self, block: Block, got: dict[int, list[bytes]]) -> tuple[list[tuple], tuple | None]:
        """Goes through a block as far as the answers (``got``, packed) reach: what to ask next, or the chances (root, p, known) of its symbols.

        What is kept for each symbol is small, and answers are unpacked one at a time, for a task holds all of a block at once.
        """
        asked: list[tuple] = []
        if not self.done:
            n = np.bincount(block.codes[block.training()], minlength=len(block.words))
            return [(0, k, block.words[s:e], n[s:e]) for k, s, e in self.cuts(block.words)], None

        def answered(kind: int) -> np.ndarray:
            return np.concatenate([np.zeros(0, "<f8" if kind % 2 else "<i8"), *(unpack(x, "<f8" if kind % 2 else "<i8") for x in got.get(kind, ()))])

        # Each text with an end before it. The end has the least hash, so code 0.
        sizes = block.lengths + 1
        starts = np.cumsum(sizes) - sizes
        own = np.ones(int(sizes.sum()), bool)
        own[starts] = False
        codes = np.zeros(len(own), np.int32)
        codes[own] = block.codes
        # Symbols of the text before each, as far as they matter.
        since = np.full(len(own), DEPTH, np.int8)
        for d in range(DEPTH):
            since[starts[sizes > d] + d] = d
        train = np.repeat(~block.held, sizes)
        counts = np.append(answered(0) >> 1, 0)
        root = (counts + 1) / (self.total + self.types + 1)
        seen = counts > 0
        p = root[codes] if self.done > 1 else None
        # The runs of d symbols, sorted; for each symbol the number of the run that ends there, or -1; how often each occurs, and a 0.
        runs, which = block.words, codes
        for d in range(1, DEPTH + 1):
            # Where the run of d symbols before is frequent enough; of those, where the run of d that ends here is, too.
            at = (np.nonzero((since[1:] >= d) & (counts >= self.least)[which[:-1]])[0] + 1).astype(np.int32)
            both = (counts >= LEAST)[which[at]]
            on = at[both]
            keys, first, inverse = distinct(_longer(runs[which[on - 1]], block.words[codes[on]]))
            if self.done <= d:
                mine = np.bincount(inverse[train[on]], minlength=len(keys))
                asked += [(2 * d, k, keys[s:e], mine[s:e]) for k, s, e in self.cuts(keys)]
                return asked, None
            joint = answered(2 * d)
            # The contexts are runs that are known, so their order is.
            used = np.zeros(len(runs), bool)
            used[which[at - 1]] = True
            number = np.cumsum(used, dtype=np.int32) - np.int32(1)
            if self.done <= d + 1:
                tell = np.nonzero((joint & 1 == 1) & (joint >> 1 >= self.joint))[0]
                place = on[first[tell]]
                context = number[which[place - 1]]
                order = np.argsort(context, kind="stable")
                tell, context, under = tell[order], context[order], p[place[order]]
                contexts, count = runs[used], counts[:-1][used]
                for k, s, e in self.cuts(contexts):
                    x, y = np.searchsorted(context, (s, e))
                    asked.append((2 * d + 1, k, contexts[s:e], count[s:e], context[x:y] - s, joint[tell[x:y]] >> 1, under[x:y]))
                del tell, place, context, order
            else:
                left = answered(2 * d + 1)[number[which[at - 1]]]
                below = p[at]
                full = left * below
                kept = (joint >> 1)[inverse]
                full[both] += np.where(kept >= self.joint, (kept - DISCOUNT) / counts[which[on - 1]], 0.0)
                p[at] = np.where(left < 1, full, below)
                del left, below, full, kept
            if d < DEPTH:
                which = np.full(len(codes), -1, np.int32)
                which[on] = inverse
                runs, counts = keys, np.append(joint >> 1, 0)
            del at, both, on, keys, first, inverse, joint, used, number
        return asked, None if asked else (root[codes][own], p[own], seen[codes][own])

    def visit(self, table: pa.Table) -> tuple[Block, list[tuple], tuple | None]:
        """``replay`` for the rows of a block: its own (kind -1) and the answers."""
        kinds, parts = table.column("kind").to_numpy(), table.column("part").to_numpy()
        row = table.slice(int(np.nonzero(kinds == -1)[0][0]), 1)
        block = Block({c: row.column(c)[0].as_py() for c in ("doc_ids", "held", "lengths", "words", "often", "codes")})
        got = {}
        for kind in np.unique(kinds[kinds >= 0]).tolist():
            rows = np.nonzero(kinds == kind)[0]
            got[kind] = table.column("got").take(pa.array(rows[np.argsort(parts[rows])])).to_pylist()
        return block, *self.replay(block, got)

    def ask(self, table: pa.Table) -> pa.Table:
        asked = self.visit(table)[1]
        return self.requests(table.column("block")[0].as_py(), asked)

    def requests(self, block: int, asked: list[tuple]) -> pa.Table:
        types = ("<u8", "<i8", "<i4", "<i8", "<f8")
        blobs = [[pack(x[i + 2].astype(t), steps=t in ("<u8", "<i4")) if len(x) > i + 2 else None for x in asked] for i, t in enumerate(types)]
        numbers = [pa.array([block] * len(asked), pa.int64()), *(pa.array([x[i] for x in asked], pa.int32()) for i in (0, 1))]
        return pa.Table.from_arrays([*numbers, *(pa.array(x, pa.binary()) for x in blobs)], names=["block", "kind", "to", "keys", "n", "at", "joint", "under"])

    def begin(self, batches):
        for row in _rows(batches):
            yield from self.requests(row["block"], self.replay(Block(row | {"doc_ids": []}), {})[0]).to_batches()

    def answer(self, table: pa.Table) -> pa.Table:
        """Answers all requests of one kind to one part."""
        table = table.sort_by("block")
        kind = table.column("kind")[0].as_py()

        def flat(name: str, dtype: str) -> list[np.ndarray]:
            return [unpack(x, dtype, name in ("keys", "at")) for x in table.column(name).to_pylist()]

        asked = flat("keys", "<u8")
        sizes, n = [len(x) for x in asked], np.concatenate(flat("n", "<i8"))
        keys, first, of = distinct(np.concatenate(asked))
        del asked, keys
        fresh = 0
        if kind % 2 == 0:
            count = np.bincount(of, weights=n).astype(np.int64)
            fresh = int(np.count_nonzero(count))
            # Of runs of two or more, what is seen less than LEAST times is never used: one value for all of them packs better.
            got = (np.where(count >= LEAST, count, 0) if kind else count)[of] << 1
            if kind:
                got[first[count >= LEAST]] |= 1
        else:
            at = flat("at", "<i4")
            context = of[np.concatenate(at) + np.repeat(np.cumsum(sizes) - sizes, [len(x) for x in at])]
            got = judge(context, np.concatenate(flat("joint", "<i8")), np.concatenate(flat("under", "<f8")), n[first])[1][of]
        blobs = [pack(x) for x in np.split(got, np.cumsum(sizes)[:-1])]
        rows = len(blobs)
        out = [table.column("block"), table.column("kind"), table.column("to"), pa.array(blobs, pa.binary()), pa.array([fresh] + [0] * (rows - 1), pa.int64())]
        return pa.Table.from_arrays(out, names=["block", "kind", "part", "got", "fresh"])

    def scores(self, table: pa.Table) -> pa.Table:
        block, _, chances = self.visit(table)
        return _scores(block, self.total, *chances)


def _scores(b: Block, total: int, root: np.ndarray, p: np.ndarray, known: np.ndarray) -> pa.Table:
    sums = [np.add.reduceat(x, b.starts) for x in (np.log10(root), np.log10(p), known.astype(np.int64))]
    columns = [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(sums[2]), pa.array(np.full(len(b.ids), total, np.int64)), pa.array(sums[0]), pa.array(sums[1])]
    return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _score_by_tree(blocks: DataFrame, total: int) -> DataFrame:
    """Scores by the tree as one object, for few training symbols."""
    entries = blocks.select("lengths", "held", "words", "often", "codes").mapInArrow(tidy(_entry_batches), "h long, n long")
    top = entries.groupBy("h").agg(F.sum("n").alias("c")).toPandas()
    tree = learn(blocks, top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), total, len(top))
    held_tree = blocks.sparkSession.sparkContext.broadcast(tree)

    def solve(batches):
        tree = held_tree.value
        for row in _rows(batches):
            b = Block(row)
            ids = tree.symbol_ids(b.words)
            c = np.where(ids >= 0, np.append(tree.counts, 0)[ids], 0)
            root = ((c + 1) / (tree.total + tree.types + 1))[b.codes]
            yield from _scores(b, tree.total, root, tree.chances(ids[b.codes], _since(b), root), (c > 0)[b.codes]).to_batches()

    return blocks.select("doc_ids", "lengths", "held", "words", "often", "codes").mapInArrow(tidy(solve), SCORES)


def _score_by_rounds(blocks: DataFrame, total: int, every: int) -> DataFrame:
    """Scores by a tree that no process holds; ``every``: symbols of all texts."""
    rounds = Rounds(max(0, -(-every // PART_SYMBOLS) - 1).bit_length(), total)
    asked = blocks.select("block", "lengths", "held", "words", "often", "codes").mapInArrow(tidy(rounds.begin), ASKED)

    def run(name: str):
        now = rounds
        # Spark counts the arguments of a method with self.
        return lambda table: getattr(now, name)(table)

    with Shelf(blocks.sparkSession, "block") as shelf:
        shelf.add(blocks.selectExpr("block", "-1 as kind", "-1 as part", "doc_ids", "held", "lengths", "words", "often", "codes", "cast(null as binary) as got", "0L as fresh"))
        # Words; runs of two; contexts of one symbol and runs of three; and so on, and the last contexts by themselves.
        for k in range(DEPTH + 2):
            answers = asked.groupBy("kind", "to").applyInArrow(run("answer"), ANSWERS)
            shelf.add(shelf.like(answers))
            types = rounds.types or shelf.read().where("kind = 0").agg(F.sum("fresh")).first()[0]
            rounds = Rounds(rounds.bits, total, k + 1, types)
            asked = shelf.read().drop("fresh").groupBy("block").applyInArrow(run("ask"), ASKED)
            if not k:
                discard(blocks)
        return materialize(shelf.read().drop("fresh").groupBy("block").applyInArrow(run("scores"), SCORES), "scores")


def score_corpus(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of SCORES for each document; learns from those for which ``held_out`` is not true."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text).cast("string").alias("text"))
    blocks = materialize(chosen.mapInArrow(tidy(_block_batches), BLOCKS), "blocks")
    total, every = blocks.agg(F.sum("train"), F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)"))).first()
    if (total or 0) <= TREE_SYMBOLS:
        return _score_by_tree(blocks, total or 0)
    return _score_by_rounds(blocks, total, every)
