import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import suffix_tree as st
from cairn.llm.common import remainder


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def apart(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2



def held():
    return F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))



def score(df):
    return st.score_corpus(df, held()).collect()


@pytest.mark.parametrize("block", [300, 1 << 21])
def test_counts_and_base_scores(docs, clash, corpus, monkeypatch, block):
    monkeypatch.setattr(st, "BLOCK_TOKENS", block)
    c = Counter(t for r in corpus if not apart(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in corpus:
        t = tokens(r[1])
        want.append((r[0], apart(r[0]), len(t), sum(x in c for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)))
    for df in (docs, clash):
        got = [(*tuple(r)[:5], round(r["base_score"], 6)) for r in score(df)]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def repeating(seed, n):
    """Words that mostly follow fixed pairs, so that contexts of one and two words tell much."""
    rng = random.Random(seed)
    nxt = {(a, b): f"v{rng.randrange(12)}" for a in range(12) for b in range(12)}
    rows = []
    for i in range(n):
        words = [f"v{rng.randrange(12)}" for _ in range(2)]
        for _ in range(rng.randint(5, 60)):
            key = (int(words[-2][1:]), int(words[-1][1:]))
            words.append(nxt[key] if rng.random() < 0.8 else f"v{rng.randrange(12)}")
        rows.append((i, " ".join(words)))
    return rows


def plain_tree(seqs):
    """Counts by context of what follows, with an end before each text."""
    follow = [Counter() for _ in range(st.DEPTH + 1)]
    for t in seqs:
        s = [None] * 1 + t
        for i in range(1, len(s)):
            for d in range(1, min(st.DEPTH, i) + 1):
                follow[d][tuple(s[i - d : i]), s[i]] += 1
    return follow


def test_scores_against_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(st, "BLOCK_TOKENS", 500)
    rows = repeating(4, 120)
    got = {r["doc_id"]: r for r in score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))}
    train = [tokens(t) for i, t in rows if not apart(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    follow = plain_tree(train)
    contexts = [Counter() for _ in follow]
    for d in range(1, st.DEPTH + 1):
        for (ctx, _), k in follow[d].items():
            contexts[d][ctx] += k
    least, joint = max(2.0, st.CONTEXT_SHARE * n), max(2.0, st.JOINT_SHARE * n)
    states = {}

    def chance(ctx, w):
        """In the longest state that ends ``ctx``."""
        for d in range(min(len(ctx), st.DEPTH), 0, -1):
            if ctx[-d:] in states:
                own, left = states[ctx[-d:]]
                return own.get(w, 0.0) + left * chance(ctx[-d:][1:], w)
        return (c[w] + 1) / (n + v + 1)

    for d in range(1, st.DEPTH + 1):
        new = {}
        for ctx, k in contexts[d].items():
            if k < least or any(contexts[len(ctx[-j:])][ctx[-j:]] < least for j in range(1, d)):
                continue
            own = {w: (m - st.DISCOUNT) / k for (x, w), m in follow[d].items() if x == ctx and m >= joint}
            left = max(1 - sum(own.values()), 1e-9)
            under = {w: chance(ctx[1:], w) for w in own}
            full = {w: p + left * under[w] for w, p in own.items()}
            rest, rest_under = max(1 - sum(full.values()), 1e-12), max(1 - sum(under.values()), 1e-12)
            kl = sum(p * math.log(p / under[w]) for w, p in full.items()) + rest * math.log(rest / rest_under)
            if kl >= st.DIVERGENCE:
                new[ctx] = (own, left)
        states.update(new)
    assert any(len(s) == 2 for s in states)
    for i, text in rows:
        s = [None, *tokens(text)]
        want = sum(math.log10(chance(tuple(s[max(0, k - st.DEPTH) : k]), s[k])) for k in range(1, len(s)))
        assert got[i]["score"] == pytest.approx(want, rel=1e-6)
    unseen = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > 0.7 * sum(r["base_score"] for r in unseen)


def test_odd_tables(empty, docs):
    assert st.score_corpus(empty, held()).count() == 0
    nothing = st.score_corpus(docs, F.lit(True)).collect()
    assert {r["base_score"] for r in nothing} == {0.0} and {r["train_tokens"] for r in nothing} == {0}


def test_chances_in_every_state_add_up(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(40 * rng.random() ** 2)}" for _ in range(rng.randint(1, 60))) for _ in range(200)]
    held, own = {}, st.learn
    monkeypatch.setattr(st, "CONTEXT_SHARE", 1e-3)
    monkeypatch.setattr(st, "learn", lambda *a: held.setdefault("tree", own(*a)))
    st.score_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(False)).count()
    tree = held["tree"]
    assert tree.types == len(tree.words) and len(tree.keys) >= 2 and sum(map(len, tree.pairs)) > 100
    n = len(tree.words)
    # Every symbol, and one that is unknown, after each of many beginnings.
    after = np.arange(-1, n)
    root = np.append(1, tree.counts + 1) / (tree.total + tree.types + 1)
    assert abs(root.sum() - 1) < 1e-9
    for _ in range(60):
        before = [rng.randrange(-1, n) for _ in range(rng.randint(0, 4))]
        total = 0.0
        for symbol, r in zip(after.tolist(), root.tolist(), strict=True):
            ids = np.array([*before, symbol])
            total += tree.chances(ids, np.arange(len(ids)), np.append(np.ones(len(before)), r))[-1]
        assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("block,part", [(500, 300), (1 << 21, 1 << 21)])
def test_rounds_make_the_same_tree(spark, docs, monkeypatch, block, part):
    monkeypatch.setattr(st, "BLOCK_TOKENS", block)
    monkeypatch.setattr(st, "PART_SYMBOLS", part)
    for df in (docs, spark.createDataFrame(repeating(4, 120), "doc_id long, text string").repartition(3)):
        monkeypatch.setattr(st, "TREE_SYMBOLS", 1 << 20)
        want = sorted(score(df), key=repr)
        monkeypatch.setattr(st, "TREE_SYMBOLS", 1)
        got = sorted(score(df), key=repr)
        assert [tuple(r)[:5] for r in got] == [tuple(r)[:5] for r in want]
        for c in ("base_score", "score"):
            assert [r[c] for r in got] == pytest.approx([r[c] for r in want], rel=1e-9)
        assert any(r["score"] != r["base_score"] for r in got)


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_a_rare_context_is_a_state_in_a_corpus_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(st, "TREE_SYMBOLS", most)
    rows = [(i, "rarely seen together") for i in (1, 3, 4)]
    # So many other symbols that the context's share is below one in 10,000.
    rows += [(100 + i, " ".join(f"u{i}x{k}" for k in range(400))) for i in range(100)]
    got = {r["doc_id"]: r for r in st.score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    assert 3 < 1e-4 * sum(len(tokens(t)) for _, t in rows)
    # The first word has 2.25 of 103 after an end, each of the others at least 2.25 of 3 after the one before.
    least = math.log10((3 - st.DISCOUNT) / 103) + 3 * math.log10((3 - st.DISCOUNT) / 3)
    assert all(0.2 * got[i]["base_score"] < least < got[i]["score"] < 0 for i in (1, 3, 4))


def test_a_block_takes_little_memory(monkeypatch):
    """All rounds over one block, in this process, by the most that arrays took at once for each symbol."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, texts = 1 << 18, 64
    # Rare and frequent words, and texts that occur twice, so that long runs are frequent too.
    flat = (rng.zipf(1.3, n // 2) % 50_000 + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    flat = np.concatenate([flat, flat])
    flat[n // texts - 1 :: n // texts] = st.END
    words, codes, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(words), "<u4")
    rank[np.argsort(-often, kind="stable")] = np.arange(len(words))
    lengths = [n // texts] * texts
    row = {"block": 0, "kind": -1, "part": -1, "doc_ids": list(range(texts)), "held": [False] * texts, "lengths": lengths, "words": st.pack(words, steps=True), "often": st.pack(often.astype("<u4")), "codes": st.pack(rank[codes]), "got": None}
    kinds = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), *((x, pa.binary()) for x in ("words", "often", "codes", "got"))])
    del flat, words, codes, often, rank
    rounds, rows, most = st.Rounds(0, n), [row], 0
    asked = rounds.requests(0, rounds.replay(st.Block(row), {})[0])
    for k in range(st.DEPTH + 2):
        for kind in sorted(set(asked.column("kind").to_pylist())):
            got = rounds.answer(asked.filter(pa.compute.equal(asked.column("kind"), kind))).to_pylist()
            rows += [{c: x.get(c) for c in kinds.names} for x in got]
            types = got[0]["fresh"] if kind == 0 else rounds.types
        rounds = st.Rounds(0, n, k + 1, types)
        table = pa.Table.from_pylist(rows, kinds)
        tracemalloc.start()
        asked = rounds.ask(table) if k < st.DEPTH + 1 else rounds.scores(table)
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert asked.num_rows == texts and any(s > b for s, b in zip(asked.column("score").to_pylist(), asked.column("base_score").to_pylist(), strict=True))
    assert most < 125 * n


def test_what_is_kept_by_block_is_not_shuffled_again(spark):
    from cairn.llm.common import Shelf

    with Shelf(spark, "id") as shelf:
        for k in range(2):
            shelf.add(spark.range(100).select("id", F.lit(k).alias("k")))
        got = shelf.read().groupBy("id").applyInArrow(lambda t: t.slice(0, 1), "id long, k int")
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 100


def test_distinct_hashes():
    rng = np.random.default_rng(1)
    close = np.uint64(1) << np.uint64(40)
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 1 << 63, 3000).astype(np.uint64)[rng.integers(0, 3000, 9000)], close + rng.integers(0, 900, 5000).astype(np.uint64)):
        values, first, number = st.distinct(x)
        want, inverse = np.unique(x, return_inverse=True)
        assert (values == want).all() and (number == inverse).all() and (x[first] == values).all()
