import random
import re

import numpy as np
import pytest
import xxhash

from cairn.llm import common
from cairn.llm import simhash as sh
from cairn.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(runs))


def plain_groups(prints):
    """Least reachable id (None last) of each row of (id, fingerprint)."""
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(prints))]


@pytest.mark.parametrize("which", ["docs", "clash"])
def test_against_brute_force(which, request, corpus):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in sh.simhash_groups(request.getfixturevalue(which)).collect()), key=repr)
    prints = [(r[0], plain_fingerprint(r[1])) for r in corpus]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_groups(prints), strict=True)), key=repr)
    assert got == want


@pytest.mark.parametrize("shard,halves,most,hot", [(8, 2, 1 << 18, 10_000), (64, 2, 1 << 18, 2), (16, 4, 64, 10_000), (1 << 20, 1, 1 << 18, 3)])
def test_trees_find_every_link(spark, monkeypatch, shard, halves, most, hot):
    monkeypatch.setattr(sh, "SHARD_SIZE", shard)
    monkeypatch.setattr(sh, "SHARD_EXCESS", 2)
    monkeypatch.setattr(sh, "SAMPLE_MOST", most)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(sh, "SAMPLE_EACH", 16)
    monkeypatch.setattr(sh, "LEAF", 4)
    rng = random.Random(shard)
    prints = []
    for i in range(250):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            prints.append((len(prints), f))
            for b in rng.sample(range(64), rng.choice([0, 1, 3, 4, 5])):
                f ^= 1 << b
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in prints], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in sh.group_fingerprints(df, halves=halves).collect()}
    assert [got[d] for d, _ in prints] == plain_groups(prints)


def test_one_row_of_each_group_stays(docs, corpus):
    kept = [r["doc_id"] for r in sh.keep_one(docs).collect()]
    prints = [(r[0], plain_fingerprint(r[1])) for r in corpus]
    assert sorted(kept, key=repr) == sorted(set(plain_groups(prints)), key=repr)


def test_rows_without_an_id_or_with_one_id_stay_apart(spark):
    texts = ["alpha beta gamma delta one", "something else altogether here now", "third text of them all it is", "fourth one of its own kind too", "and a fifth that is unlike"]
    rows = [(None, texts[0], "a"), (None, texts[1], "b"), (None, texts[2], "c"), (7, texts[3], "d"), (7, texts[4], "e"), (7, texts[4], "f"), (9, texts[3], "g"), (None, texts[4], "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string").withColumnRenamed("th", "K")
    kept = sh.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r["K"] for r in kept.collect())
    assert got in (["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "f"])
    assert sorted(r["K"] for r in sh.keep_one(df.repartition(3)).collect()) == got
    assert sh.keep_one(df.limit(0)).count() == 0


def test_a_large_shard_is_divided_again(spark, monkeypatch):
    monkeypatch.setattr(sh, "SHARD_SIZE", 16)
    monkeypatch.setattr(sh, "SAMPLE_MOST", 64)
    rng = random.Random(8)
    nodes = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(3000)], "fp long")
    masks = sh.blocks(2)
    trees = sh.plant(nodes, masks)
    homes = nodes.mapInArrow(sh._homes(trees, masks), "shard int, fp long").groupBy("shard").count().collect()
    assert max(r["count"] for r in homes) <= 16 * sh.SHARD_EXCESS and sum(r["count"] for r in homes) == 6000


def test_long_chains_join(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[1001] == 1000


def test_empty(empty):
    assert sh.simhash_groups(empty).count() == 0
    assert sh.fingerprint("a b") == plain_fingerprint("A  b\n")
    assert np.uint64(sh.fingerprint("x " * 5000)) == plain_fingerprint("x " * 5000)
