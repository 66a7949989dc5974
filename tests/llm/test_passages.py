import random

import numpy as np
import pytest

from cairn.llm import passages as pg


def prose(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def plain_windows(values, width):
    out, todo = set(), [(0, len(values) - 1)]
    while todo:
        l, r = todo.pop()  # noqa: E741
        if r - l + 1 >= width:
            c = l + int(np.argmin(values[l : r + 1]))
            out.add((l, c, r))
            todo += [(l, c - 1), (c + 1, r)]
    return out


@pytest.mark.parametrize("width", [1, 3, 10])
def test_windows_are_the_nodes_of_the_tree(width):
    rng = np.random.default_rng(width)
    lengths = [0, 1, 5, 40, 9, 200, 3, 10]
    seqs = [rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1) for n in lengths]
    owner, left, at, right, value = pg.compact_windows(np.concatenate(seqs), lengths, width)
    for d, s in enumerate(seqs):
        mine = owner == d
        assert set(zip(left[mine].tolist(), at[mine].tolist(), right[mine].tolist(), strict=True)) == plain_windows(s, width)
        assert (value[mine] == s[at[mine]]).all()


def planted(seed):
    rng = random.Random(seed)
    rows, repeated = [], set()

    def add(words, is_repeated=False):
        if is_repeated:
            repeated.add(len(rows))
        rows.append((len(rows), " ".join(words)))

    for _ in range(30):
        add(prose(rng, rng.randint(1, 200)))
    for holders, size in ((2, 51), (5, 60), (3, 120), (2, 300)):
        passage = prose(rng, size)
        for _ in range(holders):
            add(prose(rng, rng.randint(0, 80)) + passage + prose(rng, rng.randint(0, 80)), True)
    short = prose(rng, 40)
    for _ in range(6):
        add(prose(rng, 60) + short + prose(rng, 60))
    near = prose(rng, 200)
    for i in range(4):
        words = list(near)
        words[40 * i + 20] = "changed"
        add(words, True)
    whole = prose(rng, 70)
    add(whole, True)
    add(whole, True)
    add(["tiny", "copy"])
    add(["tiny", "copy"])
    return rows, repeated


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    rows, repeated = planted(seed)
    got = {r["doc_id"]: r for r in pg.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    assert {d for d, r in got.items() if r["repeated"]} == repeated
    for d, r in got.items():
        for span in filter(None, (r["passages"] or "").split(",")):
            s, e = map(int, span.split("-"))
            assert e - s >= pg.MIN_WORDS
            mine = set(pg.shingles(pg.word_codes(rows[d][1]))[s : e - pg.SHINGLE + 1].tolist())
            others = [set(pg.shingles(pg.word_codes(rows[p][1])).tolist()) for p in r["partners"]]
            assert max(len(mine & o) / len(mine) for o in others) > 0.7


def brute(texts):
    """Pairs of texts with a passage that ``verify`` finds, whatever their windows."""
    seqs = [pg.shingles(pg.word_codes(t)) for t in texts]
    return {(i, j) for j in range(len(seqs)) for i in range(j) if pg.verify(seqs[i], seqs[j])}


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**9)}" for w in words]


@pytest.mark.parametrize("small,least", [(32, 0.97), (8, 0.9)])
def test_pairs_within_large_groups_are_found(spark, monkeypatch, small, least):
    """Pairs nine tenths alike, in groups of pairs that are less alike among each other."""
    monkeypatch.setattr(pg, "SMALL_GROUP", small)
    rng = random.Random(4)
    rows, pairs = [], set()
    for _ in range(5):
        base = prose(rng, 100)
        for _ in range(20):
            one = [w if rng.random() > 0.1 else f"u{rng.randrange(10**9)}" for w in base]
            for passage in (one, [w if i not in (30, 70) else f"x{rng.randrange(10**9)}" for i, w in enumerate(one)]):
                rows.append((1000 - len(rows), " ".join(prose(rng, 30) + passage + prose(rng, 30))))
            pairs.add((rows[-1][0], rows[-2][0]))
    got = {r["doc_id"]: r for r in pg.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    linked = sum(b in got[a]["partners"] or a in got[b]["partners"] for a, b in pairs)
    assert linked >= least * len(pairs)
    assert sum(r["repeated"] for r in got.values()) >= least * len(rows)


def meeting_pairs(texts):
    """Pairs whose windows of two hash functions meet over a common interval and that hold a passage, by brute force.

    ``verify`` may divide a wider range elsewhere and miss a passage just at the limit: only what it finds in either range counts.
    """
    width, spans, seqs = pg.MIN_WORDS - pg.SHINGLE + 1, [], [pg.shingles(pg.word_codes(t)) for t in texts]
    for seq in seqs:
        mine = {}
        for k in range(pg.HASHES):
            _, left, _, right, value = pg.compact_windows(pg._mix(seq ^ pg._ODD[10 + k]), [len(seq)], width)
            for s, e, v in zip(left.tolist(), right.tolist(), value.tolist(), strict=True):
                was = mine.get((k, v), (s, e))
                mine[k, v] = min(s, was[0]), max(e, was[1])
        spans.append(mine)
    out = set()
    for b in range(len(texts)):
        for a in range(b):
            both = [x for x in spans[a] if x in spans[b]]
            for x in both:
                for y in both:
                    (la, ra), (lb, rb) = ((max(m[x][0], m[y][0]), min(m[x][1], m[y][1])) for m in (spans[a], spans[b]))
                    if x[0] < y[0] and min(ra - la, rb - lb) + 1 >= width and pg.verify(seqs[a][la : ra + 1], seqs[b][lb : rb + 1]) and pg.verify(seqs[a], seqs[b]):
                        out.add((a, b))
    return out


@pytest.mark.parametrize("small,share", [(2, 0.1), (4, 0.04), (8, 0.1)])
def test_no_link_of_a_large_group_is_lost(spark, monkeypatch, small, share):
    """All that meets and is alike is in one component, however large the groups in which it meets."""
    monkeypatch.setattr(pg, "SMALL_GROUP", small)
    rng = random.Random(8)
    texts = []
    for _ in range(3):
        base = prose(rng, 70)
        for _ in range(14):
            one = [w if rng.random() > share else f"u{rng.randrange(10**9)}" for w in base]
            for passage in (one, [w if i != 30 else f"x{rng.randrange(10**9)}" for i, w in enumerate(one)]):
                texts.append(" ".join(prose(rng, 20, 60_000) + passage + prose(rng, 20, 60_000)))
    phrase = prose(rng, 12)  # in all of them, in different company
    texts += [" ".join(prose(rng, 60, 60_000) + phrase + prose(rng, 60, 60_000)) for _ in range(40)]
    want = meeting_pairs(texts)
    got = {r["doc_id"]: r for r in pg.passage_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert len(want) > 40
    assert not [p for p in want if got[p[0]]["component_id"] != got[p[1]]["component_id"]]
    assert all(got[d]["repeated"] for p in want for d in p)
    assert all(got[p]["component_id"] == r["component_id"] for r in got.values() for p in r["partners"])
    assert not any(got[d]["repeated"] for d in range(len(texts) - 40, len(texts)))


def test_recall_against_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(prose(rng, 120, 60_000)) for _ in range(20)]
    for _ in range(30):
        base = prose(rng, 60 + rng.randrange(100), 60_000)
        for _ in range(rng.choice([2, 2, 3, 6])):
            texts.append(" ".join(prose(rng, rng.randrange(60), 60_000) + edited(rng, base, rng.choice([0, 0.01, 0.02])) + prose(rng, rng.randrange(60), 60_000)))
    want = brute(texts)
    got = {r["doc_id"]: r for r in pg.passage_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    found = {(min(d, p), max(d, p)) for d, r in got.items() for p in r["partners"]}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) > 60


def test_every_place_of_a_passage_and_rows_without_id(spark):
    rng = random.Random(7)
    passage = prose(rng, 60, 60_000)
    twice = prose(rng, 40, 60_000) + passage + prose(rng, 80, 60_000) + passage + prose(rng, 10, 60_000)
    rows = [(5, " ".join(prose(rng, 30, 60_000) + passage)), (6, " ".join(twice)), (None, " ".join(passage + prose(rng, 9, 60_000))), (7, " ".join(prose(rng, 90, 60_000))), (7, " ".join(prose(rng, 20, 60_000) + passage))]
    got = pg.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = {(r["doc_id"], r["passages"]): r for r in got}
    assert (5, "30-90") in by and (6, "40-100,180-240") in by and (None, "0-60") in by and (7, "20-80") in by and (7, None) in {(r["doc_id"], r["passages"] or None) for r in got}
    assert by[6, "40-100,180-240"]["partners"] == [5, 7] and sum(r["repeated"] for r in got) == 4


def test_long_texts_keep_their_places():
    values = (np.arange(1, 300, dtype=np.uint64)[::-1] * np.uint64(1 << 40))
    owner, left, at, right, value = pg.compact_windows(values, [299], 250)
    assert set(zip(left.tolist(), at.tolist(), right.tolist(), strict=True)) == plain_windows(values, 250)


def test_copies_share_a_class(spark):
    rows, _ = planted(3)
    text = rows[-4][1]
    df = spark.createDataFrame([*rows, (900, text), (900, text), (None, text), (None, "")], "doc_id long, text string")
    got = pg.passage_report(df).collect()
    mine = [r for r in got if r["doc_id"] in (900, None, rows[-4][0], rows[-3][0]) and r["copy_of"] is not None]
    assert len(got) == len(rows) + 4 and len(mine) == 5
    assert {r["copy_of"] for r in mine} == {rows[-4][0]} and all(r["repeated"] for r in mine)


def test_odd_tables(empty, docs, clash):
    assert pg.passage_report(empty).count() == 0
    a, b = (sorted((tuple(r) for r in pg.passage_report(x).collect()), key=repr) for x in (docs, clash))
    assert a == b


def test_meeting_against_brute_force():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 16, 200)
    n = int(sizes.sum())
    k, la, lb = rng.integers(0, 4, n), rng.integers(0, 120, n), rng.integers(0, 120, n)
    ra, rb = la + rng.integers(45, 90, n), lb + rng.integers(45, 90, n)
    got, at = pg.meeting(sizes, k, la, ra, lb, rb), 0
    for size, g in zip(sizes.tolist(), got.tolist(), strict=True):
        own = range(at, at + size)
        over = [(i, j) for i in own for j in own if k[i] != k[j] and min(ra[i], ra[j]) - max(la[i], la[j]) >= 45 and min(rb[i], rb[j]) - max(lb[i], lb[j]) >= 45]
        assert g == (bool(over) or size > pg.MANY)
        at += size
    assert pg.meeting(np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 5).tolist() == []


def test_dense_starts_against_brute_force():
    """A run is kept where some run of a passage's length or more, within its text, has enough that is live."""
    rng, width = np.random.default_rng(3), pg.MIN_WORDS - pg.SHINGLE + 1
    lengths = [130, 46, 60, 200]
    live = rng.random(sum(lengths)) < np.repeat([0.8, 0.85, 0.5, 0.79], lengths)
    got, at = pg.dense_starts(live, lengths), 0
    for n in lengths:
        part = live[at : at + n]
        want = [any(5 * part[i:e].sum() >= 4 * (e - i) for e in range(i + width, min(n, i + 2 * width - 1) + 1)) for i in range(n)]
        assert got[at : at + n].tolist() == want
        at += n


def test_hashes_told_twice_go_back_to_their_batches():
    import pyarrow as pa

    blobs = [np.array(x, "<u4").tobytes() for x in ([5, 1, 9], [9, 2], [7, 7])]
    rows = {"batch": [1, 2, 3], "bucket": [0, 0, 0], "data": blobs}
    for grps, want in ((None, [[0, 0, 1], [1, 0], [1, 1]]), ([[4, 4, 4], [6, 6], [8, 8]], [[0, 0, 1], [1, 0], [0, 0]])):
        told = pa.array([None] * 3 if grps is None else [np.array(x, "<u4").tobytes() for x in grps], pa.binary())
        got = pg._told_twice(pa.table({**rows, "grps": told})).column("data").to_pylist()
        assert [np.unpackbits(np.frombuffer(g, np.uint8), count=len(w)).tolist() for g, w in zip(got, want, strict=True)] == want
