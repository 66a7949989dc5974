import random
from collections import Counter

import pytest

from cairn.llm import mixing as mx


def plain_schedule(shares, blocks):
    """Slot of each (source, block), one slot after the other: released blocks by deadline."""
    q, done, slots, t = sum(shares), [0] * len(shares), {}, 0
    while any(d < b for d, b in zip(done, blocks, strict=True)):
        ready = [(-(-(j + 1) * q // a), s) for s, (a, j) in enumerate(zip(shares, done, strict=True)) if j * q // a <= t]
        if ready:
            s = min(ready)[1]
            slots[s, done[s]] = t
            done[s] += 1
        t += 1
    return slots


@pytest.mark.parametrize("seed", range(8))
def test_frames_follow_the_schedule(seed):
    rng = random.Random(seed)
    shares = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
    q, slots = sum(shares), mx.frame(shares)
    assert len(slots) == q
    assert {(s, j): t for t, (s, j) in enumerate(slots)} == {k: t for k, t in plain_schedule(shares, [3 * a for a in shares]).items() if t < q}
    done = Counter()
    for t, (s, _) in enumerate(slots * 3):
        done[s] += 1
        assert all(abs(done[i] - (t + 1) * a / q) < 1 for i, a in enumerate(shares))


@pytest.mark.parametrize("bucket_rows", [4, 100_000])
def test_rows_take_their_slots(docs, corpus, monkeypatch, bucket_rows):
    monkeypatch.setattr(mx, "BUCKET_ROWS", bucket_rows)
    shares = {"s0": 3, "s1": 1, "s2": 2, None: 1}
    rows = mx.mix(docs, shares, block_rows=4).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted((r[0] or -1, r[1] or "") for r in corpus)
    assert len({r["mix_position"] for r in rows}) == len(rows)
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    counts = Counter(r["source"] for r in rows)
    want = plain_schedule([shares.get(s, 1) for s in names], [-(-counts[s] // 4) for s in names])
    for r in rows:
        assert r["mix_position"] // 4 == r["mix_slot"]
    got = {(names.index(r["source"]), r["mix_block"]): r["mix_slot"] for r in rows}
    # A source that has run out leaves its slots empty: until then both agree.
    q = sum(shares.get(s, 1) for s in names)
    short = min(counts[s] / 4 * q / shares.get(s, 1) for s in names)
    assert {k: v for k, v in got.items() if v < short - 1} == {k: v for k, v in want.items() if v < short - 1}


def test_order_is_the_same_each_time(docs):
    a = [tuple(r) for r in mx.in_mixed_order(docs).collect()]
    b = [r["doc_id"] for r in mx.mix(docs.repartition(5)).orderBy("mix_position").collect()]
    assert [r[0] for r in a] == b


def test_odd_tables(empty, clash, docs):
    assert mx.mix(empty).count() == 0
    assert mx.mix(clash).count() == docs.count()
    assert mx.in_mixed_order(clash).columns == clash.columns
    named = docs.selectExpr("*", "'mine' as h", "'mine' as rank", "'mine' as src", "'mine' as J", "'mine' as mix_slot")
    for out in (mx.in_mixed_order(named), mx.mix(named)):
        assert out.where("h = 'mine' and rank = 'mine' and src = 'mine' and J = 'mine'").count() == docs.count()
    assert mx.in_mixed_order(named).where("mix_slot = 'mine'").count() == docs.count()
