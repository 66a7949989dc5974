import random

import pytest

from cairn.llm import common
from cairn.llm import decontaminate as dc


def prose(rng, n, vocabulary):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def planted():
    rng = random.Random(11)
    items = [(i, prose(rng, 40, 5000)) for i in range(6)] + [(6, "only six words in this item"), (7, ""), (8, None), (None, prose(rng, 30, 5000)), (0, prose(rng, 40, 5000))]
    clean = [prose(rng, 200, 5000) for _ in range(20)]
    docs, leaks = [], {}

    def add(text, *ids):
        leaks[len(docs)] = {str(i) for i in ids}
        docs.append((len(docs), text))

    for t in clean:
        add(t)
    for i in range(6):
        add(f"{prose(rng, 50, 5000)}\n{items[i][1]}\n{prose(rng, 50, 5000)}", i)
    swapped = items[2][1].split()
    for at in (6, 17, 29):
        swapped[at] = "other"
    add(prose(rng, 30, 5000) + " " + " ".join(swapped), 2)
    add(items[3][1].upper(), 3)
    add(" ".join(items[4][1].split()[10:30]), 4)
    add("this has only six words in this item. as a part", 6)
    add(" ".join(items[5][1].split()[:7]))
    add(items[1][1] + " " + items[4][1], 1, 4)
    add("")
    add(None)
    add("be " * 3000)
    return items, docs, leaks


@pytest.mark.parametrize("bits,broadcast", [(27, 10**6), (15, 0)])
def test_planted_passages(spark, monkeypatch, bits, broadcast):
    monkeypatch.setattr(dc, "MOST_BITS", bits)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    items, docs, leaks = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (set(filter(None, r["item_ids"].split(","))), r["contaminated"]) for r in dc.decontamination_report(df, bench).collect()}
    assert {d: g[0] for d, g in got.items()} == leaks
    assert all(c == bool(ids) for ids, c in got.values())
    kept = dc.drop_contaminated(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, ids in leaks.items() if not ids)
    assert kept.columns == df.columns


def test_masks_ignore_positions():
    rng = random.Random(1)
    words = [f"v{rng.random()}" for _ in range(12)]
    for mask in dc.MASKS:
        assert len(mask) == dc.SPAN and mask[0] == "1"
        other = [w if m == "1" else "zzz" for w, m in zip(words, mask, strict=True)]
        a, b = dc.masked(dc.word_codes(" ".join(words)), mask), dc.masked(dc.word_codes(" ".join(other)), mask)
        assert a.tolist() == b.tolist()
        assert dc.masked(dc.word_codes(" ".join(["zzz", *words[1:]])), mask).tolist() != a.tolist()


def test_masks_hit_every_pattern_that_verification_accepts():
    from itertools import combinations

    for size, misses in ((10, 2), (15, 3)):
        for missing in combinations(range(size), misses):
            assert any(all(at + i not in missing for i, m in enumerate(mask) if m == "1") for mask in dc.MASKS for at in range(size - mask.rindex("1")))


def test_leaks_are_what_brute_force_over_diagonals_finds():
    import numpy as np

    rng = random.Random(4)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in (1, 3, 4, 5, 6, 8, 9, 10, 11, 12, 15, 19, 20, 25, 30, 60)]
    owns = [dc.word_codes(t) for _, t in items]
    texts = [" ".join(w if j % 5 != 4 else "other" for j, w in enumerate(t.split())) for _, t in items]
    texts += [" ".join(t.split()[2 : 2 + n]) for _, t in items for n in (9, 10, 11)]
    for _ in range(400):
        words = rng.choice(items)[1].split()
        for at in rng.sample(range(len(words)), min(len(words), rng.randint(0, 2 + len(words) // 5))):
            words[at] = "other"
        texts.append(" ".join(["before"] * rng.randint(0, 3) + words + ["after"] * rng.randint(0, 3)))
    for text in texts:
        codes, wanted = dc.word_codes(text), {}
        for k, own in enumerate(owns):
            for shift in range(1 - len(own), len(codes)):
                lo, hi = max(0, shift), min(len(codes), shift + len(own))
                got = dc.stretch(np.equal(codes[lo:hi], own[lo - shift : hi - shift]), min(dc.MIN_WORDS, len(own)))
                if got and got[0] > wanted.get(k, 0):
                    wanted[k] = got[0]
        got = {k: dc.leak(codes, own) for k, own in enumerate(owns)}
        assert {k: m[0] for k, m in got.items() if m} == wanted


def test_stretch_against_brute_force():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randint(1, 40))])
        ends = np.nonzero(same)[0]
        best = max((e + 1 - s for s in ends for e in ends if e + 1 - s >= 10 and same[s : e + 1].sum() >= 0.8 * (e + 1 - s) - 1e-9), default=None)
        got = dc.stretch(same, 10)
        assert (got[2] - got[1] if got else None) == best


def test_odd_tables(spark, empty, docs, clash):
    bench = spark.createDataFrame([(1, "nothing like it in here at all I should say")], "item_id long, text string")
    assert dc.decontamination_report(empty, bench).count() == 0
    assert dc.decontamination_report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert dc.decontamination_report(clash, bench).count() == docs.count()
    assert dc.drop_contaminated(clash, bench).columns == clash.columns
    named = docs.selectExpr("*", "'mine' as th", "'mine' as Leaks")
    assert dc.drop_contaminated(named, bench).where("th = 'mine' and leaks = 'mine'").count() == docs.count()
    assert dc.find_leaks(named, bench, into="found").where("th = 'mine' and leaks = 'mine' and size(found) = 0").count() == docs.count()
    nothing = spark.createDataFrame([(1, None), (None, "")], "item_id long, text string")
    assert dc.decontamination_report(docs, nothing).where("contaminated").count() == 0


def test_recall_by_length_and_substitutions(spark):
    """Passages from inside longer items: all are found that agree in the stated share of the stated length."""
    rng = random.Random(9)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(60))) for i in range(40)]
    docs, want = [], {}
    for words, other in ((10, 0), (11, 0), (12, 1), (12, 2), (15, 2), (15, 3), (20, 4), (30, 6), (50, 10)):
        for i in range(40):
            at = rng.randrange(60 - words + 1)
            passage = items[i][1].split()[at : at + words]
            for j in rng.sample(range(1, words - 1), other):
                passage[j] = "other"
            want[len(docs)] = (words, other)
            docs.append((len(docs), " ".join(["before"] * 5 + passage + ["after"] * 5)))
    # A long run of one word, in a document and in an item.
    docs.append((len(docs), "be " * 5000))
    items.append((99, "be " * 40))
    got = dc.decontamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r["doc_id"] for r in got if r["contaminated"]}
    assert {d for d in want if d not in found} == set() and len(found) == len(docs)
