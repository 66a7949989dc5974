import random

import pytest

from cairn.llm import common
from cairn.llm import lines as ln


def tokens(line):
    return frozenset(line.lower().split())


def plain(rows):
    """Removed line numbers by (id, text)."""
    distinct = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    earlier, out = [], {}
    for key in distinct:
        gone = []
        for i, line in enumerate(key[1].split("\n")):
            s = tokens(line)
            if not s:
                continue
            if any(len(s & e) >= 0.8 * len(s | e) - 1e-9 for e in earlier):
                gone.append(i)
            earlier.append(s)
        out[key] = gone
    return out


def lined(seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 12, 30, 60]))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5)}"
            lines.append(" ".join(words))
        rows.append((i or None, "\n".join(lines)))
    base = [f"c{j}" for j in range(50)]
    for i in range(40):  # near copies, some alike only to another copy
        words = list(base)
        for j in range(i % 4):
            words[10 * j + 3] = f"y{i}"
        rows.append((100 + i, "All rights reserved\n" + " ".join(words)))
    for i in range(60):  # a template whose members are alike or not by how much else they hold
        rows.append((300 + i, f"item i{i} of the list by\t{'a b c d e f g h' if i % 2 else 'hand'} v{i % 3}"))
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (503, "z " * 5000), (rows[1])]


@pytest.mark.parametrize("seed,broadcast,hot", [(1, 10**6, 1024), (2, 0, 1024), (3, 10**6, 2), (4, 0, 0)])
def test_against_brute_force(spark, monkeypatch, seed, broadcast, hot):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(ln, "HOT_CLASSES", hot)
    rows = lined(seed)
    want = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ln.line_report(df).collect()
    expected = sorted(((r[0], len((r[1] or "").split("\n")), len(want[r[0], r[1] or ""]), want[r[0], r[1] or ""]) for r in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == expected


def test_texts_without_their_repeats(spark):
    rows = lined(5)
    want = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d, t])) for d, t in rows]
    assert sorted((tuple(r) for r in ln.dedup_lines(df).collect()), key=repr) == sorted(clean, key=repr)


def test_odd_tables(empty, clash, docs):
    assert ln.line_report(empty).count() == 0
    a, b = (sorted((tuple(r) for r in ln.line_report(x).collect()), key=repr) for x in (clash, docs))
    assert a == b
    assert ln.dedup_lines(empty).count() == 0
    named = docs.selectExpr("*", "'mine' as nd", "'mine' as K", "'mine' as tie", "'mine' as removed")
    got = ln.dedup_lines(named)
    assert got.columns == named.columns and got.where("nd = 'mine' and K = 'mine' and tie = 'mine' and removed = 'mine'").count() == docs.count()


def test_no_python_in_the_plan(docs):
    plan = ln.line_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_lines_do_not_collide(spark):
    from pyspark.sql import functions as F

    n = 400_000
    docs = spark.range(n).groupBy((F.col("id") % 400).alias("doc_id")).agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("w"), "id"))).alias("text"))
    assert ln.line_report(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_whole_table_of_words(spark):
    """Every line that matches an earlier one on the given documents, by words, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain(rows)
    got = {(r["doc_id"]): r["removed"] for r in ln.line_report(docs).collect()}
    assert got == {d: want[d, t or ""] for d, t in rows}
    assert sum(map(len, got.values())) > 50


@pytest.mark.parametrize("few,semi", [(100, True), (1, False)])
def test_few_pairs_shuffle_only_their_sets(spark, monkeypatch, few, semi):
    plans, own = {}, ln.materialize
    monkeypatch.setattr(ln, "FEW_PAIRS", few)
    monkeypatch.setattr(ln, "materialize", lambda df, name, **o: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and own(df, name, **o))
    sets = spark.createDataFrame([(i, [i // 2 * 10 + j for j in range(9)]) for i in range(200)], "cls long, toks array<long>")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (6, 7)], "a long, b long")
    assert sorted(r["cls"] for r in ln._alike(pairs, sets).collect()) == [1, 7]
    assert ("LeftSemi" in plans["alike"]) == semi


def test_a_line_like_one_that_a_round_settled(spark, monkeypatch):
    """The third line is like the second only, which goes for the first: all three share their rarest words, and few others do."""
    monkeypatch.setattr(ln, "HOT_CLASSES", 2)
    rare, common_words = ["c0", "c1", "c2"], [f"c{j}" for j in range(3, 10)] + ["x", "y"]
    first, second, third = (" ".join(rare + [f"c{j}" for j in range(3, upto)] + more) for upto, more in ((10, []), (9, ["x"]), (8, ["x", "y"])))
    fill = "\n".join(f"{w} " + " ".join(f"f{w}{i}{j}" for j in range(6)) for w in common_words for i in range(12))
    rows = [(1, first), (2, second), (3, third), (4, fill)]
    got = {r["doc_id"]: r["removed"] for r in ln.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: plain(rows)[d, t] for d, t in rows} and got[3] == [0]


def test_words_that_few_classes_share_are_met_at_once(spark, monkeypatch):
    """A hot word's classes that share a second word go to a join of narrow rows; only where many share two there are rounds."""
    seen, own = {}, ln.materialize

    def counted(df, name, **options):
        out = own(df, name, **options)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ln, "HOT_CLASSES", 8)
    monkeypatch.setattr(ln, "materialize", counted)
    rng = random.Random(7)
    lines = [rng.sample([f"v{j}" for j in range(60)], 10) for _ in range(100)]
    lines += [[*words[:9], "v0"] for words in lines[:20]]
    rows = [(i, " ".join(words)) for i, words in enumerate(lines)]
    got = {r["doc_id"]: r["removed"] for r in ln.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: plain(rows)[d, t] for d, t in rows} and sum(map(len, got.values())) >= 10
    assert seen["hot"][0] > 0 and "open" not in seen


def test_pairs_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """Near copies of one line are held against the earliest first; of two so settled no pair is made."""
    most, own = [], ln.materialize

    def counted(df, name, **options):
        out = own(df, name, **options)
        if name == "pairs":
            most.append(out.count())
        return out

    monkeypatch.setattr(ln, "materialize", counted)
    rng = random.Random(11)
    base, n = [f"b{j}" for j in range(60)], 300
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(60)] = f"r{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["removed"] for r in ln.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: plain(rows)[d, t] for d, t in rows} and sum(map(len, got.values())) > 0.9 * n
    assert max(most) < n * n / 8
