import hashlib
import re

import pytest

from cairn.llm import fingerprint as fp


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("bucket_rows", [1024, 7])
def test_pairs_against_brute_force(spark, corpus, docs, clash, monkeypatch, bucket_rows):
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket_rows)
    rows = sorted({(r[0], r[1] or "") for r in corpus}, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    follows = {d: rows[(i + 1) % len(rows)][1] for i, (d, _) in enumerate(rows)}
    # With a row repeated, its first copy's next is its second: the same id and text.
    twice = corpus[-1][0]
    for df in (docs, clash):
        got = fp.fingerprint_pairs(df).collect()
        assert len(got) == len(corpus)
        by_text, errors = {}, []
        for r in got:
            text = dict(rows)[r["doc_id"]]
            assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
            assert r["n_chars"] == len(text)
            options = [follows[r["doc_id"]]] + ([text] if r["doc_id"] == twice else [])
            cut = len(text) // 3
            edits = [text[: len(text) - cut] + nxt[:cut] for nxt in options]
            shas = [hashlib.sha256(e.encode()).hexdigest() for e in edits]
            assert r["edited_sha256"] in shas
            edited = edits[shas.index(r["edited_sha256"])]
            if len(shingles(text) | shingles(edited)) > 60:
                errors.append(abs(jaccard(shingles(text), shingles(edited)) - r["near_edited"]))
            if edited == text:
                assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
            assert 0 <= r["near_next"] <= 1
        # An eighth of more than 64 shingles, or all of them.
        assert max(errors) < 0.4 and sum(errors) / len(errors) < 0.12


def test_sketches_merge_and_contain(spark):
    words = [f"w{i}" for i in range(4000)]
    whole, part, rest = " ".join(words), " ".join(words[:400]), " ".join(words[396:])
    df = spark.createDataFrame([(whole, part, rest, "", "one two")], "w string, p string, r string, e string, s string")
    s = {c: fp.sketch(df[c]) for c in df.columns}
    got = df.select(
        (fp.merged(s["p"], s["r"]) == s["w"]).alias("merged"),
        fp.containment(s["p"], s["w"]).alias("inside"),
        fp.containment(s["w"], s["p"]).alias("share"),
        fp.likeness(s["e"], s["e"]).alias("empty"),
        fp.likeness(s["e"], s["s"]).alias("none"),
        fp.likeness(s["s"], s["s"]).alias("short"),
        fp.F.size(s["w"]).alias("size"),
    ).first()
    assert got["merged"] and got["inside"] == 1 and abs(got["share"] - 0.1) < 0.04
    assert (got["empty"], got["none"], got["short"]) == (1, 0, 1)
    assert abs(got["size"] - 500) < 100


def test_one_row_and_none(spark, empty):
    assert fp.fingerprint_pairs(empty).count() == 0
    one = fp.fingerprint_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1


def test_short_texts_are_compared_whole_or_not_at_all(spark):
    long = [f"w{i}" for i in range(3000)]
    rows = [(" ".join(long[i : i + 6]), " ".join(long[i : i + 9]), " ".join(long)) for i in range(0, 1200, 6)]
    df = spark.createDataFrame(rows, "s string, m string, l string")
    s, m, w = (fp.sketch(df[c]) for c in df.columns)
    got = df.select(fp.containment(s, m).alias("inside"), fp.likeness(s, m).alias("like"), fp.containment(s, w).alias("far"), fp.likeness(s, w).alias("unlike"), fp.F.size(s).alias("n")).collect()
    exact = [r for r in got if r["inside"] == 1 and r["like"] == 0.4]
    # Both of two shingles lie below the threshold once in 64 times: then the rest is not compared.
    assert len(exact) > 180 and all(r["n"] == 2 for r in got)
    assert {r["far"] for r in got} == {1.0, None} and all(r["unlike"] < 0.01 for r in got)


def test_likeness_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(text, reverse=True)
    errors = []
    for r in fp.fingerprint_pairs(docs).collect():
        t, nxt = text[r["doc_id"]], text[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        cut = len(t) // 3
        errors.append(abs(jaccard(shingles(t), shingles(t[: len(t) - cut] + nxt[:cut])) - r["near_edited"]))
    assert sum(errors) / len(errors) < 0.06
