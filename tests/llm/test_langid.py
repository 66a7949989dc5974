import random

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import langid


def samples(seed, n):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["scht", "ei", "und", "ach"], "cc": ["qu", "eau", "oi", "ê"]}
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 40))]
        rows.append((i, " ".join(words).capitalize(), lang))
    return rows


SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(samples(1, 300), SCHEMA)
    model = langid.fit(df, F.col("doc_id") % 5 != 0)
    got = langid.predict(df, model).join(df, "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) == 1
    assert all(0 <= r["score"] <= 1 for r in got)


def test_unseen_words_back_off(spark):
    df = spark.createDataFrame(samples(2, 300), SCHEMA)
    model = langid.fit(df, F.lit(True))
    assert model.tables[0].find(langid.word_hashes(["schteischteischteiachund"]))[0] < 0
    assert model.predict(["Schteischteischteiachund"])[0] == ["bb"]
    words = ["kalo", "quxeau", "\U0001f600", "scht", "zzz", "q", "kalokalomi"]
    for word, got in zip(words, model.unseen(words), strict=True):
        want, framed, i = np.zeros(3), f"<{word}>", 0
        while i < len(framed):
            for k in langid.ORDERS:
                gram = framed[i : i + k]
                at = model.tables[k].find(langid.gram_hashes(langid.code_points(gram), k))[0] if len(gram) == k else -1
                if at >= 0:
                    want, i = want + model.tables[k].shares[at], i + k
                    break
            else:
                i += 1
        assert np.allclose(got, want)
    assert model.unseen([]).shape == (0, 3)


def test_numbers_are_no_letters(spark):
    df = spark.createDataFrame([*samples(2, 60), (900, "²³ ½ Ⅷ ①", "aa"), (901, "12 _ ٣", "aa"), (902, None, "aa")], SCHEMA)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, langid.fit(df, F.lit(True))).collect()}
    assert {got[i] for i in (900, 901, 902)} == {("und", 0.0)} and got[0][0] == "aa"
    assert langid.letters("aÉ½b Ⅷç_d9e") == ["aé", "b", "ç", "d", "e"]


def test_sample_is_bounded_and_null_langs_teach_nothing(spark):
    rows = samples(3, 300) + [(1000 + i, "zzzz yyyy xxxx", None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df, F.lit(True), sample_rows=20)
    assert model.tables[0].find(langid.word_hashes(["zzzz"]))[0] < 0 and model.langs == ["aa", "bb", "cc"]
    whole = langid.fit(df, F.lit(True))
    assert len(model.tables[0].hashes) < len(whole.tables[0].hashes)


def test_odd_rows(spark, docs, clash, empty, corpus):
    model = langid.fit(docs, F.lit(True))
    for df in (docs, clash):
        got = langid.predict(df, model).collect()
        assert len(got) == len(corpus)
    by = {r[0]: r[1] for r in corpus}
    for r in langid.predict(docs, model).collect():
        if r["doc_id"] is not None and not any(c.isalpha() for c in by[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.predict(empty, langid.fit(empty, F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs, F.lit(False))).collect()} == {"und"}
