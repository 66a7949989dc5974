import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import quality as q
from cairn.llm.common import remainder


def test_statistics_of_odd_texts():
    for t in ("", " ", "a", "A" * 5000, "é" * 10, "|||", "\n\n"):
        x = q.statistics(t)
        assert x.shape == (len(q.FEATURES),) and np.isfinite(x).all()


def test_scores_are_those_of_two_gaussians():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(1.5, 2, (600, 3))])
    y = np.repeat([0, 1], [400, 600])
    sums = [(y == k) for k in (0, 1)]
    m = q.Discriminant(np.array([400.0, 600.0]), np.stack([x[s].sum(0) for s in sums]), np.stack([x[s].T @ x[s] for s in sums]))
    p = m.score(x)
    logs = []
    for k in (0, 1):
        mean, cov = x[y == k].mean(0), np.cov(x[y == k].T, bias=True)
        d = x - mean
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]) + np.log((y == k).mean()))
    assert np.abs(p - 1 / (1 + np.exp(logs[0] - logs[1]))).max() < 0.05
    assert ((p >= 0.5) == y).mean() > 0.8


def test_learns_on_given_labels_and_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    apart = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    rows = q.score_quality(docs, labels, ~apart, apart).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


@pytest.mark.parametrize("which", ["docs", "clash"])
def test_odd_rows(which, request, labels, corpus):
    df = request.getfixturevalue(which)
    apart = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    got = q.score_quality(df, labels, ~apart, apart).collect()
    assert len(got) == len(corpus)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]


def test_without_labels_or_rows(empty, docs, labels):
    apart = F.lit(False)
    assert {r["score"] for r in q.score_quality(docs, labels.limit(0), ~apart, apart).collect()} == {0.5}
    assert q.score_quality(empty, labels, ~apart, apart).count() == 0


def test_kept_rows_are_whole(docs, labels):
    apart = F.lit(False)
    model = q.fit_texts(docs, labels, ~apart)
    x = np.stack([q.statistics(t) for t in ("", "one two", "x " * 50)])
    assert np.allclose(model.score(x), q.fit(q.features(docs), labels, ~apart).score(x))
    kept = q.keep_quality(docs, model)
    assert kept.columns == docs.columns
    good = q.score_quality(docs, labels, ~apart, apart).where("predicted = 1").count()
    assert kept.count() == good
