"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (``FEATURES``). For either
class the mean and covariance come from sums over all labelled rows, taken in the tasks
and added up by Spark; the driver gets two rows of fixed size. Covariances shrink
towards their own diagonal and towards the pooled covariance, are factored once
(Cholesky), and the score is the logistic of the difference of the two Gaussian
log-densities (a Mahalanobis distance and a log-determinant for each class).

Cases: a null text counts as empty; an empty text gets the vector of an empty text and
a score; a null doc_id is scored but never learned from; a document with several labels
counts once for each distinct label; labels other than 0 and 1 are ignored; with fewer
than ``MIN_ROWS`` rows of a class every score is the share of label 1 (0.5 without
labels); an empty table gives an empty result. Texts are read whole, one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, semi, tidy

FEATURES = ("words", "distinct", "repeated_pairs", "adjacent", "top_word", "word_bytes", "word_spread", "upper", "stops", "marks", "bars", "digits", "line_words", "entropy", "exclaim")
#: Shrinkage: weight of the pooled covariance and of the diagonal in each class covariance, and what is added to each scaled variance.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.01, 0.001, 5e-3
MIN_ROWS = 8
REJECT_BELOW = 0.7

_BYTES = np.arange(256)
_CLASS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "stop": np.isin(_BYTES, list(b".,;:'\"-()?")),
    "bar": np.isin(_BYTES, list(b"|\\/_<>{}[]")),
    "exclaim": _BYTES == ord("!"),
    "mark": np.isin(_BYTES, list(b"#$%&*+=@^`~")),
}
_TABLE = np.stack([_CLASS[k] for k in ("upper", "lower", "digit", "stop", "bar", "exclaim", "mark")]).astype(np.float64)


def statistics(text: str) -> np.ndarray:
    """The vector of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    upper, lower, digit, stop, bar, exclaim, mark = _TABLE @ hist
    size = len(raw) + 1.0
    words = raw.split()
    n = len(words)
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    sizes = np.fromiter(map(len, words), np.float64, n)
    counts = np.bincount(codes) if n else np.zeros(1)
    pairs = codes[:-1] * (len(index) + 1) + codes[1:] if n > 1 else codes[:0]
    distinct_pairs = len(np.unique(pairs))
    p = hist[hist > 0] / max(1, len(raw))
    return np.array(
        [
            np.log1p(n),
            np.log1p(len(index)) / np.log(n + 2.0),
            np.sqrt(1 - (distinct_pairs + 1) / (len(pairs) + 1)),
            np.sqrt(np.count_nonzero(codes[1:] == codes[:-1]) / (n + 1.0)),
            np.sqrt(counts.max() / (n + 1.0)),
            np.log1p(sizes.mean() if n else 0.0),
            np.log1p(sizes.std() if n else 0.0),
            np.sqrt(upper / (upper + lower + 1)),
            np.sqrt(stop / size),
            np.sqrt(mark / size),
            np.sqrt(bar / size),
            np.sqrt(digit / size),
            np.log1p(n / (raw.count(b"\n") + 1.0)),
            float(-(p * np.log(p)).sum()),
            np.sqrt(exclaim / size),
        ]
    )


def _feature_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            got = [statistics(t or "").tolist() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "x"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the vector ``x`` of every document."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(tidy(_feature_batches), "doc_id long, x array<double>")


def _moment_batches(batches):
    p = len(FEATURES)
    n, s, ss = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, p)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            n[k] += len(own)
            s[k] += own.sum(axis=0)
            ss[k] += own.T @ own
    for k in (0, 1):
        for i, value in enumerate(np.concatenate([[n[k]], s[k], ss[k].ravel()])):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "i": pa.array([i], pa.int32()), "v": pa.array([value], pa.float64())})


class Discriminant:
    """Two Gaussians with cached Cholesky factors; ``score`` gives P(label 1)."""

    def __init__(self, n: np.ndarray, s: np.ndarray, ss: np.ndarray):
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.fitted = bool(n.min() >= MIN_ROWS)
        if not self.fitted:
            return
        means = s / n[:, None]
        covs = ss / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (n[:, None, None] * covs).sum(axis=0) / n.sum()
        total = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        self.scale = total
        p = len(total)
        unit = total[:, None] * total[None, :]
        self.means, self.factors, self.logdets = [], [], []
        for k in (0, 1):
            c = (1 - TO_POOLED) * covs[k] / unit + TO_POOLED * pooled / unit
            c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(p)
            factor = np.linalg.cholesky(c)
            self.means.append(means[k] / total)
            self.factors.append(np.linalg.inv(factor))
            self.logdets.append(2 * np.log(np.diag(factor)).sum())
        self.prior = float(np.log(n[1] / n[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        z = x / self.scale
        logs = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            white = (z - mean) @ inverse.T
            logs.append(-0.5 * ((white * white).sum(axis=1) + logdet))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -500, 500)))


def _marked(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """Distinct (doc_id, y) of the usable labels."""
    return labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()


def fit(vectors: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id") -> Discriminant:
    """Learns from all vectors with a label for which ``learn`` (over doc_id) holds."""
    rows = vectors.where(F.col("doc_id").isNotNull() & learn).join(_marked(labels, label, doc_id), "doc_id").select("x", "y")
    sums = rows.mapInArrow(tidy(_moment_batches), "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    p = len(FEATURES)
    flat = np.zeros((2, 1 + p + p * p))
    for r in sums:
        flat[r["k"], r["i"]] = r["v"]
    return Discriminant(flat[:, 0], flat[:, 1 : 1 + p], flat[:, 1 + p :].reshape(2, p, p))


def fit_texts(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Discriminant:
    """``fit``, with vectors of none but the documents that it learns from (``learn`` over doc_id)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    taught = rows.where(F.col("doc_id").isNotNull() & learn)
    return fit(features(semi(taught, _marked(labels, label, doc_id).select("doc_id").distinct(), "doc_id")), labels, learn, label, doc_id)


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, held_out: Column, threshold: float = REJECT_BELOW) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (``learn`` and ``held_out`` over doc_id)."""
    vectors = materialize(features(docs), "quality")
    model = fit(vectors, labels, learn)

    def run(batches):
        p = len(FEATURES)
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, p)
            score = model.score(x)
            arrays = [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted"])

    scored = vectors.select("doc_id", "x").mapInArrow(tidy(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, model: Discriminant, threshold: float = REJECT_BELOW, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; no shuffle."""
    schema = docs.schema
    at_text = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([statistics(t or "") for t in part.column(at_text).to_pylist()])
                yield part.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(tidy(run), schema)
