"""Language identification: words first, then ever shorter character n-grams.

A word seen in training is scored by its log frequency in each language. An unseen word is
cut, from the left, into the longest known character n-grams (``ORDERS``, longest first) and
their log frequencies are added; characters never seen add nothing. The posterior over
languages of the summed scores, flattened by ``TEMPER``, gives the prediction and its score.

The tables come from a bounded sample: ``SAMPLE_ROWS`` labelled rows of each language, picked by
the hash of their id (all of them where there are fewer), whole texts; words and n-grams need
two occurrences. What goes to the tasks is a sorted array of hashes and a row of numbers for each, by kind: bounded for
each language, and no more than the sample holds. Predictions cover all rows.

A letter is what Unicode files as one (general category L): digits, superscripts, fractions and numerals are none.

Cases: null, empty or letterless text gives ``und`` and score 0; rows with a null lang or null
id are never learned from; ties between languages go to the first in order; without any
training row everything is ``und``; an empty table gives an empty result. Texts are read whole;
repeated rows are predicted alike.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

UNDETERMINED = "und"
#: Labelled rows of a language that are learned from, at most; lengths of n-grams, longest first.
SAMPLE_ROWS, ORDERS = 3000, (5, 4, 3, 2, 1)
MIN_COUNT, SMOOTHING, TEMPER = 2, 0.5, 0.5
#: Letters of the texts that are scored at a time.
SLICE_BYTES = 8 << 20

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(max(ORDERS))], dtype=np.uint64)


def _pattern():
    import regex

    return regex.compile(r"\p{L}+")


def letters(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _pattern().findall(text.lower())


def _count_batches(batches):
    """Words and n-grams of the sampled rows, as (lang, kind, gram, n); kind 0 is whole words."""
    totals: dict[str, Counter] = {}
    find = _pattern().findall
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            totals.setdefault(lang, Counter()).update(find((text or "").lower()))
    for lang, words in totals.items():
        grams: dict[int, Counter] = {0: words}
        for k in ORDERS:
            grams[k] = Counter()
        for word, n in words.items():
            framed = f"<{word}>"
            for k in ORDERS:
                own = grams[k]
                for i in range(len(framed) - k + 1):
                    own[framed[i : i + k]] += n
        for kind, counts in grams.items():
            keys = list(counts)
            for i in range(0, len(keys), 20_000):
                part = keys[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([kind] * len(part), pa.int32()), pa.array(part), pa.array([counts[x] for x in part], pa.int64())],
                    names=["lang", "kind", "gram", "n"],
                )


def word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k code points."""
    n = max(0, len(points) - k + 1)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += (points[i : i + n] + np.uint64(1)) * _FACTORS[i]
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Table:
    """Hashes in order, and a row of log frequencies by language, less their mean, for each."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        n = counts[order].astype(np.float64)
        share = np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * max(1, len(n))))
        self.shares = share - share.mean(axis=1, keepdims=True) if len(n) else share

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


class Backoff:
    """Log frequencies of words and n-grams by language; ``predict`` scores texts."""

    def __init__(self, langs: list[str], tables: dict[int, Table]):
        self.langs, self.tables = langs, tables

    def unseen(self, words: list[str]) -> np.ndarray:
        """The sum, for each word, over its longest known n-grams from the left; a character that no order knows is skipped."""
        out = np.zeros((len(words), len(self.langs)))
        if not words:
            return out
        framed = [f"<{w}>" for w in words]
        points = code_points("".join(framed))
        sizes = np.fromiter(map(len, framed), np.int64, len(framed))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(points))
        # For each place: the longest order known there, and its row.
        order, row = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for k in ORDERS:
            at = self.tables[k].find(gram_hashes(points, k))
            fits = np.nonzero((at >= 0) & (left[: len(at)] >= k) & (order[: len(at)] == 0))[0]
            order[fits], row[fits] = k, at[fits]
        # One step of all words at a time.
        at, word = ends - sizes, np.arange(len(words))
        while len(at):
            k = order[at]
            for n in ORDERS:
                on = k == n
                out[word[on]] += self.tables[n].shares[row[at[on]]]
            at = at + np.maximum(k, 1)
            more = at < ends[word]
            at, word = at[more], word[more]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        find, index = _pattern().findall, {}
        ids: list[int] = []
        counts: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = Counter(find(text.lower())) if text else {}
            sizes[i] = len(found)
            for w, n in found.items():
                ids.append(index.setdefault(w, len(index)))
                counts.append(n)
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not ids or not self.langs:
            return langs, scores
        words = list(index)
        at = self.tables[0].find(word_hashes(words))
        rows = np.zeros((len(words), len(self.langs)))
        rows[at >= 0] = self.tables[0].shares[at[at >= 0]]
        new = np.nonzero(at < 0)[0]
        rows[new] = self.unseen([words[i] for i in new.tolist()])
        some = np.nonzero(sizes)[0]
        starts = (np.cumsum(sizes) - sizes)[some]
        total = np.add.reduceat(rows[ids] * np.array(counts, np.float64)[:, None], starts)
        p = np.exp(TEMPER * (total - total.max(axis=1, keepdims=True)))
        best = p.argmax(axis=1)
        scores[some] = p[np.arange(len(p)), best] / p.sum(axis=1)
        for i, b in zip(some.tolist(), best.tolist(), strict=True):
            langs[i] = self.langs[b]
        return langs, scores


def fit(docs: DataFrame, learn: Column, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Backoff:
    """Learns from a bounded sample of the rows of each language for which ``learn`` (over the columns) holds."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Backoff([], {})
    # The share of hash values that takes SAMPLE_ROWS of each language.
    cut = F.coalesce(*[F.when(F.col(lang) == x, F.lit(int(2**31 * min(1.0, sample_rows / n)))) for x, n in sizes.items()])
    sample = rows.where(F.pmod(F.xxhash64(doc_id), F.lit(2**31)) < cut)
    counted = sample.select(lang, text).mapInArrow(tidy(_count_batches), "lang string, kind int, gram string, n long")
    # The pivot adds up by n-gram; what the sample holds, at most, comes to the driver.
    of = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    found = counted.groupBy("kind", "gram").agg(F.sum("n").alias("all"), *of).where(F.col("all") >= MIN_COUNT).drop("all").toArrow()
    kinds = found.column("kind").to_numpy()
    counts = np.stack([found.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1)
    tables = {}
    for kind in (0, *ORDERS):
        own = np.nonzero(kinds == kind)[0]
        grams = found.column("gram").take(pa.array(own)).to_pylist()
        hashes = gram_hashes(code_points("".join(grams)), kind)[::kind] if kind and grams else word_hashes(grams)
        tables[kind] = Table(hashes, counts[own])
    return Backoff(langs, tables)


def predict(docs: DataFrame, model: Backoff, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            for at, rows in slices(batch.column(1), SLICE_BYTES):
                langs, scores = model.predict(batch.column(1).slice(at, rows).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
