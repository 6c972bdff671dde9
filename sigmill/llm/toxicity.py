"""Toxicity: a linear classifier trained with the non-negative positive-unlabelled risk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, written

#: Bounds of the training sample, which is taken from the labelled rows: confirmed toxic documents, and
#: documents whose label is then not looked at.
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
#: What makes a feature: documents of the sample that have it, and how far its share of the toxic ones
#: lies above its share of the others, in standard errors.
LEAST, FAR = 5, 3.0
#: A word's features are the word and its beginnings of these lengths.
STEMS = range(3, 9)
THRESHOLD = 0.3

_word = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return [f"{word}$", *(word[:k] for k in STEMS if len(word) >= k)]


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


class Model:
    """Weights of known features, and a bias. A text's value of a feature is log(1 + 100 times its
    share of the words), where 20 words are added to every text."""

    def __init__(self, features: list[str]):
        self.place = {f: i for i, f in enumerate(features)}
        self.weights = np.zeros(len(features))
        self.bias = 0.0
        self.known: dict[str, tuple[int, ...]] = {}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of a whole text's features."""
        found = words_of(text)
        counts: Counter[int] = Counter()
        known = self.known
        for w, n in Counter(found).items():
            at = known.get(w)
            if at is None:
                if len(known) > 200_000:
                    known.clear()
                at = known[w] = tuple(self.place[f] for f in word_features(w) if f in self.place)
            for i in at:
                counts[i] += n
        idx = np.fromiter(sorted(counts), np.int64, len(counts))
        values = np.array([counts[i] for i in idx.tolist()], float)
        return idx, np.log1p(100 * values / (len(found) + 20))

    def logit(self, text: str | None) -> float:
        idx, values = self.vector(text)
        return float(self.weights[idx] @ values + self.bias)


def train_nnpu(model: Model, positive: list, unlabelled: list, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> None:
    """Sets weights and bias to minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))
    with the logistic loss, by Adam over all vectors. Where the negative part falls below zero, the
    step goes against it instead (Kiryo et al. 2017)."""
    rows = positive + unlabelled
    sizes = np.array([len(i) for i, _ in rows], np.int64)
    flat = lambda at, kind: np.concatenate([np.zeros(0, kind), *(r[at] for r in rows)])
    _train(model, flat(0, np.int64), flat(1, float), sizes, len(positive), prior, steps, rate, decay)


def _train(model: Model, idx: np.ndarray, val: np.ndarray, sizes: np.ndarray, n_p: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> None:
    """train_nnpu() on vectors laid end to end, of these sizes: n_p positive ones, then the unlabelled."""
    n, k = len(sizes), len(model.weights)
    n_u = n - n_p
    model.bias = float(np.log(prior / (1 - prior)))
    if not n_p or not n_u:
        return
    row = np.repeat(np.arange(n), sizes)
    is_p = np.arange(n) < n_p
    each = np.empty(len(val))  # the only further array of this length

    def times_val(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        np.take(of, at, out=each, mode="clip")  # no index is clipped; other modes copy
        return np.multiply(each, val, out=each)

    v = np.zeros(k + 1)
    v[k] = model.bias
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(row, weights=times_val(v, idx), minlength=n) + v[k], -60, 60)
        s = 1 / (1 + np.exp(-z))
        soft = np.logaddexp(0, z)  # loss of calling it negative
        negative = soft[~is_p].mean() - prior * soft[is_p].mean()
        g = np.where(is_p, -prior * s / n_p, s / n_u)
        g = g + np.where(is_p, prior * (s - 1) / n_p, 0.0) if negative >= 0 else -g
        full = np.append(np.bincount(idx, weights=times_val(g, row), minlength=k) + decay * v[:k], g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.999 * m2 + 0.001 * full * full
        v -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    # Where the sample is small, the correction moves the bias more than anything else: it is set last,
    # so that the unlabelled vectors' mean score is the class prior.
    z = np.bincount(row, weights=times_val(v, idx), minlength=n)[~is_p]
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-np.clip(z + mid, -60, 60)))).mean() < prior else (low, mid)
    model.weights, model.bias = v[:k], (low + high) / 2


def held_out(key) -> F.Column:
    """Rows that are never learned from: crc32 of the key as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def _chosen(sample: DataFrame, n_p: int, n_u: int) -> list[str]:
    """The features that set the sample's toxic documents (p = 1) apart; the sample bounds how many."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts: dict[str, list[int]] = {}
                for t, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for f in {f for w in set(words_of(t)) for f in word_features(w)}:
                        counts.setdefault(f, [0, 0])[1 - p] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["f", "a", "b"])

    seen = sample.mapInArrow(run, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / F.lit(n_p + n_u)
    error = F.sqrt(share * (1 - share) * F.lit(1 / n_p + 1 / n_u)) + F.lit(1e-12)
    far = (F.col("a") / F.lit(n_p) - F.col("b") / F.lit(n_u)) / error
    top = seen.where(f"a + b >= {LEAST}").select("f", far.alias("z")).where(f"z >= {FAR}").orderBy(F.desc("z"), "f")
    return [r["f"] for r in top.collect()]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """A model from the labelled rows that are not held out: up to MAX_POSITIVE documents labelled toxic,
    and up to MAX_UNLABELLED of them all, whatever their label, as unlabelled; both are the first by a
    hash of the key. The class prior is the share of toxic labels, over all labels learned from. Only
    the sample's vectors come to the driver, over the features that set its toxic documents apart.

    Labels without a document, null keys and null labels don't count; without a toxic label, or without
    a labelled document, the model has no features and scores 0.01."""
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    blank = Model([])
    blank.bias = float(np.log(0.01 / 0.99))
    if not n or not toxic:
        return blank
    prior = min(max(toxic / n, 1e-4), 0.9)
    order = F.xxhash64("doc_id")
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = known.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(MAX_POSITIVE).withColumn("p", F.lit(1))
    free = known.select("doc_id").distinct().orderBy(order, "doc_id").limit(MAX_UNLABELLED).withColumn("p", F.lit(0))
    sample = written(src.join(F.broadcast(ids.union(free)), "doc_id").select("doc_id", "text", "p"), "sample")  # 16,000 ids at most
    n_p, n_all = sample.agg(F.coalesce(F.sum("p"), F.lit(0)), F.count("*")).first()
    if not n_p or n_p == n_all:
        return blank
    model = Model(_chosen(sample, n_p, n_all - n_p))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.vector(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i for i, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["doc_id", "p", "i", "v"])

    t = sample.mapInArrow(run, "doc_id long, p int, i array<long>, v array<double>").toArrow().sort_by([("p", "descending"), ("doc_id", "ascending")])
    found = t["i"].combine_chunks()
    idx, sizes = found.flatten().to_numpy(), np.diff(found.offsets.to_numpy())
    val, n_p = t["v"].combine_chunks().flatten().to_numpy(), pc.sum(t["p"]).as_py()
    del t, found  # the two arrays keep what they need
    pa.default_memory_pool().release_unused()
    model.known = {}
    _train(model, idx, val, sizes, n_p, prior)
    return model


def _logits(model: Model, texts: pa.Array) -> np.ndarray:
    return np.clip(np.fromiter((model.logit(t.as_py()) for t in texts), float, len(texts)), -60, 60)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score): every whole text against the model; null counts as empty."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-_logits(model, batch.column(1)))), pa.float64())], ["doc_id", "score"])
        model.known.clear()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Without labels to learn from, every
    score is 0.01; an empty table stays empty."""
    out = score(docs, fit(docs, labels, text, key), text, key)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs scored below the threshold, with their columns; the text is scored in place."""
    model = fit(docs, labels, text, key)
    at, limit = docs.columns.index(text), float(np.log(THRESHOLD / (1 - THRESHOLD)))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_logits(model, batch.column(at)) < limit, pa.bool_()))
        model.known.clear()

    return docs.mapInArrow(run, docs.schema)
