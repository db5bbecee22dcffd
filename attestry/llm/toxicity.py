"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence is a bag of word features (the word and its first four and five letters). Its
probability is a logistic function of them, a document's is the noisy-or of its sentences, and
the weights are fitted to the document labels through that noisy-or, so blame settles on the
sentences that tell toxic documents from clean ones. The sentences at or above one half are
reported with their places in the text.

Features are chosen by their document counts in the labelled sample, and the weights are fitted
on that sample: at most ``max_labelled`` labelled rows, the first by hash of their id. All
texts are scored whole.

Null and empty texts have no sentence and score 0. Labels that are null are left out; a document
labelled twice counts as toxic if one label says so. Without labels of both kinds every score
is 0. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import keyed, small_batches

MAX_LABELLED = 20_000
FEATURES = 4096
SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = string.punctuation + "«»“”„…¿¡"


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def features(token: str) -> tuple[int, ...]:
    word = token.strip(EDGES)
    if not word:
        return ()
    names = {"=" + word} | {f"^{word[:n]}" for n in (4, 5) if len(word) >= n}
    return tuple(sorted(xxhash.xxh3_64_intdigest(n) >> 1 for n in names))


class TokenFeatures(dict):
    """Token to those of its features that are in ``known`` (all if None)."""

    def __init__(self, known=None):
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        value = features(token)
        if self.known is not None:
            value = tuple(f for f in value if f in self.known)
        self[token] = value
        return value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _document_counts(batches):
    tokens = TokenFeatures()
    for batch in batches:
        counts: dict[int, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for f in {f for token in set((text or "").lower().split()) for f in tokens[token]}:
                counts.setdefault(f, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
            ["feature", "clean", "bad"],
        )


def _bags(known: frozenset[int]):
    def run(batches):
        tokens = TokenFeatures(known)
        for batch in batches:
            rows, bare = [], []
            for text in batch.column("text").to_pylist():
                sentences = [sorted({f for t in s.split() for f in tokens[t]}) for s in SENTENCE.findall((text or "").lower()) if s.strip()]
                rows.append([s for s in sentences if s])
                bare.append(sum(1 for s in sentences if not s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(bare, pa.int64()), pa.array(rows, pa.list_(pa.list_(pa.int64())))], ["toxic", "bare", "sentences"]
            )

    return run


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = 300) -> Model:
    """Weights from ``labelled`` (doc_id, toxic 0/1); at most ``max_labelled`` of its rows are used."""
    small_batches(docs.sparkSession)
    sample = (
        labelled.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("key"))
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(max_labelled)
    )
    texts = keyed(docs).where("doc_id is not null").join(F.broadcast(sample), "key").select("text", "toxic").persist()
    try:
        size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
        clean, bad = size.get(0, 0), size.get(1, 0)
        if not clean or not bad:
            return Model({}, -40.0)
        odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
        spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("clean") + 0.5))
        chosen = (
            texts.mapInArrow(_document_counts, "feature long, clean long, bad long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
            .where((F.col("bad") >= 5) & (odds > 0.7) & (odds / spread > 3.5)).orderBy((odds / spread).desc(), "feature").limit(FEATURES).collect()
        )
        known = {r["feature"]: i for i, r in enumerate(chosen)}
        bags = texts.mapInArrow(_bags(frozenset(known)), "toxic int, bare long, sentences array<array<long>>").toPandas()
    finally:
        texts.unpersist()
    weights, bias = _noisy_or(bags, known, rounds)
    return Model({f: float(weights[i]) for f, i in known.items()}, bias)


def _noisy_or(bags, known: dict[int, int], rounds: int) -> tuple[np.ndarray, float]:
    """Adam on the log loss of ``1 - prod(1 - p)`` with a small ridge; sentences without features share the bias."""
    y = bags["toxic"].to_numpy() > 0
    bare = bags["bare"].to_numpy(float)
    doc = np.array([i for i, ss in enumerate(bags["sentences"]) for _ in ss], np.int64)
    sizes = np.array([len(s) for ss in bags["sentences"] for s in ss], np.int64)
    feature = np.array([known[f] for ss in bags["sentences"] for s in ss for f in s], np.int64)
    sentence = np.repeat(np.arange(len(doc)), sizes)
    n, k = len(y), len(known)
    theta = np.zeros(k + 1)
    theta[-1] = -4.0
    theta[:-1] = 0.5
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        logit = theta[-1] + np.bincount(sentence, theta[feature], len(doc))
        p, p0 = _sigmoid(logit), _sigmoid(theta[-1])
        log_none = np.bincount(doc, -np.logaddexp(0, np.clip(logit, -40, 40)), n) - bare * np.logaddexp(0, theta[-1])
        none = np.exp(log_none)
        pull = np.where(y, -none / np.maximum(1 - none, 1e-9), 1.0) / n
        slope = pull[doc] * p
        grad = np.empty(k + 1)
        grad[:-1] = np.bincount(feature, slope[sentence], k) + 1e-6 * theta[:-1]
        grad[-1] = slope.sum() + (pull * bare * p0).sum()
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def _score(model: Model):
    none = float(np.logaddexp(0, model.bias))

    def run(batches):
        tokens = TokenFeatures(model.weights)
        for batch in batches:
            scores, counts, places = [], [], []
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                log_none, found, n = 0.0, [], 0
                if any(map(tokens.__getitem__, low.split())):
                    for m in SENTENCE.finditer(text):
                        words = m.group().lower().split()
                        if words:
                            n += 1
                            hit = {f for w in words for f in tokens[w]}
                            logit = min(40.0, model.bias + sum(model.weights[f] for f in hit))
                            log_none -= np.logaddexp(0, logit) if hit else none
                            if hit and logit >= 0:
                                found.append({"start": m.start(), "length": len(m.group()), "score": float(_sigmoid(logit))})
                else:
                    n = sum(1 for s in SENTENCE.findall(low) if not s.isspace())
                    log_none = -none * n
                scores.append(float(min(1.0, max(0.0, -np.expm1(log_none)))))
                counts.append(n)
                places.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("tie"), pa.array(scores), pa.array(counts, pa.int64()), pa.array(places, PLACES)], ["doc_id", "key", "tie", "score", "n_sentences", "offending"]
            )

    return run


PLACES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, key, tie, score, n_sentences, offending)``; ``offending`` has start, length and score of each toxic sentence."""
    small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(
        _score(model), "doc_id long, key long, tie int, score double, n_sentences long, offending array<struct<start:long,length:long,score:double>>"
    )


def toxic(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all ``docs``, learned from ``labels`` whose ``doc_id`` is not held out (a condition on ``doc_id``)."""
    model = fit(docs, labels.where(~held_out).select("doc_id", "toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")
