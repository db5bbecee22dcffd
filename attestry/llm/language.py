"""Language identification by error-correcting output codes over byte trigrams.

Every language has a codeword; with up to seven languages all splits into two groups are the
bits, beyond that seeded random splits. A bit has one binary trigram classifier: the mean log-odds of a
text's trigrams under the two groups. Decoding adds up the logistic losses of the bits against
each codeword, weighted by how well a bit did on labelled texts it was not counted on, and takes
the codeword with the least loss. Texts whose two best codewords are close are flagged
``ambiguous``.

Trigram counts come from at most ``max_labelled`` labelled texts, the first by hash of their id;
all texts are predicted whole. Null texts and texts without a letter are ``und`` with score
0. Rows whose label is null are not learned from. Without any learned language everything is
``und``; with a single one, texts with letters get it with score 1.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import keyed, small_batches

MAX_LABELLED = 20_000
SPACE = 2**15
LETTER = re.compile(r"[^\W\d_]")
CLOSE = 0.2  # difference of mean losses below which a text is ambiguous

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    odds: np.ndarray  # trigrams x bits
    trust: np.ndarray  # weight of each bit
    scale: np.ndarray  # usual size of each bit's output


def trigrams(text: str) -> np.ndarray:
    b = _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.int32)
    g = (b[:-2] * 9973 + b[1:-1] * 263 + b[2:]) % SPACE
    return g[(b[1:-1] != 32)]


def codewords(n: int) -> np.ndarray:
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = [[(m >> i) & 1 for i in range(n)] for m in range(1, 2 ** (n - 1))]
    else:
        width = 12 * math.ceil(math.log2(n))
        bits = [[xxhash.xxh3_64_intdigest(f"{j}:{i}") & 1 for i in range(n)] for j in range(width)]
        bits = [b for b in bits if 0 < sum(b) < n]
    return np.array(bits).T * 2.0 - 1


def _counts(batches):
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            sums.setdefault(lang, np.zeros(SPACE, np.int64))[:] += np.bincount(trigrams(text), minlength=SPACE)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "gram", "n"])


def _outputs(odds: np.ndarray):
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                g = trigrams(text)
                out.append((odds[g].mean(axis=0) if len(g) else np.zeros(odds.shape[1])).astype(float).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.list_(pa.float64()))], ["lang", "outputs"])

    return run


def fit(docs: DataFrame, labelled: Column, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the ``lang`` of the ``docs`` that meet ``labelled``, a condition on their columns."""
    small_batches(docs.sparkSession)
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("h")
    )
    edge = rows.select("h").orderBy("h").limit(max_labelled).agg(F.max("h").alias("edge")).collect()[0]["edge"]
    if edge is None:
        return Model([], np.ones((0, 0)), np.zeros((SPACE, 0), np.float32), np.ones(0), np.ones(0))
    sample = rows.where(F.col("h") <= edge)
    counted = sample.where("h % 4 <> 0").select("lang", "text").mapInArrow(_counts, "lang string, gram int, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(table):
        table = sample.select("lang", "text").mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    shares = np.full((len(languages), SPACE), 0.2)
    for i, lang in enumerate(languages):
        mine = table[table["lang"] == lang]
        shares[i, mine["gram"].to_numpy()] += mine["n"].to_numpy()
    shares /= shares.sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    odds = np.stack(
        [np.log(shares[codes[:, j] > 0].mean(axis=0)) - np.log(shares[codes[:, j] < 0].mean(axis=0)) for j in range(codes.shape[1])], axis=1
    ).astype(np.float32) if codes.shape[1] else np.zeros((SPACE, 0), np.float32)
    trust, scale = np.ones(codes.shape[1]), np.full(codes.shape[1], 0.5)
    checks = sample.where("h % 4 = 0").select("lang", "text").mapInArrow(_outputs(odds), "lang string, outputs array<double>").toPandas()
    checks = checks[checks["lang"].isin(languages)]
    if len(checks) and codes.shape[1]:
        out = np.stack(checks["outputs"].to_numpy())
        truth = codes[[languages.index(x) for x in checks["lang"]]]
        scale = np.maximum(np.median(np.abs(out), axis=0), 1e-6)
        trust = np.clip(2 * ((out * truth) > 0).mean(axis=0) - 1, 0.05, 1)
    return Model(languages, codes, odds, trust, scale)


def decode(model: Model, out: np.ndarray) -> tuple[int, float, bool]:
    """The nearest codeword, its softmax share, and whether a second one is close."""
    loss = (np.logaddexp(0, -2 * model.codes * (out / model.scale)) * model.trust).sum(axis=1) / max(model.trust.sum(), 1e-9)
    best = int(np.argmin(loss))
    share = np.exp(-(loss - loss[best]) * len(model.trust))
    rest = np.delete(loss, best)
    return best, float(1 / share.sum()), bool(len(rest) and rest.min() - loss[best] < CLOSE)


def _predict(model: Model):
    def run(batches):
        for batch in batches:
            lang, score, unsure = [], [], []
            for text in batch.column("text").to_pylist():
                if not model.languages or not LETTER.search(text or ""):
                    lang.append("und"), score.append(0.0), unsure.append(False)
                    continue
                g = trigrams(text)
                out = model.odds[g].mean(axis=0, dtype=np.float64) if len(g) else np.zeros(model.odds.shape[1])
                best, share, close = decode(model, out)
                lang.append(model.languages[best]), score.append(share), unsure.append(close)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` of every row."""
    small_batches(docs.sparkSession)
    return keyed(docs).select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, ambiguous boolean")
