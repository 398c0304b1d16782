"""Text quality: random-indexing word vectors, pooled, and a two-layer network.

Every token has a sparse ternary index vector made from its hash; a word's vector is its
own plus the index vectors of its neighbours in the training texts. A text is a stream of
words and of marks for their form (case, runs of signs, lone signs, digits, repetition),
and its vector the mean over both. The network is plain numpy, and its logits are divided
by a temperature fitted on a fifth of the training rows.

Learning is bounded: at most ``FIT_ROWS`` labelled rows of each class, the ``VOCABULARY``
most frequent words of them.

Defined cases. Null or empty text: the zero vector's score. Labels other than 0 and 1 are
ignored; without labels of both classes the score is the share of ones, or 1 without any.
Equal rows score alike. No rows: no result rows; clashing extra columns are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.training import training_rows

FIT_ROWS = {0: 3000, 1: 5000}
VOCABULARY = 4000
SIZE, NONZERO, REACH = 96, 6, 2
HIDDEN, EPOCHS = 24, 60
CACHE_WORDS = 200_000

MARKS = ["upper", "title", "lower", "signs", "lone", "digits", "long", "plain", "same", "seen"]
_LETTERS = re.compile(r"[^\W_]+")
_RUN = re.compile(r"([^\w\s])\1|[^\w\s]{3,}")


def index_vector(token: str, size: int = SIZE) -> np.ndarray:
    """Ternary vector with ``NONZERO`` entries, from the token's hash alone."""
    raw = hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=2 * NONZERO).digest()
    out = np.zeros(size, np.float32)
    for i in range(NONZERO):
        out[raw[2 * i] % size] += 1.0 if raw[2 * i + 1] & 1 else -1.0
    return out


def marks(token: str) -> list[str]:
    """The form of one token between blanks."""
    out = []
    letters = "".join(_LETTERS.findall(token))
    if not letters:
        out.append("lone")
    elif letters.isdigit():
        out.append("digits")
    elif len(letters) > 1 and letters.isupper():
        out.append("upper")
    else:
        out.append("title" if letters[0].isupper() else "lower")
    out.append("signs" if _RUN.search(token) else "plain")
    if len(letters) > 25:
        out.append("long")
    return out


def word_of(token: str) -> str:
    return "".join(_LETTERS.findall(token.lower()))


@dataclass
class TextVectors:
    """Vectors of the vocabulary; a text's vector is the mean over words and marks."""

    words: dict[str, np.ndarray]

    def __post_init__(self):
        self.mark = {m: 3 * index_vector(f"<{m}>") for m in MARKS}
        self._reset()

    def __getstate__(self):
        return {"words": self.words}

    def __setstate__(self, state):
        self.words = state["words"]
        self.__post_init__()

    def _reset(self):
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, SIZE), np.float32)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        if len(self.row) > CACHE_WORDS:
            self._reset()
        row = self.row
        for t in set(tokens).difference(row):
            if len(row) == len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            vector = sum(self.mark[m] for m in marks(t))
            known = self.words.get(word_of(t))
            self.table[len(row)] = vector if known is None else vector + known
            row[t] = len(row)
        return np.fromiter(map(row.__getitem__, tokens), np.int64, len(tokens))

    def of(self, text: str | None, slice_tokens: int = 50_000) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(SIZE, np.float32)
        total, last, same, kinds = np.zeros(SIZE, np.float64), None, 0, len(set(tokens))
        for at in range(0, len(tokens), slice_tokens):
            part = tokens[at : at + slice_tokens]
            rows = self._rows(part)
            unique, counts = np.unique(rows, return_counts=True)
            total += counts @ self.table[unique]
            same += int((rows[1:] == rows[:-1]).sum()) + (last == part[0])
            last = part[-1]
        total += same * self.mark["same"] + (len(tokens) - kinds) * self.mark["seen"] / 3
        return (total / len(tokens)).astype(np.float32)


@dataclass
class QualityModel:
    vectors: TextVectors
    layers: tuple | None
    temperature: float = 1.0
    share: float = 1.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return _sigmoid(_forward(self.layers, x)[1] / self.temperature)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(layers, x):
    mean, scale, w1, b1, w2, b2 = layers
    hidden = np.tanh((x - mean) / scale @ w1 + b1)
    return hidden, hidden @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray, w: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple:
    """Two layers by Adam on the weighted log-loss."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    p = [rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, step = (x - mean) / scale, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at : at + 128]
            hidden = np.tanh(z[i] @ p[0] + p[1])
            error = w[i] * (_sigmoid(hidden @ p[2] + p[3]) - y[i]) / len(i)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return mean, scale, *p


def _temperature(logits: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The divisor of the logits with the least log-loss, on a grid."""
    grid = np.geomspace(0.25, 8, 60)
    loss = [-(w * np.log(np.clip(np.where(y == 1, q := _sigmoid(logits / t), 1 - q), 1e-12, 1))).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _word_vectors(rows: DataFrame, vocabulary: int) -> dict[str, np.ndarray]:
    """Context sums of the most frequent words, added up on Spark."""
    known = rows.select(F.explode(F.split(F.lower("text"), r"[\s\p{Punct}]+")).alias("w")).where("w <> ''")
    known = known.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(vocabulary)
    words = sorted(r["w"] for r in known.collect())
    at = {w: i for i, w in enumerate(words)}
    index = np.array([index_vector(w) for w in words] or np.zeros((0, SIZE)), np.float32)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(words), SIZE), np.float64)
        for part in parts:
            for text in part["text"]:
                ids = np.array([at.get(word_of(t), -1) for t in text.split()], np.int64)
                for d in range(1, REACH + 1):
                    a, b = ids[:-d], ids[d:]
                    both = (a >= 0) & (b >= 0)
                    np.add.at(total, a[both], index[b[both]])
                    np.add.at(total, b[both], index[a[both]])
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        if len(used):
            yield pd.DataFrame({"i": used, "v": [total[i].tolist() for i in used]})

    parts = rows.select("text").mapInPandas(sums, "i long, v array<double>")
    flat = parts.select("i", F.posexplode("v").alias("k", "x")).groupBy("i", "k").agg(F.sum("x").alias("x")).toPandas()
    context = np.zeros((len(words), SIZE))
    context[flat["i"], flat["k"]] = flat["x"]
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return {w: (0.3 * index[i] + context[i]).astype(np.float32) for w, i in at.items()}


def learn(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = FIT_ROWS, vocabulary: int = VOCABULARY) -> QualityModel:
    rows, totals = training_rows(docs, labels, "quality", per_class)
    rows = rows.repartition(24, "doc_id")
    if set(totals) != {0, 1}:
        return QualityModel(TextVectors({}), None, share=float(1 not in totals and 0 not in totals or 1 in totals))
    vectors = TextVectors(_word_vectors(rows, vocabulary))
    table = rows.select("doc_id", "y", _pooled(vectors)("text").alias("v")).toPandas().sort_values(["doc_id", "y"])
    if table["y"].nunique() < 2:
        return QualityModel(vectors, None, share=float(table["y"].mean()) if len(table) else 1.0)
    x, y = np.stack(table["v"].to_numpy()).astype(np.float64), table["y"].to_numpy(float)
    n = {c: (y == c).sum() for c in (0, 1)}
    w = np.where(y == 1, totals[1] / n[1], totals[0] / n[0])
    w /= w.mean()
    fifth = np.arange(len(x)) % 5 == 0
    layers = _train(x[~fifth], y[~fifth], w[~fifth])
    return QualityModel(vectors, layers, _temperature(_forward(layers, x[fifth])[1], y[fifth], w[fifth]))


def _pooled(vectors: TextVectors):
    @F.pandas_udf("array<float>")
    def pooled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([vectors.of(t) for t in texts])

    return pooled


def score(docs: DataFrame, model: QualityModel, column: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            if len(texts):
                x = np.stack([model.vectors.of(t) for t in texts]).astype(np.float64)
                yield pd.Series(model.predict(x))
            else:
                yield pd.Series([], dtype="float64")

    return docs.withColumn(into, probability(column))
