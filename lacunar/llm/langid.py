"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (1 to 3, of the lower-cased text, everything but
letters as one blank) hashed to ``DIM`` columns, weighted log(1 + tf) * idf and
scaled to length 1. Document frequencies come from all rows that may be learned
from. Weights are fitted by follow-the-regularised-leader with an elastic net
on about ``SAMPLE`` rows a language (a row is taken if the hash of its id falls
below SAMPLE / rows of its language), and the probabilities are calibrated by a
temperature fitted on a fifth of them.

A null text or one without a letter is ``und`` with score 0. Rows with null
``lang`` are not learned from; without any row to learn from all is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, unit_hash

DIM = 1 << 15
SAMPLE = 1500
ORDERS = 3

_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def grams(text: str) -> np.ndarray | None:
    """Hashed n-grams of a text, or None if it has no letter."""
    u = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = u < len(_LETTER)
    if low.all():
        letter = _LETTER[u]
    else:
        letter = np.fromiter((c.isalpha() for c in text.lower()), bool, len(u))
    if not letter.any():
        return None
    u = np.where(letter, u, np.uint32(32))
    u = np.concatenate([[np.uint32(32)], u, [np.uint32(32)]]).astype(np.uint32)
    u = u[np.concatenate([[True], (u[1:] != 32) | (u[:-1] != 32)])]  # runs of blanks as one
    h, out = u * _MIX[0], []
    for k in range(ORDERS):
        if k:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[1] + u[k:] * _MIX[2]
        out.append((h ^ (h >> np.uint32(16))) % np.uint32(DIM))
    return np.concatenate(out)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    g = grams(text)
    if g is None:
        return None
    counts = np.bincount(g, minlength=DIM)
    at = np.flatnonzero(counts)
    v = np.log1p(counts[at]) * idf[at]
    return at, v / (np.sqrt(v @ v) or 1.0)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIM + 1, languages); the last row is the bias
    temperature: float = 1.0

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text, self.idf) if text and self.langs else None
        if x is None:
            return "und", 0.0
        z = self.logits(*x) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Per-coordinate FTRL-proximal for the softmax loss; the bias has no penalty."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(at, a1, a2):
        s = z[at]
        return np.where(np.abs(s) > a1, -(s - np.sign(s) * a1) / ((beta + np.sqrt(n[at])) / alpha + a2), 0.0)

    for _ in range(epochs):
        for at, v, y in rows:
            w, b = weights(at, l1, l2), weights(DIM, 0.0, 0.0)
            s = v @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            for i, wi, g in ((at, w, v[:, None] * p), (DIM, b, p)):
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - sigma * wi
                n[i] += g * g
    full = weights(slice(None), l1, l2)
    full[-1] = weights(DIM, 0.0, 0.0)
    return full


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, from a grid.

    Targets are smoothed by one row for each class, so that data without an
    error still give a finite temperature.
    """
    best = (np.inf, 1.0)
    eps = 1.0 / (len(y) + logits.shape[1])
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 200)):
        s = logits / t
        m = s.max(axis=1)
        nll = (m + np.log(np.exp(s - m[:, None]).sum(axis=1)) - (1 - eps) * s[np.arange(len(y)), y] - eps * s.mean(axis=1)).mean()
        best = min(best, (nll, float(t)))
    return best[1]


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on the rows of df, all of which may be learned from."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(DIM), np.zeros((DIM + 1, 0)))

    def seen(batches):
        df_ = np.zeros(DIM, np.int64)
        for b in batches:
            for x in b.column(0):
                g = grams(x.as_py())
                if g is not None:
                    df_ += np.bincount(g, minlength=DIM) > 0
        at = np.flatnonzero(df_)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df_[at], pa.int64())], ["f", "n"])

    freq = np.zeros(DIM)
    for r in rows.select("t").mapInArrow(tidy(seen), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # DIM rows at most
        freq[r["f"]] = r["n"]
    idf = np.log((1 + sum(counts.values())) / (1 + freq)) + 1

    rate = F.lit(0.0)
    for name in langs:
        rate = F.when(F.col("l") == name, min(1.0, sample / counts[name])).otherwise(rate)

    def made(batches):
        for b in batches:
            out = [(k, name, *(x := vector(t, idf))) for k, name, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if grams(t) is not None]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array([a.astype(np.int32).tobytes() for a in cols[2]], pa.binary()), pa.array([a.astype(np.float32).tobytes() for a in cols[3]], pa.binary())], ["k", "l", "at", "v"])

    got = rows.where(unit_hash(F.col("k"), seed=9) < rate).select(F.col("k").cast("long"), "l", "t").mapInArrow(tidy(made), "k long, l string, at binary, v binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["k"] * 0x9E3779B97F4A7C15 % (1 << 64) if r["k"] is not None else -1, r["at"], r["v"]))
    data = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["v"], np.float32).astype(float), langs.index(r["l"])) for r in got]
    fit, rest = [r for i, r in enumerate(data) if i % 5], data[::5]
    model = Model(langs, idf, ftrl(fit or rest, len(langs)))
    if rest:
        model.temperature = calibrate(np.array([model.logits(at, v) for at, v, _ in rest]), np.array([y for *_, y in rest]))
    return model


def predict(df: DataFrame, model: Model, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row in one narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIM x languages at most

    def run(batches):
        for b in batches:
            got = [shared.value.predict(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return df.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("t")).mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
