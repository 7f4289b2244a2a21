"""Document quality from a conditional random field over lines.

Every line is good or bad. Its features are shares of byte classes, word
length, repetition of words and lines, and the same figures of the lines before
and after. Only documents carry labels, so lines start with their document's
label; then, twice, lines of bad documents are relabelled by the fitted field
(a bad document keeps its worst line bad) and the field is fitted again. The
forward-backward marginals of "good", weighted by line length, give the quality
of a document, and a logistic curve fitted on the sample turns that into the
probability of label 1.

The field is fitted on about ``SAMPLE`` labelled rows (taken by the hash of
their ids); every text is scored whole. A null or empty text is one empty line.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, small_batches, tidy, unit_hash
from .urlfilter import logistic

SAMPLE = 6000
#: Bytes of text whose features are computed at once.
CHUNK = 1_000_000
OWN = 15
FEATURES = 3 * OWN + 1


def _table(where) -> np.ndarray:
    return np.array([where(b) for b in range(256)], bool)


_SPACE = _table(lambda b: b in b" \t\r\v\f\n")
_UPPER = _table(lambda b: 65 <= b <= 90)
_LOWER = _table(lambda b: 97 <= b <= 122)
_DIGIT = _table(lambda b: 48 <= b <= 57)
_HIGH = _table(lambda b: b >= 128)
_STOP = _table(lambda b: b in b".,;:?'\"()-")
_BANG = _table(lambda b: b in b"!")
_PIPE = _table(lambda b: b in b"|")
_ODD = ~(_SPACE | _UPPER | _LOWER | _DIGIT | _HIGH | _STOP | _BANG | _PIPE)
_MIX = np.array([pow(6364136223846793005, k + 1, 1 << 64) for k in range(256)], np.uint64)
_POW = np.array([pow(1099511628211, k, 1 << 64) for k in range(64)], np.uint64)


@dataclass
class Lines:
    x: np.ndarray  # (lines, FEATURES)
    size: np.ndarray  # bytes of each line
    docs: np.ndarray  # first line of each document, and the number of lines


def features(texts: list[bytes]) -> Lines:
    """Features of all lines of some texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(starts)
    size = ends - starts
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    docs = np.concatenate([[0], np.searchsorted(ends, doc_ends - 1, "left") + 1])
    doc_of = np.repeat(np.arange(len(texts)), np.diff(docs))
    many = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64).astype(float)
    space = _SPACE[data]
    upper, digit, stop, bang, pipe, odd, high = (many(t[data]) for t in (_UPPER, _DIGIT, _STOP, _BANG, _PIPE, _ODD, _HIGH))
    # an accented capital is C3 and a byte from 80 to 9E
    upper += many(np.concatenate([[False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)]))
    letters = many(_LOWER[data]) + high + many(_UPPER[data])
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    line_of = np.searchsorted(ends, first, "left")
    words = np.bincount(line_of, minlength=n).astype(float)
    again, kinds, seen = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(first):
        at = np.zeros(len(data), np.int64)
        at[first[0] :] = np.arange(first[0], len(data)) - np.repeat(first, np.diff(np.concatenate([first, [len(data)]])))
        h = np.where(space, np.uint64(0), _MIX[data] * _POW[np.minimum(at, 63)])
        h = np.add.reduceat(h, first)
        h ^= h >> np.uint64(31)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])])
        again = np.bincount(line_of[same], minlength=n).astype(float)
        key = np.sort(line_of.astype(np.uint64) << np.uint64(40) | h & np.uint64((1 << 40) - 1))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        kinds = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)
        rank = np.arange(len(first)) - np.searchsorted(line_of, line_of, "left")
        total = np.zeros(n, np.uint64)
        np.add.at(total, line_of, h * (rank.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        key = doc_of.astype(np.uint64) << np.uint64(40) | total >> np.uint64(24)
        order = np.argsort(key, kind="stable")
        twin = np.zeros(n, bool)
        twin[order[1:]] = key[order[1:]] == key[order[:-1]]
        seen = (twin & (words > 0)).astype(float)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    own = np.stack([
        np.log1p(size) / 6, letters / b, upper / np.maximum(letters, 1), digit / b, stop / b, bang / w, pipe / w, odd / b,
        np.minimum((size - words) / w, 20) / 10, again / w, kinds / w, seen, words == 0, np.log1p(words) / 5, (again > 2) * 1.0,
    ], axis=1)
    first_line, last_line = np.zeros(n, bool), np.zeros(n, bool)
    first_line[docs[:-1]] = last_line[docs[1:] - 1] = True
    prev = np.where(first_line[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last_line[:, None], 0, np.roll(own, -1, axis=0))
    return Lines(np.concatenate([own, prev, after, np.ones((n, 1))], axis=1), size, docs)


@dataclass
class Field:
    """Two states, 0 good and 1 bad: emission weights of bad, and the transitions."""

    w: np.ndarray
    t: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, e: np.ndarray, docs: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """P(bad) of each line, expected transition counts, sum of log partition values.

        All documents advance together, one line a step, the longest first.
        """
        n = np.diff(docs)
        order = np.argsort(-n, kind="stable")
        start, size = docs[:-1][order], n[order]
        steps = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # documents with more than k lines
        emit = np.stack([np.zeros(len(e)), e], axis=1)
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        shift = np.maximum(e, 0)
        trans = np.exp(self.t)
        fwd, scale = np.empty((len(e), 2)), np.empty(len(e))
        for k in range(steps):
            at = start[: alive[k]] + k
            f = emit[at] if k == 0 else (fwd[at - 1] @ trans) * emit[at]
            s = f.sum(axis=1)
            fwd[at], scale[at] = f / s[:, None], s
        bwd = np.ones((len(e), 2))
        expected = np.zeros((2, 2))
        for k in range(steps - 2, -1, -1):
            at = start[: alive[k + 1]] + k
            nxt = emit[at + 1] * bwd[at + 1] / scale[at + 1, None]
            bwd[at] = nxt @ trans.T
            if pairs:
                expected += trans * (fwd[at].T @ nxt)
        p = fwd * bwd
        return p[:, 1] / p.sum(axis=1), expected, float(np.log(scale).sum() + shift.sum())

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted share of good lines of each document."""
        bad, _, _ = self.marginals(lines.x @ self.w, lines.docs)
        weight = lines.size + 1e-3
        return np.add.reduceat(weight * (1 - bad), lines.docs[:-1]) / np.add.reduceat(weight, lines.docs[:-1])

    def score(self, texts: Iterable[bytes]) -> np.ndarray:
        q = [self.quality(features(part)) for part in chunked(texts, CHUNK)]
        return 1 / (1 + np.exp(-(self.slope * _logit(np.concatenate(q)) + self.offset))) if q else np.zeros(0)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-3, 1 - 1e-3)
    return np.log(q / (1 - q))


def _fit(lines: Lines, y: np.ndarray, field: Field, rounds: int = 150, penalty: float = 1e-4, rate: float = 0.1) -> Field:
    """Maximises the conditional likelihood of line labels y with Adam."""
    inner = np.ones(len(y), bool)
    inner[lines.docs[:-1]] = False
    here = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here - 1], y[here]), 1)
    theta = np.concatenate([field.w, field.t.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1, len(y))
    for k in range(1, rounds + 1):
        now = Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
        bad, pairs, _ = now.marginals(lines.x @ now.w, lines.docs, pairs=True)
        g = np.concatenate([lines.x.T @ (bad - y), (pairs - seen).ravel()]) / n + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def fit(lines: Lines, good: np.ndarray) -> Field:
    """From the lines of documents and the documents' labels (1 good, 0 bad)."""
    if not len(good):
        return Field(np.zeros(FEATURES), np.zeros((2, 2)))
    n = np.diff(lines.docs)
    doc_of = np.repeat(np.arange(len(good)), n)
    y = (1 - good)[doc_of].astype(np.int64)
    field = _fit(lines, y, Field(np.zeros(FEATURES), np.zeros((2, 2))))
    for _ in range(2):
        bad, _, _ = field.marginals(lines.x @ field.w, lines.docs)
        worst = np.maximum.reduceat(bad, lines.docs[:-1])
        y = ((good[doc_of] == 0) & ((bad > 0.5) | (bad >= worst[doc_of]))).astype(np.int64)
        field = _fit(lines, y, field)
    field.slope, field.offset = logistic(_logit(field.quality(lines)), good.astype(float), np.ones(len(good)))
    return field


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Field:
    """Fits on documents that labels (key, label) names; ids with null labels are left out."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    n = rows.count()
    if not n:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)))
    some = rows.where(unit_hash(F.col("k"), seed=4) < sample / n).limit(2 * sample)
    pairs = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).join(F.broadcast(some), "k").select("k", "y", "t")  # 2 x sample ids at most

    def made(batches):
        for b in batches:
            out = []
            for k, y, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                f = features([t or b""])
                out.append((k, y, f.x.astype(np.float32).tobytes(), f.size.astype(np.int32).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["k", "y", "x", "size"])

    got = pairs.select(F.col("k").cast("long"), "y", "t").mapInArrow(tidy(made), "k long, y int, x binary, size binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["k"], r["x"]))
    if not got:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)))
    sizes = [np.frombuffer(r["size"], np.int32) for r in got]
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]).astype(float)
    return fit(Lines(x, np.concatenate(sizes), np.concatenate([[0], np.cumsum([len(s) for s in sizes])])), np.array([r["y"] for r in got]))


def score(df: DataFrame, field: Field, held_out: Column, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row in one narrow pass."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(field)  # some hundred numbers

    def run(batches):
        for b in batches:
            s = shared.value.score(x.as_py() or b"" for x in b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return df.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("binary").alias("t")).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, field: Field, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of df whose text scores threshold or more, all columns as they are."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(field)
    place = df.columns.index(text)

    def run(batches):
        for b in batches:
            s = shared.value.score((x.as_py() or "").encode() for x in b.column(place))
            yield b.filter(pa.array(s >= threshold))

    return df.mapInArrow(tidy(run), df.schema)
