"""URL rules and a character language-model ratio for the URLs no rule names.

Rules (host, path, verdict) are matched with built-in expressions: a rule fits
its host and all subdomains if the path starts with the rule's, and the longest
wins. The URLs that rules accept or reject train one smoothed variable-order
Markov model each: exact counts of all contexts of 0 to ``ORDER`` bytes with the
byte that follows, gathered over all such URLs in a table that grows with them.
Each order backs off to the next shorter one in proportion to how little was
seen of its context. A URL is scored by the mean log-likelihood difference of
its bytes; a logistic curve, fitted on a held-out fifth of the labelled URLs
(classes weighed alike) as scored by the counts of the others, turns that into a
probability, and at 0.5 or more the URL is allowed.

URLs are dealt into buckets; each sends the distinct keys it needs to the table
and gets back their counts, so that no counts are broadcast or collected.

A null URL, or one without ``://``, has an empty host and path. If either class
has no URL, nothing tells them apart and all URLs without a rule are allowed.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, materialize, parts, tidy, tidy_group, tidy_pair, unit_hash

ORDER = 5
BIN = 0.02
#: How many counts the shorter context's estimate weighs.
PRIOR = 2.0
#: MB of input in a bucket; bytes of URLs that are laid out at once.
BUCKET_MB = 16.0
CHUNK = 500_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")


def match(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Adds host, path and rule (null where none fits)."""
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.name).otherwise(rule)
    return df.withColumn("rule", rule)


def _laid(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all URLs, each with ORDER start bytes and an end byte; where URL bytes are; how many each has."""
    data = np.frombuffer(b"".join(b"\0" * ORDER + u + b"\1" for u in urls), np.uint8)
    sizes = np.array([len(u) + 1 for u in urls])
    ends = np.cumsum(sizes + ORDER)
    real = np.ones(len(data), bool)
    for k in range(ORDER):
        real[ends - sizes - ORDER + k] = False
    return data, np.flatnonzero(real), sizes


def _keys(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each position's context of k bytes, and of context and byte."""
    h = np.full(len(at), 14695981039346656037 + k, np.uint64)
    prime = np.uint64(1099511628211)
    for j in range(k, 0, -1):
        h = (h ^ data[at - j]) * prime
    g = ((h ^ data[at]) * prime ^ np.uint64(0x5BD1)) * prime
    mix = lambda x: (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return mix(h), mix(g)


def key_counts(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all orders, sorted, and how often each occurs."""
    if not urls:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, at, _ = _laid(urls)
    return np.unique(np.concatenate([x for k in range(ORDER + 1) for x in _keys(data, at, k)]), return_counts=True)


def ratio(urls: list[bytes], keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference of each URL's bytes, accepted less rejected.

    keys: sorted; seen: their counts among rejected and accepted URLs, (2, keys).
    """
    if not urls:
        return np.zeros(0)
    data, at, sizes = _laid(urls)
    keys, seen = np.append(keys, np.uint64(2**64 - 1)), np.concatenate([seen, np.zeros((2, 1))], axis=1)

    def count(x: np.ndarray) -> np.ndarray:
        i = np.searchsorted(keys, x)
        return seen[:, i] * (keys[i] == x)

    p = np.full((2, len(at)), 1 / 256)
    for k in range(ORDER + 1):
        c, g = _keys(data, at, k)
        p = (count(g) + PRIOR * p) / (count(c) + PRIOR)
    d = np.log(p[1]) - np.log(p[0])
    return np.add.reduceat(d, np.cumsum(sizes) - sizes) / sizes


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, with a slight pull to zero."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([r @ x + 1e-3 * a, r.sum()])
        h = np.array([[v @ (x * x) + 1e-3, v @ x], [v @ x, v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


_ASK = "key long, b int"
_SCORED = "page_id long, host string, path string, rule string, accepted boolean, held boolean, x double, y double"


def count_keys(labelled: DataFrame) -> DataFrame:
    """(key, f0, f1, h0, h1): exact counts of (u, accepted, held): fitted and held-out, rejected and accepted."""

    def run(batches):
        for b in batches:
            kind = 2 * np.array(b.column(2).to_pylist(), int) + np.array(b.column(1).to_pylist(), int)
            urls = b.column(0)
            for k in range(4):
                for some in chunked((urls[i].as_py() for i in np.flatnonzero(kind == k).tolist()), CHUNK):
                    keys, n = key_counts(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n)], ["k", "key", "n"])

    rows = labelled.select("u", "accepted", "held").mapInArrow(tidy(run), "k int, key long, n long")
    each = (F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(("f0", "f1", "h0", "h1")))
    return rows.groupBy("key").agg(*each)


def _ask(t: pa.Table) -> pa.Table:
    """The distinct keys that a bucket's URLs need."""
    found = [key_counts(some)[0] for some in chunked((x.as_py() or b"" for x in t["u"]), CHUNK)]
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return pa.table([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), t["b"][0].as_py()), pa.int32())], ["key", "b"])


def _score(t: pa.Table, c: pa.Table) -> pa.Table:
    """Both ratios of a bucket's URLs: by all counts, and by those of fitted URLs alone."""
    keys = c["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, (f0, f1, h0, h1) = keys[order], (c[k].to_numpy().astype(float)[order] for k in ("f0", "f1", "h0", "h1"))
    x, y = [], []
    for some in chunked((u.as_py() or b"" for u in t["u"]), CHUNK):
        x.append(ratio(some, keys, np.stack([f0 + h0, f1 + h1])))
        y.append(ratio(some, keys, np.stack([f0, f1])))
    t = t.append_column("x", pa.array(np.concatenate(x))).append_column("y", pa.array(np.concatenate(y))) if x else t.append_column("x", pa.array([], pa.float64())).append_column("y", pa.array([], pa.float64()))
    return t.select([k.split()[0] for k in _SCORED.split(", ")]).combine_chunks()


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset that turn a ratio into a probability, from held-out rows (accepted, y)."""
    bins = scored.groupBy(F.round(F.col("y") / BIN).cast("int").alias("x"), "accepted").count().toArrow()  # few: |log ratio| <= log(256 + counts)
    y, n = np.array(bins["accepted"].to_pylist(), float), bins["count"].to_numpy().astype(float)
    if not 0 < n @ y < n.sum():
        return 1.0, 0.0
    return logistic(bins["x"].to_numpy() * BIN, y, np.where(y > 0, n / (n @ y), n / (n @ (1 - y))) * 100)


def judge(df: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of df."""
    rows = match(df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url")), rules)
    accepted = F.lit(None).cast("boolean")
    for r in rules:
        accepted = F.when(F.col("rule") == r.name, r.allow).otherwise(accepted)
    rows = rows.select("page_id", "host", "path", "rule", accepted.alias("accepted"), (unit_hash(F.col("url"), seed=2) < 0.2).alias("held"), F.col("url").cast("binary").alias("u"))
    labelled = rows.where("accepted is not null and u is not null")
    if labelled.select("accepted").distinct().count() == 2:
        n = parts(df, BUCKET_MB)
        dealt = rows.withColumn("b", F.pmod(F.xxhash64("page_id", "u"), F.lit(n)).cast("int")).repartition(n, "b")
        asked = dealt.groupBy("b").applyInArrow(tidy_group(_ask), _ASK)
        found = asked.join(materialize(count_keys(labelled)), "key")
        scored = materialize(dealt.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(tidy_pair(_score), _SCORED))
        slope, offset = calibrate(scored.where("held and accepted is not null"))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("x") * slope + offset))))
    else:
        scored, p = rows, F.lit(1.0)
    said = F.when(F.coalesce("accepted", F.col("score") >= 0.5), "allow").otherwise("block")
    return scored.withColumn("score", p).select("page_id", "host", "path", "rule", said.alias("verdict"), "score")
