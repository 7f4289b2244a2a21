"""Matrix profiles: nearest z-normalised subsequence of a series.

The profile works on tiles, pairs of blocks of windows, whose minima alone leave
a task. Where all pairs are the result, pairs (i, i + lag) are dealt by series and
lag; the dot product of two subsequences is a moving sum of products along a lag.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scores import contamination, minmax
from .series import ahead

#: Windows of a block.
BLOCK = 1024


def rolling_stats(df: DataFrame, m: int, ddof: int = 1) -> DataFrame:
    """(series_id, idx, mu, sd) of full windows; deviations under 1e-8 are 0."""
    sd = F.stddev_samp("value") if ddof else F.stddev_pop("value")
    out = df.withColumn("mu", F.avg("value").over(ahead(m))).withColumn("sd", sd.over(ahead(m))).withColumn("_n", F.count(F.lit(1)).over(ahead(m)))
    return out.where(F.col("_n") == m).select("series_id", "idx", "mu", F.when(F.col("sd") < 1e-8, 0.0).otherwise(F.col("sd")).alias("sd"))


def _distance(qt: Column, m: int, ddof: int) -> Column:
    """From the dot product of two windows; flat ones are 0 apart, and the other's length from others."""
    corr = (qt - m * F.col("mu") * F.col("mu2")) / (F.col("sd") * F.col("sd2"))
    both = F.sqrt(F.greatest(F.lit(0.0), 2 * (m - corr)))
    norm = F.sqrt(F.lit(float(m - ddof)))
    return F.when((F.col("sd") == 0) & (F.col("sd2") == 0), 0.0).when((F.col("sd") == 0) | (F.col("sd2") == 0), norm).otherwise(both)


def pairs(df: DataFrame, m: int, ddof: int = 1, split: int | None = None) -> DataFrame:
    """(series_id, idx, other, d): all pairs outside the exclusion zone, idx < other.

    The zone of i is [round(i - m / 2), round(i + m / 2 + 1)), halves to even.
    split: only pairs on either side of it.
    """
    rows = df.select("series_id", "idx", "value")
    whole = rows.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("v"))  # one array a series
    lags = whole.select("series_id", "v", F.explode(F.sequence(F.lit(max(1, m // 2)), F.greatest(F.size("v") - m, F.lit(max(1, m // 2))))).alias("lag")).where(F.col("lag") + m <= F.size("v"))
    lags = lags.repartition("series_id", "lag")
    products = lags.select("series_id", "lag", F.posexplode(F.zip_with(F.slice("v", F.lit(1), F.size("v") - F.col("lag")), F.slice("v", F.col("lag") + 1, F.size("v") - F.col("lag")), lambda a, b: a * b)).alias("idx", "p"))
    by = Window.partitionBy("series_id", "lag").orderBy("idx").rowsBetween(0, m - 1)
    dots = products.withColumn("qt", F.sum("p").over(by)).withColumn("_n", F.count(F.lit(1)).over(by)).where(F.col("_n") == m)
    dots = dots.select("series_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") + F.col("lag")).cast("long").alias("other"), "qt")
    zone = lambda i, j: (j >= F.bround(i - m / 2)) & (j < F.bround(i + m / 2 + 1))
    # a pair is left out for the one whose zone holds the other
    dots = dots.withColumn("a_free", ~zone(F.col("idx"), F.col("other"))).withColumn("b_free", ~zone(F.col("other"), F.col("idx"))).where("a_free or b_free")
    if split is not None:
        dots = dots.where((F.col("idx") <= split) & (F.col("other") > split))
    s = rolling_stats(df, m, ddof)
    other = s.select("series_id", F.col("idx").alias("other"), F.col("mu").alias("mu2"), F.col("sd").alias("sd2"))
    out = dots.join(s, ["series_id", "idx"]).join(other, ["series_id", "other"])
    return out.select("series_id", "idx", "other", "a_free", "b_free", _distance(F.col("qt"), m, ddof).alias("d"))


def _tile(m: int, ddof: int, split: int | None):
    """Least distances of the windows of two blocks of one series to each other."""

    def windows(v, start):
        w = np.lib.stride_tricks.sliding_window_view(np.asarray(v, float), m) if len(v) >= m else np.zeros((0, m))
        x = w - w.mean(1, keepdims=True)
        sd = np.sqrt((x * x).sum(1) / (m - ddof))
        flat = sd < 1e-8
        return x / np.where(flat, 1.0, sd)[:, None], flat, start + np.arange(len(w))

    def least(d, i, j, key):
        far = (j[None, :] < np.round(i - m / 2)[:, None]) | (j[None, :] >= np.round(i + m / 2 + 1)[:, None])
        if split is not None:
            far &= (i <= split)[:, None] != (j <= split)[None, :]
        mp = np.where(far, d, np.inf).min(1, initial=np.inf)
        keep = np.isfinite(mp)
        return pd.DataFrame({"series_id": key[0], "idx": i[keep], "mp": mp[keep]})

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        (x, fx, i), (y, fy, j) = (windows(r.v, r.start) for r in (pdf.iloc[0], pdf.iloc[-1]))
        d = np.sqrt(np.maximum(0.0, 2 * (m - x @ y.T)))
        d = np.where(fx[:, None] & fy[None, :], 0.0, np.where(fx[:, None] | fy[None, :], np.sqrt(float(m - ddof)), d))
        out = least(d, i, j, key)
        return out if key[1] == key[2] else pd.concat([out, least(d.T, j, i, key)])

    return run


def matrix_profile(df: DataFrame, m: int, ddof: int = 1, split: int | None = None, block: int = BLOCK) -> DataFrame:
    """(series_id, idx, mp): distance to the nearest other window outside the exclusion zone.

    Windows are dealt into blocks of ``block`` starts; each pair of blocks of a
    series is one tile, in which NumPy takes all products at once and of which
    only a row for each window leaves. So n windows ship n * n / block rows.
    split: only pairs on either side of it.
    """
    b = F.floor(F.col("idx") / block)
    also = F.when((F.col("idx") % block < m - 1) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))
    blocks = df.select("series_id", "idx", "value", F.explode(also).alias("block")).groupBy("series_id", "block")
    blocks = blocks.agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("x"))  # block + m - 1 values
    blocks = blocks.select("series_id", "block", F.col("x")[0]["idx"].alias("start"), F.transform("x", lambda x: x["value"].cast("double")).alias("v"))
    last = blocks.groupBy("series_id").agg(F.max("block").alias("last"))
    each = blocks.join(last, "series_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    tiles = each.select("series_id", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "start", "v")
    found = tiles.groupBy("series_id", "p", "q").applyInPandas(_tile(m, ddof, split), "series_id string, idx long, mp double")
    return found.groupBy("series_id", "idx").agg(F.min("mp").alias("mp"))


def distance_profile(df: DataFrame, query: DataFrame, m: int, ddof: int = 1) -> DataFrame:
    """(series_id, idx, d): distances of the window that starts at query (series_id, start) to all."""
    from .series import segments

    seg = segments(df, m).join(rolling_stats(df, m, ddof), ["series_id", "idx"])
    q = seg.join(query, "series_id").where(F.col("idx") == F.col("start")).select("series_id", F.col("seg").alias("qseg"), F.col("mu").alias("mu2"), F.col("sd").alias("sd2"))
    qt = F.aggregate(F.zip_with("seg", "qseg", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return seg.join(q, "series_id").select("series_id", "idx", _distance(qt, m, ddof).alias("d"))


def discords(df: DataFrame, m: int, share: float = 0.1, ddof: int = 1) -> DataFrame:
    """(series_id, idx, score, pred): scaled profile, zeros for the last m - 1 values, contamination.

    Scores have nine places, so that windows equally far from all others tie.
    """
    mp = minmax(matrix_profile(df, m, ddof), ["mp"], ["series_id"])
    out = df.select("series_id", "idx").join(mp, ["series_id", "idx"], "left").withColumn("score", F.round(F.coalesce("mp", F.lit(0.0)), 9))
    return contamination(out, share, ["series_id"]).select("series_id", "idx", "score", "pred")


def concatenate(train: DataFrame, test: DataFrame) -> DataFrame:
    """train and, after it, test, which counts on from the last position of train."""
    n = train.groupBy("series_id").agg((F.max("idx") + 1).alias("_n"))
    later = test.join(n, "series_id", "left").withColumn("idx", F.col("idx") + F.coalesce("_n", F.lit(0))).drop("_n")
    return train.withColumn("part", F.lit(0)).unionByName(later.withColumn("part", F.lit(1)))


__all__ = ["concatenate", "discords", "distance_profile", "matrix_profile", "pairs", "rolling_stats"]
