"""Nearest neighbours and the detectors built on them.

Points are dealt into blocks; every pair of blocks is one tile, whose distances
NumPy computes at once and of which only the k best of each query leave the
task. So the exact join costs n * n distances but ships k rows a query and task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scores import contamination, minmax

BLOCK = 1024


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean", p: float = 3.0) -> np.ndarray:
    """All distances of the rows of x to those of y."""
    if metric == "euclidean":
        with np.errstate(over="ignore", invalid="ignore"):
            d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
            i, j = np.nonzero(~(d >= 1e-6 * (1 + (x * x).sum(1)[:, None])) | ~np.isfinite(d))  # cancellation: those again by difference
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                d[a, b] = ((x[a] - y[b]) ** 2).sum(1)
            return np.sqrt(np.maximum(d, 0))
    if metric == "cosine":
        n = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(n == 0, 0.0, x @ y.T / n)
        return np.arccos(np.where((c > 1 - 1e-8) | np.isnan(c), 1.0, np.clip(c, -1, 1))) / math.pi  # as the column function
    out = np.empty((len(x), len(y)))
    for i, r in enumerate(x):
        d = np.abs(y - r)
        if metric == "manhattan":
            out[i] = d.sum(1)
        elif metric == "chebyshev":
            out[i] = d.max(1)
        elif metric == "minkowski":
            out[i] = (d * d * d if p == 3 else d**p).sum(1) ** (1 / p)
        else:
            raise ValueError(f"unknown metric: {metric}")
    return out


def _blocks(points: DataFrame, name: str, size: int, by: str | None = None) -> DataFrame:
    b = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-points.count() // size))))
    if by:  # so many blocks for each group
        n = points.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
        points, b = points.join(n, by), F.pmod(F.xxhash64("id"), F.col("_n"))
    return points.groupBy(b.alias(f"b{name}"), *([by] if by else [])).agg(F.collect_list("id").alias(f"ids{name}"), F.collect_list("features").alias(f"x{name}"))


def pairs(points: DataFrame, others: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str = "d", block: int = BLOCK) -> DataFrame:
    """(id, other, name) of every point and every other one of another id: the measure of x's rows and y's.

    Blocks hold vectors of one size. Null vectors, those that hold a null, and
    pairs of different sizes measure null; pairs with a null id are left out.
    """

    def dealt(df: DataFrame, end: str) -> DataFrame:
        whole = F.when(F.forall("features", lambda v: v.isNotNull()), F.col("features").cast("array<double>"))
        df = df.select(F.col("id").cast("long").alias("id"), whole.alias("x")).where("id is not null")
        n = max(1, -(-df.count() // block))
        size = F.when(F.col("x").isNull(), -1).otherwise(F.size("x")).alias(f"size{end}")
        df = df.select("id", size, F.coalesce("x", F.array().cast("array<double>")).alias("x"), F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"b{end}"))
        # a number of partitions that is asked for stays: few rows, each of a block
        return df.repartition(n, f"b{end}").groupBy(f"b{end}", f"size{end}").agg(F.collect_list(F.struct("id", "x")).alias(f"p{end}"))

    def read(col: pa.Array, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        rows = col[k].values
        return rows.field("id").to_numpy(), rows.field("x").flatten().to_numpy().reshape(len(rows), max(size, 0))

    def tile(batches):
        for batch in batches:
            for k, (n, m) in enumerate(zip(batch.column("sizeq").to_pylist(), batch.column("sizep").to_pylist(), strict=True)):
                (iq, x), (ip, y) = (read(batch.column(c), k, s) for c, s in (("pq", n), ("pp", m)))
                step = max(1, (1 << 16) // len(ip))
                for at in range(0, len(iq), step):
                    i = iq[at : at + step]
                    other = i[:, None] != ip[None, :]
                    d = measure(x[at : at + step], y)[other] if n == m >= 0 else None
                    a, b = np.repeat(i, other.sum(1)), np.broadcast_to(ip, other.shape)[other]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.float64()) if d is None else pa.array(d)], ["id", "other", name])

    tiles = dealt(points, "q").crossJoin(dealt(others, "p"))  # pairs of blocks, not of rows
    return tiles.select("sizeq", "pq", "sizep", "pp").mapInArrow(tile, f"id long, other long, {name} double")


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """(id, other, d, rank 1..k): the k nearest points of every query, ties by id.

    by: a string column; only points of a query's own group are its neighbours,
    and the group is returned too.
    """
    a, b = _blocks(queries, "q", block, by), _blocks(points, "p", block, by)
    tiles = a.join(b, by) if by else a.crossJoin(b)  # pairs of blocks, not of rows
    key = [by] if by else []

    def tile(batches):
        best: dict[tuple, tuple] = {}  # a block of queries: its ids, how far its rows still look, and what they have so far

        def found():
            for own, (iq, _, i, o, v) in best.items():
                out = pd.DataFrame({"id": iq[i], "other": o, "d": v})
                if by:
                    out[by] = own[1]
                yield out

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                iq, ip = np.asarray(r.idsq), np.asarray(r.idsp)
                d = distances(np.stack(r.xq).astype(float), np.stack(r.xp).astype(float), metric)
                if exclude_self:
                    d[iq[:, None] == ip[None, :]] = np.inf
                own = (r.bq, getattr(r, by) if by else None)
                if own in best and not np.array_equal(best[own][0], iq):  # the block again, in another order
                    yield from found()
                    best = {}
                if own not in best:
                    m = min(k, d.shape[1])
                    best[own] = (iq, np.partition(d, m - 1, axis=1)[:, m - 1], np.zeros(0, int), np.zeros(0, ip.dtype), np.zeros(0))
                _, limit, i, o, v = best[own]
                row, col = np.nonzero(~(d > limit[:, None]))
                i, o, v = np.concatenate([i, row]), np.concatenate([o, ip[col]]), np.concatenate([v, d[row, col]])
                order = np.lexsort((o, v, i))
                i, o, v = i[order], o[order], v[order]
                n = np.bincount(i, minlength=len(iq))
                rank = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                keep = (rank < k) & np.isfinite(v)
                i, o, v = i[keep], o[keep], v[keep]
                n = np.bincount(i, minlength=len(iq))
                limit = np.full(len(iq), np.inf)
                limit[n == k] = v[np.cumsum(n)[n == k] - 1]
                best[own] = (iq, limit, i, o, v)
                if len(best) > 64:  # the last one goes on
                    last = best.pop(own)
                    yield from found()
                    best = {own: last}
        yield from found()

    # a partition for every tile or so: tiles are few and heavy
    best = tiles.mapInPandas(tile, "id long, other long, d double" + (f", {by} string" if by else ""))
    rank = F.row_number().over(Window.partitionBy("id", *key).orderBy("d", "other"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def knno(points: DataFrame, k: int = 10, share: float = 0.1, metric: str = "euclidean", queries: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(id, score, pred): scaled distance to the k-th nearest neighbour.

    A point is not its own neighbour; k is at least 2. queries: score these
    against points instead. by: each group of this column on its own.
    """
    key = [by] if by else []
    near = knn(points, points if queries is None else queries, max(2, k), metric, exclude_self=queries is None, by=by)
    kth = near.where(F.col("rank") == max(2, k)).select(*key, "id", F.col("d").alias("score"))
    return contamination(minmax(kth, ["score"], key), share, key)


def lof(points: DataFrame, k: int = 10, share: float = 0.1, metric: str = "euclidean", by: str | None = None) -> DataFrame:
    """(id, lof, score, pred): local outlier factor; a point counts among its own neighbours."""
    key = [by] if by else []
    near = knn(points, points, k, metric, exclude_self=False, by=by)
    kdist = near.where(F.col("rank") == k).select(*key, F.col("id").alias("other"), F.col("d").alias("kd"))
    reach = near.join(kdist, [*key, "other"]).groupBy(*key, "id").agg(F.avg(F.greatest("d", "kd")).alias("reach"))
    density = reach.select(*key, "id", (1 / (F.col("reach") + 1e-10)).alias("lrd"))
    other = density.select(*key, F.col("id").alias("other"), F.col("lrd").alias("olrd"))
    out = near.join(other, [*key, "other"]).join(density, [*key, "id"]).groupBy(*key, "id").agg(F.avg(F.col("olrd") / F.col("lrd")).alias("lof"))
    return contamination(minmax(out.withColumn("score", F.col("lof")), ["score"], key), share, key)


def hyperspheres(points: DataFrame, members: int, n: int, seed: str = "iNNe", metric: str = "euclidean") -> DataFrame:
    """(member, id, features, radius, ratio): sampled centres, nearest-centre radii, 1 - r(nn) / r.

    Samples are the n points of least md5(seed, member, id), for each member.
    """
    member = F.explode(F.sequence(F.lit(0), F.lit(members - 1)))
    drawn = points.select("id", "features", member.alias("member")).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "member", "id").cast("binary")))
    drawn = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("member").orderBy("_h", "id"))).where(F.col("_r") <= n)
    from ..functions.expressions import distance

    a, b = drawn.select("member", "id", "features"), drawn.select("member", F.col("id").alias("nn"), F.col("features").alias("nf"))
    pairs = a.join(b, "member").where("id <> nn").withColumn("d", distance(F.col("features"), F.col("nf"), metric))
    near = pairs.groupBy("member", "id").agg(F.min("d").alias("radius"), F.min_by("nn", F.struct("d", "nn")).alias("nn"))
    other = near.select("member", F.col("id").alias("nn"), F.col("radius").alias("nr"))
    out = near.join(other, ["member", "nn"]).join(a, ["member", "id"])
    return out.select("member", "id", "features", "radius", (1 - F.when(F.col("radius") > 0, F.col("nr") / F.col("radius")).otherwise(1.0)).alias("ratio"))


def inne(points: DataFrame, members: int = 100, n: int = 16, share: float = 0.1, metric: str = "euclidean", seed: str = "iNNe") -> DataFrame:
    """(id, score, pred): mean isolation score; 1 outside the nearest sphere, its ratio inside."""
    spheres = hyperspheres(points, members, n, seed, metric)  # members * n rows
    packed = spheres.groupBy("member").agg(F.collect_list("id").alias("ids"), F.collect_list("features").alias("x"), F.collect_list("radius").alias("r"), F.collect_list("ratio").alias("s"))
    tiles = _blocks(points, "q", BLOCK).crossJoin(F.broadcast(packed))

    def tile(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, radius, ratio = np.asarray(r.ids), np.asarray(r.r), np.asarray(r.s)
                order = np.argsort(ids)
                d = distances(np.stack(r.xq).astype(float), np.stack(r.x).astype(float)[order], metric)
                best = d.argmin(1)
                inside = d[np.arange(len(d)), best] <= radius[order][best] * (1 + 1e-12)
                yield pd.DataFrame({"id": np.asarray(r.idsq), "score": np.where(inside, ratio[order][best], 1.0)})

    out = tiles.mapInPandas(tile, "id long, score double").groupBy("id").agg(F.avg("score").alias("score"))
    return contamination(out, share, [])
