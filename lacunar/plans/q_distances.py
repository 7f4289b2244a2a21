"""Queries: distances, kernels, joins, matrix profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import numeric
from ..operators import neighbors, profile, series
from .base import POINTS, RANGES, SERIES, frame, hourly, points
from .catalog import query
from .q_series import _PATTERNS, contamination_sql, labels_sql, z_sql


def dtw_sql(a: str, b: str) -> str:
    """Row by row: the next row of costs from the last one, both as folds over lists."""
    cell = "list_append(acc, (r[1] - e[1]) * (r[1] - e[1]) + least(acc[len(acc)], p[e[2]::INT], p[e[2]::INT + 1]))"
    row = f"list_reduce(list_prepend(['inf'::DOUBLE], list_transform({b}, lambda v, j: [v, j::DOUBLE])), lambda acc, e: {cell})"
    return f"sqrt(list_reduce(list_prepend(list_prepend(0.0::DOUBLE, list_transform({b}, lambda v: 'inf'::DOUBLE)), list_transform({a}, lambda x: [x])), lambda p, r: {row})[len({b}) + 1])"


_Z = f"{_PATTERNS}, zs AS (SELECT series_id, range_id, {z_sql('pattern')} AS z FROM patterns)"


def _z(spark, d):
    df = hourly(spark, d)
    return series.extract_patterns(df, series.pattern_ranges(df)).withColumn("z", series.znorm(F.col("pattern")))


def _pairs(z):
    a = z.select("series_id", F.col("range_id").alias("i"), F.col("z").alias("a"))
    return a.join(z.select("series_id", F.col("range_id").alias("j"), F.col("z").alias("b")), "series_id").where("i < j")


@query("dis_1_dtw_to_first", "series_id s, range_id i, d d", f"{_Z} SELECT a.series_id, a.range_id, {dtw_sql('a.z', 'b.z')} AS d FROM zs a JOIN zs b ON b.series_id = a.series_id AND b.range_id = 0")
def _(spark, d):
    z = _z(spark, d)
    first = z.where("range_id = 0").select("series_id", F.col("z").alias("b"))
    return z.join(first, "series_id").withColumn("d", X.dtw(F.col("z"), F.col("b")))


_DTW = f"{_Z}, half AS (SELECT a.series_id, a.range_id AS i, b.range_id AS j, {dtw_sql('a.z', 'b.z')} AS d FROM zs a JOIN zs b ON b.series_id = a.series_id AND a.range_id < b.range_id), matrix AS (SELECT * FROM half UNION ALL SELECT series_id, j, i, d FROM half)"


@query("dis_2_dtw_matrix", "series_id s, i i, j i, d d", f"{_DTW} SELECT * FROM matrix")
@query("dis_9_affinity", "series_id s, i i, j i, w d", f"{_DTW} SELECT series_id, i, j, exp(-0.5 * d) AS w FROM matrix")
def _(spark, d):
    half = _pairs(_z(spark, d)).select("series_id", "i", "j", X.dtw(F.col("a"), F.col("b")).alias("d"))
    both = half.unionByName(half.select("series_id", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.withColumn("w", X.affinity(F.col("d")))


@query("agg_4_fingerprint_threshold", "series_id s, lim d", f"{_DTW} SELECT series_id, max(d) AS lim FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d, i, j) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM matrix) WHERE r <= floor(n * 0.9) GROUP BY 1")
def _(spark, d):
    from .detectors import fingerprint_threshold

    return fingerprint_threshold(_z(spark, d)).withColumnRenamed("limit", "lim")


@query("agg_12_medoid", "series_id s, range_id i", f"{_DTW} SELECT series_id, arg_min(i, (s, i)) AS range_id FROM (SELECT series_id, i, round(sum(d), 9) AS s FROM matrix GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    half = _pairs(_z(spark, d)).select("series_id", "i", "j", X.dtw(F.col("a"), F.col("b")).alias("d"))
    both = half.unionByName(half.select("series_id", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    sums = both.groupBy("series_id", "i").agg(F.round(F.sum("d"), 9).alias("s"))
    return sums.groupBy("series_id").agg(F.min_by("i", F.struct("s", "i")).alias("range_id"))


# distances of all points to the labelled ones

_LABELLED = f"{POINTS}, near AS (SELECT a.id, b.id AS other, a.features AS x, b.features AS y FROM pts a JOIN pts b ON b.label = 1 AND a.id <> b.id)"


def _near(spark, d, measure, name="d"):
    p = points(spark, d)
    return neighbors.pairs(p, p.where("label = 1"), measure, name)


def _list(expr: str) -> str:
    return f"list_{{}}(list_transform(list_zip(x, y), lambda p: {expr}))"


_DIST = {
    "dis_3_euclidean": ("euclidean", "list_distance(x, y)"),
    "dis_5_angular": ("cosine", "CASE WHEN list_cosine_similarity(x, y) > 1 - 1e-8 THEN 0 ELSE acos(greatest(-1, list_cosine_similarity(x, y))) / pi() END"),
    "dis_6_manhattan": ("manhattan", _list("abs(p[1] - p[2])").format("sum")),
    "dis_6_chebyshev": ("chebyshev", _list("abs(p[1] - p[2])").format("max")),
    "dis_6_minkowski": ("minkowski", f"pow({_list('pow(abs(p[1] - p[2]), 3)').format('sum')}, 1 / 3.0::DOUBLE)"),
}
for _name, (_metric, _sql) in _DIST.items():

    @query(_name, "id i, other i, d d", f"{_LABELLED} SELECT id, other, {_sql} AS d FROM near")
    def _(spark, d, metric=_metric):
        return _near(spark, d, lambda x, y: neighbors.distances(x, y, metric))


@query("dis_4_feature_norm", "id i, norm d", f"{POINTS} SELECT id, sqrt(list_dot_product(features, features)) AS norm FROM pts")
def _(spark, d):
    return points(spark, d).withColumn("norm", F.sqrt(X.dot(F.col("features"), F.col("features"))))


@query("dis_7_linear_kernel", "id i, other i, k d", f"{_LABELLED} SELECT id, other, list_dot_product(x, y) AS k FROM near")
def _(spark, d):
    return _near(spark, d, lambda x, y: numeric.kernel(x, y, "linear"), "k")


@query("dis_8_rbf_kernel", "id i, other i, k d", f"{_LABELLED} SELECT id, other, exp(-pow(list_distance(x, y), 2) / 2.0) AS k FROM near")
def _(spark, d):
    return _near(spark, d, lambda x, y: np.exp(-(neighbors.distances(x, y) ** 2) / 2.0), "k")


# joins


@query("joi_1_positional_alignment", "series_id s, idx i, value d, y i", f"{SERIES} SELECT v.series_id, v.idx, v.value, a.y FROM series v JOIN series a USING (series_id, idx)")
def _(spark, d):
    df = hourly(spark, d)
    return df.select("series_id", "idx", "value").join(df.select("series_id", "idx", "y"), ["series_id", "idx"])


@query("joi_2_segments_templates", "series_id s, idx i, d d", f"""{_Z}, segs AS (SELECT series_id, idx, list(value) {frame(3)} AS seg FROM series QUALIFY count(*) {frame(3)} = 3),
  zsegs AS (SELECT series_id, idx, CASE WHEN list_stddev_pop(seg) > 1e-12 THEN {z_sql('seg')} ELSE list_transform(seg, lambda v: 0.0::DOUBLE) END AS zg FROM segs)
  SELECT g.series_id, g.idx, min({dtw_sql('g.zg', 't.z')}) AS d FROM zsegs g JOIN zs t ON t.series_id = g.series_id GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    df = hourly(spark, d)
    seg = series.segments(df, 3).withColumn("zg", series.znorm(F.col("seg"), flat_zero=True))
    t = _z(spark, d).select("series_id", "z")
    return seg.join(t, "series_id").groupBy("series_id", "idx").agg(F.min(X.dtw(F.col("zg"), F.col("z"))).alias("d"))


@query("joi_3_segments_ranges", "series_id s, idx i, label i", f"{RANGES}, {labels_sql(2)} SELECT * FROM labels")
def _(spark, d):
    df = hourly(spark, d)
    return series.label_segments(df, series.pattern_ranges(df), 2)


_KNN = f"{POINTS}, pairs AS (SELECT a.id, b.id AS other, list_distance(a.features, b.features) AS d FROM pts a JOIN pts b ON a.id <> b.id), knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM pairs QUALIFY rank <= 10)"


@query("joi_4_knn_join", "id i, other i, d d, rank i", f"{_KNN} SELECT * FROM knn")
def _(spark, d):
    p = points(spark, d)
    return neighbors.knn(p, p, 10)


@query("top_1_kth_distance", "id i, other i, d d, rank i", f"{_KNN} SELECT * FROM knn WHERE rank = 10")
def _(spark, d):
    p = points(spark, d)
    return neighbors.knn(p, p, 10).where("rank = 10")


@query("joi_6_cannot_link_pairs", "bad i, good i", f"{POINTS} SELECT a.id AS bad, b.id AS good FROM pts a CROSS JOIN pts b WHERE a.label = 1 AND b.label = -1")
def _(spark, d):
    p = points(spark, d).select("id", "label")
    return p.where("label = 1").select(F.col("id").alias("bad")).crossJoin(p.where("label = -1").select(F.col("id").alias("good")))  # the pairs are the result


@query("joi_8_donor_lookup", "series_id s, idx i, noise d", f"{SERIES} SELECT s.series_id, s.idx, t.value AS noise FROM series s JOIN series t ON t.series_id = s.series_id AND t.idx = 100 + s.idx % 48")
def _(spark, d):
    df = hourly(spark, d)
    donor = df.where("idx between 100 and 147").select("series_id", (F.col("idx") - 100).alias("slot"), F.col("value").alias("noise"))
    return df.withColumn("slot", F.col("idx") % 48).join(donor, ["series_id", "slot"])


# matrix profiles: brute force over all pairs of windows in SQL


def _windows(m: int, source: str = "series") -> str:
    return f"""wins AS (SELECT series_id, idx, list(value) {frame(m)} AS v FROM {source} QUALIFY count(*) {frame(m)} = {m}),
  stats AS (SELECT series_id, idx, v, list_avg(v) AS mu, CASE WHEN list_stddev_samp(v) < 1e-8 THEN 0 ELSE list_stddev_samp(v) END AS sd FROM wins)"""


def _dist(m: int) -> str:
    return f"""CASE WHEN a.sd = 0 AND b.sd = 0 THEN 0 WHEN a.sd = 0 OR b.sd = 0 THEN sqrt({m - 1}.0::DOUBLE)
    ELSE sqrt(greatest(0, 2 * ({m} - (list_dot_product(a.v, b.v) - {m} * a.mu * b.mu) / (a.sd * b.sd)))) END"""


def mp_sql(m: int, where: str = "true", source: str = "series") -> str:
    zone = f"NOT (b.idx >= round_even(a.idx - {m} / 2.0, 0) AND b.idx < round_even(a.idx + {m} / 2.0 + 1, 0))"
    return f"{_windows(m, source)}, mp AS (SELECT a.series_id, a.idx, min({_dist(m)}) AS mp FROM stats a JOIN stats b ON a.series_id = b.series_id AND {zone} AND {where} GROUP BY 1, 2)"


@query("mpj_1_matrix_profile", "series_id s, idx i, mp d", f"{SERIES}, {mp_sql(24)} SELECT * FROM mp")
def _(spark, d):
    return profile.matrix_profile(hourly(spark, d), 24)


@query("mpj_2_matrix_profile_odd", "series_id s, idx i, mp d", f"{SERIES}, {mp_sql(13)} SELECT * FROM mp")
def _(spark, d):
    return profile.matrix_profile(hourly(spark, d), 13)


@query("mpj_3_distance_profile", "series_id s, idx i, d d", f"{SERIES}, {_windows(24)} SELECT a.series_id, a.idx, {_dist(24)} AS d FROM stats a JOIN stats b ON a.series_id = b.series_id AND b.idx = 100")
def _(spark, d):
    df = hourly(spark, d)
    q = df.select("series_id").distinct().withColumn("start", F.lit(100))
    return profile.distance_profile(df, q, 24)


@query("mpj_4_ab_join", "series_id s, idx i, mp d", f"{SERIES}, {mp_sql(24, '((a.idx <= 360 AND b.idx > 360) OR (a.idx > 360 AND b.idx <= 360))')} SELECT * FROM mp")
def _(spark, d):
    return profile.matrix_profile(hourly(spark, d), 24, split=360)


@query("dis_10_znorm_distance", "series_id s, idx i, other i, d d", f"{SERIES}, {_windows(12)} SELECT a.series_id, a.idx, b.idx AS other, {_dist(12)} AS d FROM stats a JOIN stats b ON a.series_id = b.series_id AND b.idx > a.idx AND (b.idx < round_even(a.idx - 6.0, 0) OR b.idx >= round_even(a.idx + 7.0, 0) OR a.idx < round_even(b.idx - 6.0, 0) OR a.idx >= round_even(b.idx + 7.0, 0))")
def _(spark, d):
    return profile.pairs(hourly(spark, d), 12)


_DISCORD = f"{SERIES}, {mp_sql(24)}, scaled AS (SELECT series_id, idx, CASE WHEN max(mp) OVER p > min(mp) OVER p THEN (mp - min(mp) OVER p) / (max(mp) OVER p - min(mp) OVER p) ELSE 0 END AS mp FROM mp WINDOW p AS (PARTITION BY series_id)), filled AS (SELECT s.series_id, s.idx, round(coalesce(m.mp, 0), 9) AS score FROM series s LEFT JOIN scaled m USING (series_id, idx)) {contamination_sql('filled', 0.1, 'score', 'series_id')}"


@query("est_11_matrix_profile_discords", "series_id s, idx i, score d, pred i", _DISCORD)
def _(spark, d):
    return profile.discords(hourly(spark, d), 24)

