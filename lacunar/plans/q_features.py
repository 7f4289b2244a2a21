"""Queries: segment features and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import scores, series

from .base import POINTS, RANGES, SERIES, frame, hourly, points
from .catalog import query
from .detectors import STATS, features, scale_features, shape_templates, stat_features

W = 24
FULL = f"QUALIFY count(*) {frame(W)} = {W}"
_FLAT = f"var_pop(value) {frame(W)} < 1e-20"
_STAT = {
    "avg": f"avg(value) {frame(W)}",
    "std": f"stddev_pop(value) {frame(W)}",
    "vari": f"var_pop(value) {frame(W)}",
    "maxi": f"max(value) {frame(W)}",
    "mini": f"min(value) {frame(W)}",
    "med": f"median(value) {frame(W)}",
    "tsum": f"sum(value) {frame(W)}",
    "skew": f"CASE WHEN {_FLAT} THEN 0 ELSE skewness(value) {frame(W)} END",
    "kurt": f"CASE WHEN {_FLAT} THEN 0 ELSE kurtosis(value) {frame(W)} END",
}
STAT_SQL = f"{SERIES}, stats AS (SELECT series_id, idx, ts, {', '.join(f'{v} AS {k}' for k, v in _STAT.items())} FROM series {FULL})"

for _k, _name in enumerate(STATS, 1):

    @query(f"fea_{_k}_{_name}", f"series_id s, idx i, {_name} d", f"{SERIES} SELECT series_id, idx, {_STAT[_name]} AS {_name} FROM series {FULL}")
    def _(spark, d):
        return stat_features(hourly(spark, d), W)


@query("fea_10_11_time", "series_id s, idx i, time_x d, time_y d", f"{SERIES} SELECT series_id, idx, sin(2 * pi() * hour(ts) / 24) AS time_x, cos(2 * pi() * hour(ts) / 24) AS time_y FROM series {FULL}")
def _(spark, d):
    x, y = X.hour_code(F.col("ts"))
    return series.segments(hourly(spark, d), W).withColumn("time_x", x).withColumn("time_y", y)


@query("fea_all_stat_features", f"series_id s, idx i, {', '.join(f'{k} d' for k in STATS)}", f"{STAT_SQL} SELECT * FROM stats")
def _(spark, d):
    return stat_features(hourly(spark, d), W)


@query("fea_12_shape_features", "series_id s, idx i, features a")
def _(spark, d):
    df = hourly(spark, d)
    return features(df, 8, "shape", shape_templates(df, series.pattern_ranges(df), 5))


@query("fea_x_sliding_nearest", "series_id s, range_id i, idx i, d d", f"""{RANGES}, shape AS (SELECT r.series_id, r.range_id, list(s.value ORDER BY s.idx) AS q FROM ranges r JOIN series s ON s.series_id = r.series_id AND s.idx BETWEEN r.b AND r.e GROUP BY r.series_id, r.range_id),
  segs AS (SELECT series_id, idx, list(value) {frame(8)} AS seg FROM series QUALIFY count(*) {frame(8)} = 8)
  SELECT g.series_id, s.range_id, g.idx, list_min(list_transform(range(1, len(g.seg) - len(s.q) + 2), lambda i: list_distance(g.seg[i : i + len(s.q) - 1], s.q))) AS d FROM segs g JOIN shape s ON s.series_id = g.series_id""")  # fmt: skip
def _(spark, d):
    df = hourly(spark, d)
    shape = series.extract_patterns(df, series.pattern_ranges(df)).select("series_id", "range_id", F.col("pattern").alias("q"))
    return series.segments(df, 8).join(shape, "series_id").withColumn("d", X.sliding_nearest(F.col("seg"), F.col("q")))


_SCALE = ["avg", "std"]
_SIG = "series_id s, idx i, avg d, std d"


def _stats(spark, d):
    return stat_features(hourly(spark, d), W)


def _scaled(expr: str) -> str:
    return f"{STAT_SQL} SELECT series_id, idx, {', '.join(f'{expr.format(c=c)} AS {c}' for c in _SCALE)} FROM stats"


@query("scl_1_standard", _SIG, _scaled("CASE WHEN stddev_pop({c}) OVER (PARTITION BY series_id) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY series_id)) / stddev_pop({c}) OVER (PARTITION BY series_id) ELSE 0 END"))
def _(spark, d):
    return scores.standard(_stats(spark, d), _SCALE, ["series_id"])


@query("scl_2_minmax", _SIG, _scaled("CASE WHEN max({c}) OVER (PARTITION BY series_id) > min({c}) OVER (PARTITION BY series_id) THEN ({c} - min({c}) OVER (PARTITION BY series_id)) / (max({c}) OVER (PARTITION BY series_id) - min({c}) OVER (PARTITION BY series_id)) ELSE 0 END"))
def _(spark, d):
    return scores.minmax(_stats(spark, d), _SCALE, ["series_id"])


@query("scl_3_robust", _SIG, _scaled("({c} - quantile_cont({c}, 0.5) OVER (PARTITION BY series_id)) / (quantile_cont({c}, 0.75) OVER (PARTITION BY series_id) - quantile_cont({c}, 0.25) OVER (PARTITION BY series_id))"))
def _(spark, d):
    return scores.robust(_stats(spark, d), _SCALE, ["series_id"])


@query("scl_4_score_minmax", "id i, score d", f"{POINTS}, s AS (SELECT id, features[1] AS score FROM pts) SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM s")
def _(spark, d):
    return scores.minmax(points(spark, d).select("id", F.col("features")[0].alias("score")), ["score"], [])


@query("scl_6_scaled_features", "series_id s, idx i, features a", f"""{STAT_SQL}, timed AS (SELECT *, sin(2 * pi() * hour(ts) / 24) AS time_x, cos(2 * pi() * hour(ts) / 24) AS time_y FROM stats)
  SELECT series_id, idx, [{', '.join(f"coalesce(({c} - avg({c}) OVER p) / nullif(stddev_pop({c}) OVER p, 0), 0)" for c in (*STATS, "time_x", "time_y"))}] AS features FROM timed WINDOW p AS (PARTITION BY series_id)""")  # fmt: skip
def _(spark, d):
    return scale_features(features(hourly(spark, d), W, "stat_time"))


