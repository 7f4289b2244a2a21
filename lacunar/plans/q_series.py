"""Queries: sources, projections, filters, series restructuring, windows, sets, samples."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import ensemble, scores, series
from . import base, generate
from .base import BY, LOCATED, POINTS, RANGES, SERIES, frame, hourly, located, points, table
from .catalog import FLAGSHIP, query
from .detectors import average_suspicion, descriptors, find_locations, find_locations_old, mean_interarrival, suspicion

S = "series_id s, idx i"

# --- validation and projections


@query("val_1_check_time_series", f"{S}, ts t, value d, y i", f"{SERIES} SELECT series_id, idx, ts, value, y FROM series")
def _(spark, d):
    from ..schema import check_time_series

    return check_time_series(hourly(spark, d))


@query("val_2_check_points", "id i, n i, label i", f"{POINTS} SELECT id, len(features) AS n, label FROM pts")
def _(spark, d):
    from ..schema import check_points

    return check_points(points(spark, d)).select("id", F.size("features").alias("n"), "label")


@query("prj_1_active_energy", "l_orderkey i, l_linenumber i, v d", "SELECT l_orderkey, l_linenumber, (l_extendedprice * (1000.0::DOUBLE / 60.0::DOUBLE) - l_quantity) * (60.0::DOUBLE / 1000.0::DOUBLE) AS v FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", generate.active_energy(F.col("l_extendedprice"), F.col("l_quantity")).alias("v"))


@query("prj_2_hour", "event_id i, hour i", "SELECT event_id, hour(ts) AS hour FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.hour("ts").alias("hour"))


@query("prj_3_cyclical_hour", "event_id i, time_x d, time_y d", "SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS time_x, cos(2 * pi() * hour(ts) / 24) AS time_y FROM events")
def _(spark, d):
    x, y = X.hour_code(F.col("ts"))
    return table(spark, d, "events").select("event_id", x.alias("time_x"), y.alias("time_y"))


@query("prj_4_label_recode", "id i, label i", f"{POINTS} SELECT id, CASE WHEN label = 1 THEN -1 ELSE 0 END AS label FROM pts")
def _(spark, d):
    return points(spark, d).select("id", F.when(F.col("label") == 1, -1).otherwise(0).alias("label"))


@query("prj_5_label_negate", "id i, label i", f"{POINTS} SELECT id, -label AS label FROM pts")
def _(spark, d):
    return points(spark, d).select("id", (-F.col("label")).alias("label"))


@query("prj_6_converted_labels", "id i, cy i, cl i, cap d", f"{POINTS} SELECT id, CASE WHEN label >= 0 THEN 1 ELSE -1 END AS cy, abs(label) AS cl, CASE label WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 2.0 END AS cap FROM pts")
def _(spark, d):
    y = F.col("label")
    return points(spark, d).select("id", F.when(y >= 0, 1).otherwise(-1).alias("cy"), F.abs(y).alias("cl"), F.when(y == 1, 1.0).when(y == 0, 0.5).otherwise(2.0).alias("cap"))


@query("prj_7_assemble_features", f"{S}, features a", f"""{SERIES} SELECT series_id, idx, [avg(value) {frame(24)}, stddev_pop(value) {frame(24)}, sin(2 * pi() * hour(ts) / 24), cos(2 * pi() * hour(ts) / 24)] AS features
  FROM series QUALIFY count(*) {frame(24)} = 24""")  # fmt: skip
def _(spark, d):
    o = series.ahead(24)
    x, y = X.hour_code(F.col("ts"))
    f = hourly(spark, d).withColumn("features", F.array(F.avg("value").over(o), F.stddev_pop("value").over(o), x, y)).withColumn("n", F.count(F.lit(1)).over(o))
    return f.where("n = 24")


# --- filters and nulls


@query("flt_1_timestamp_range", "event_id i, value d", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def _(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))


@query("flt_2_offset_limit", f"{S}, value d", f"{SERIES} SELECT series_id, idx - 15 AS idx, value FROM series WHERE idx >= 15 AND idx < 15 + 400")
def _(spark, d):
    return generate.thin(hourly(spark, d), 15, 1, 400)


@query("flt_3_every_kth", f"{S}, value d", f"{SERIES} SELECT series_id, idx // 5 AS idx, value FROM series WHERE idx % 5 = 0")
def _(spark, d):
    return generate.thin(hourly(spark, d), 0, 5, 1 << 40)


@query("flt_4_month_in_set", "o_orderkey i", "SELECT o_orderkey FROM orders WHERE month(o_orderdate) BETWEEN 3 AND 4")
def _(spark, d):
    return table(spark, d, "orders").where(F.month("o_orderdate").between(3, 4))


@query("flt_5_class_filter", "vec_id i, label i", "SELECT vec_id, label FROM embeddings WHERE label IN (2, 5)")
def _(spark, d):
    return table(spark, d, "embeddings").where(F.col("label").isin(2, 5))


@query("flt_6_threshold", f"{S}, flag i", f"{SERIES} SELECT series_id, idx, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS flag FROM series")
def _(spark, d):
    return hourly(spark, d).withColumn("flag", scores.binarise(F.col("value"), 20.0))


@query("flt_7_labelled", "id i, label i", f"{POINTS} SELECT id, label FROM pts WHERE label <> 0")
def _(spark, d):
    return points(spark, d).where("label <> 0")


_HOLES = "CASE WHEN idx % 17 = 3 AND idx >= 48 THEN NULL ELSE value END"


@query("nul_1_donor_fill", f"{S}, value d", f"{SERIES}, holed AS (SELECT series_id, idx, {_HOLES} AS value FROM series) SELECT h.series_id, h.idx, coalesce(h.value, d.value) AS value FROM holed h LEFT JOIN holed d ON d.series_id = h.series_id AND d.idx = h.idx % 48")
def _(spark, d):
    holed = hourly(spark, d).withColumn("value", F.when((F.col("idx") % 17 == 3) & (F.col("idx") >= 48), None).otherwise(F.col("value")))
    return generate.fill_from_donor(holed, 0, 48)


@query("nul_2_finite", f"{S}, v d", f"{SERIES} SELECT series_id, idx, CASE WHEN idx % 3 = 0 THEN 0 ELSE value END AS v FROM series")
def _(spark, d):
    return hourly(spark, d).withColumn("v", X.finite(F.when(F.col("idx") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))))


# --- runs, segments, labels


@query("ser_1_pattern_ranges", "series_id s, range_id i, b i, e i", f"{RANGES} SELECT * FROM ranges")
def _(spark, d):
    return series.pattern_ranges(hourly(spark, d))


@query("ser_2_window_size", "series_id s, w i", f"{RANGES} SELECT series_id, round_even(avg(e - b + 1), 0) AS w FROM ranges GROUP BY series_id")
def _(spark, d):
    return series.window_size(series.pattern_ranges(hourly(spark, d)))


@query("ser_3_segments", f"{S}, seg a", f"{SERIES} SELECT series_id, idx, list(value) {frame(24)} AS seg FROM series QUALIFY count(*) {frame(24)} = 24")
def _(spark, d):
    return series.segments(hourly(spark, d), 24)


@query("ser_3b_segments_sized", f"{S}, seg a", f"{SERIES} SELECT series_id, idx, list(value) {frame(3)} AS seg FROM series QUALIFY count(*) {frame(3)} = 3")
def _(spark, d):
    df = hourly(spark, d)
    return series.segments_sized(df, series.window_size(series.pattern_ranges(df)))


def labels_sql(w: int) -> str:
    return f"""hits AS (SELECT series_id, range_id, unnest(range(b - {w} + 1, e + 1)) AS idx, least(e + 1 - {w}, b) AS lo, greatest(e + 1 - {w}, b) AS hi FROM ranges),
  chosen AS (SELECT series_id, idx, arg_max(CASE WHEN idx BETWEEN lo AND hi THEN 1 ELSE -1 END, range_id * 2 + CASE WHEN idx BETWEEN lo AND hi THEN 0 ELSE 1 END) AS label FROM hits GROUP BY 1, 2),
  labels AS (SELECT s.series_id, s.idx, coalesce(c.label, 0) AS label FROM series s LEFT JOIN chosen c ON c.series_id = s.series_id AND c.idx = s.idx)"""


@query("ser_4_segment_labels", f"{S}, label i", f"{RANGES}, {labels_sql(5)} SELECT * FROM labels")
def _(spark, d):
    df = hourly(spark, d)
    return series.label_segments(df, series.pattern_ranges(df), 5)


_PATTERNS = f"{RANGES}, patterns AS (SELECT r.series_id, r.range_id, list(s.value ORDER BY s.idx) AS pattern FROM ranges r JOIN series s ON s.series_id = r.series_id AND s.idx BETWEEN r.b AND r.e GROUP BY 1, 2)"


@query("ser_5_patterns", "series_id s, range_id i, pattern a", f"{_PATTERNS} SELECT * FROM patterns")
def _(spark, d):
    df = hourly(spark, d)
    return series.extract_patterns(df, series.pattern_ranges(df))


def z_sql(x: str) -> str:
    return f"CASE WHEN list_stddev_pop({x}) > 1e-12 THEN list_transform({x}, lambda v: (v - list_avg({x})) / list_stddev_pop({x})) ELSE {x} END"


@query("ser_6_znorm_patterns", "series_id s, range_id i, z a", f"{_PATTERNS} SELECT series_id, range_id, {z_sql('pattern')} AS z FROM patterns")
def _(spark, d):
    df = hourly(spark, d)
    return series.extract_patterns(df, series.pattern_ranges(df)).withColumn("z", series.znorm(F.col("pattern")))


@query("ser_7_znorm_segments", f"{S}, z a", f"{SERIES}, segs AS (SELECT series_id, idx, list(value) {frame(12)} AS seg FROM series QUALIFY count(*) {frame(12)} = 12) SELECT series_id, idx, CASE WHEN list_stddev_pop(seg) > 1e-12 THEN {z_sql('seg')} ELSE list_transform(seg, lambda v: 0.0::DOUBLE) END AS z FROM segs")
def _(spark, d):
    return series.segments(hourly(spark, d), 12).withColumn("z", series.znorm(F.col("seg"), flat_zero=True))


@query("ser_8_rolling_sum", f"{S}, rolling d", f"{SERIES} SELECT series_id, idx, sum(value) {frame(8)} AS rolling FROM series QUALIFY count(*) {frame(8)} = 8")
def _(spark, d):
    return series.rolling_sum(hourly(spark, d), 8)


def support_sql(w: int, source: str = "series") -> str:
    lo, hi = (w - 1, 0) if w % 2 == 0 else (w - 2, 1)
    return f"""support AS (SELECT series_id, idx, y, CASE WHEN idx < {2 * (w // 2) - 1} OR ({w % 2} = 1 AND idx = max(idx) OVER (PARTITION BY series_id)) THEN 0.0::DOUBLE
    ELSE sum(y::DOUBLE) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) END AS support FROM {source})"""


@query("ser_8b_shifted_support", f"{S}, support d", f"{SERIES}, {support_sql(5)} SELECT * FROM support")
def _(spark, d):
    return series.shifted_support(hourly(spark, d), 5)


@query("ser_9_run_centres", "series_id s, range_id i, centre i", f"{RANGES} SELECT series_id, range_id, (b + e) // 2 AS centre FROM ranges")
def _(spark, d):
    return series.centres(series.pattern_ranges(hourly(spark, d)))


def apart_sql(found: str, w: int, name: str) -> str:
    """Greedy rule over the table found (series_id, idx) as a recursion along each series."""
    return f"""first_{name} AS (SELECT series_id, min(idx) AS idx FROM {found} GROUP BY series_id),
  {name} AS (SELECT series_id, idx FROM first_{name} UNION ALL
    SELECT k.series_id, (SELECT min(f.idx) FROM {found} f WHERE f.series_id = k.series_id AND f.idx >= k.idx + {w}) FROM {name} k
    WHERE EXISTS (SELECT 1 FROM {found} f WHERE f.series_id = k.series_id AND f.idx >= k.idx + {w}))"""


@query("ser_10_keep_apart", S, f"{SERIES.replace('WITH', 'WITH RECURSIVE', 1)}, found AS (SELECT series_id, idx FROM series WHERE value >= 25), {apart_sql('found', 6, 'kept')} SELECT * FROM kept")
def _(spark, d):
    return series.keep_apart(hourly(spark, d).where("value >= 25"), 6)


@query("ser_11_shift_on_spine", f"{S}, loc i", f"{RANGES} SELECT s.series_id, s.idx, CASE WHEN r.b IS NULL THEN 0 ELSE 1 END AS loc FROM series s LEFT JOIN ranges r ON r.series_id = s.series_id AND s.idx = (r.b + r.e) // 2 + 2")
def _(spark, d):
    df = hourly(spark, d)
    at = series.centres(series.pattern_ranges(df)).select("series_id", F.col("centre").alias("idx"))
    return series.on_spine(df, at, "loc", shift=2)


_ORDERS = "WITH daily AS (SELECT o_orderpriority AS series_id, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2), series AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS idx, day::TIMESTAMP AS ts, value FROM daily)"


def daily_orders(spark, d):
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz")
    sums = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), day.alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return series.index(sums)


@query("ser_12_month_counter", f"{S}, month i", f"{_ORDERS} SELECT series_id, idx, sum(step) OVER ({BY}) AS month FROM (SELECT *, CASE WHEN lag(month(ts)) OVER ({BY}) <> month(ts) THEN 1 ELSE 0 END AS step FROM series)")
def _(spark, d):
    return series.month_counter(daily_orders(spark, d))


_RESET = f"reset AS (SELECT series_id, idx, y, sum(y) OVER (PARTITION BY series_id, island ORDER BY idx) AS support FROM (SELECT *, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) OVER ({BY}) AS island FROM series))"


@query("ser_13_support_with_reset", f"{S}, support i", f"{SERIES}, {_RESET} SELECT * FROM reset")
def _(spark, d):
    return series.support_with_reset(hourly(spark, d))


_FEW = "(SELECT series_id, idx FROM series WHERE value >= 60)"


def repair_sql(found: str, name: str) -> str:
    return f"""{name} AS (SELECT series_id, idx FROM {found} UNION SELECT r.series_id, (r.b + r.e) // 2 FROM ranges r
    WHERE (SELECT count(*) FROM {found} f WHERE f.series_id = r.series_id) < (SELECT count(*) FROM ranges q WHERE q.series_id = r.series_id))"""


@query("ser_14_label_repair", S, f"{RANGES}, few AS {_FEW}, {repair_sql('few', 'repaired')} SELECT * FROM repaired")
def _(spark, d):
    df = hourly(spark, d)
    return series.repair(df.where("value >= 60").select("series_id", "idx"), series.centres(series.pattern_ranges(df)))


# --- aggregates and thresholds


@query("agg_1_run_length_stats", "series_id s, mean d, spread d", f"{RANGES} SELECT series_id, avg(e - b + 1) AS mean, stddev_pop(e - b + 1) AS spread FROM ranges GROUP BY 1")
def _(spark, d):
    n = F.col("e") - F.col("b") + 1
    return series.pattern_ranges(hourly(spark, d)).groupBy("series_id").agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("spread"))


_MEAN = f"gaps AS (SELECT series_id, idx, lead(idx) OVER ({BY}) - idx AS step FROM located WHERE loc = 1), mean_gap AS (SELECT series_id, avg(step) AS mean FROM gaps GROUP BY 1)"


@query("agg_2_mean_interarrival", "series_id s, mean d", f"{LOCATED}, {_MEAN} SELECT * FROM mean_gap")
def _(spark, d):
    return mean_interarrival(located(spark, d))


def threshold_sql(values: str, col: str = "support") -> str:
    return f"tops AS (SELECT r.series_id, r.range_id, max(v.{col}) AS top FROM ranges r JOIN {values} v ON v.series_id = r.series_id AND v.idx BETWEEN r.b AND r.e GROUP BY 1, 2), limits AS (SELECT series_id, min(top) AS threshold, stddev_pop(top) AS spread FROM tops WHERE top <> 0 GROUP BY 1)"


@query("agg_3_run_threshold", "series_id s, threshold d, spread d", f"{RANGES}, {threshold_sql('series', 'value')} SELECT * FROM limits")
def _(spark, d):
    df = hourly(spark, d)
    return scores.run_threshold(df, series.pattern_ranges(df), "value")


_USAGE = f"epochs AS (SELECT *, sum(loc) OVER ({BY}) AS epoch, sum(loc) OVER (PARTITION BY series_id) AS n FROM located), usages AS (SELECT series_id, epoch, sum(value) AS usage FROM epochs WHERE epoch > 0 AND epoch < n GROUP BY 1, 2)"


@query("agg_8_usage_between_events", "series_id s, epoch i, usage d", f"{LOCATED}, {_USAGE} SELECT * FROM usages")
def _(spark, d):
    return series.usage_between(located(spark, d))


@query("agg_13_negative_log_likelihood", "series_id s, nll d", f"{LOCATED}, {_USAGE} SELECT series_id, -sum(ln(2.0) + ln(1.5) - ln(300.0) + ln(1 - exp(-pow(usage / 300.0, 1.5))) - pow(usage / 300.0, 1.5) + 0.5 * ln(usage / 300.0)) AS nll FROM usages WHERE usage > 0 GROUP BY 1")
def _(spark, d):
    u = series.usage_between(located(spark, d)).where("usage > 0")
    return u.groupBy("series_id").agg((-F.sum(X.exponweib_logpdf(F.col("usage"), 2.0, 1.5, 0.0, 300.0))).alias("nll"))


@query("agg_14_unique_labels", "label i", "SELECT DISTINCT label FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("label").distinct()


@query("desc_1_descriptors", "series_id s, kind s, v d", f"{LOCATED}, {_MEAN}, {_USAGE} SELECT series_id, 'time' AS kind, step AS v FROM gaps WHERE step IS NOT NULL UNION ALL SELECT series_id, 'usage', usage FROM usages")
def _(spark, d):
    return descriptors(located(spark, d))


# --- windows

_LAST = f"""last AS (SELECT *, coalesce(max(CASE WHEN loc = 1 THEN idx END) OVER ({BY}), 0) AS last FROM located),
  since AS (SELECT *, idx - last AS gap, coalesce(sum(value) OVER (PARTITION BY series_id, last ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS usage FROM last)"""


@query("win_1_last_event", f"{S}, last i", f"{LOCATED}, {_LAST} SELECT * FROM since")
@query("win_2_time_since_event", f"{S}, gap i", f"{LOCATED}, {_LAST} SELECT * FROM since")
@query("win_3_usage_since_event", f"{S}, usage d", f"{LOCATED}, {_LAST} SELECT * FROM since")
def _(spark, d):
    return series.last_event(located(spark, d))


@query("win_4_interarrival", f"{S}, step i", f"{LOCATED}, {_MEAN} SELECT * FROM gaps")
def _(spark, d):
    return series.interarrival(located(spark, d).where("loc = 1").select("series_id", "idx"))


@query("win_5_rolling_mean_std", f"{S}, mu d, sd d", f"{SERIES} SELECT series_id, idx, avg(value) {frame(12)} AS mu, CASE WHEN stddev_samp(value) {frame(12)} < 1e-8 THEN 0 ELSE stddev_samp(value) {frame(12)} END AS sd FROM series QUALIFY count(*) {frame(12)} = 12")
def _(spark, d):
    from ..operators.profile import rolling_stats

    return rolling_stats(hourly(spark, d), 12)


@query("win_6_cumulative_sum", f"{S}, total d", f"{SERIES} SELECT series_id, idx, sum(value) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS total FROM series")
def _(spark, d):
    return hourly(spark, d).withColumn("total", F.sum("value").over(series.along().rowsBetween(Window.unboundedPreceding, 0)))


@query("win_7_first_of_run", f"{S}, pred i", f"{SERIES} SELECT series_id, idx, CASE WHEN y = 1 AND coalesce(lag(y) OVER ({BY}), 0) = 0 THEN 1 ELSE 0 END AS pred FROM series")
def _(spark, d):
    return series.first_of_run(hourly(spark, d), "y")


def contamination_sql(source: str, share: float, score: str = "score", keys: str = "") -> str:
    over = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT *, CASE WHEN {score} >= max(CASE WHEN rk = least(floor(n * (1 - {share}::DOUBLE)) + 1, n) THEN {score} END) OVER ({over}) THEN 1 ELSE -1 END AS pred
    FROM (SELECT *, row_number() OVER ({over} ORDER BY {score}) AS rk, count(*) OVER ({over}) AS n FROM {source})"""


@query("q_thr_contamination", f"{S}, pred i", f"{SERIES} {contamination_sql('series', 0.1, 'value', 'series_id')}")
def _(spark, d):
    return scores.contamination(hourly(spark, d), 0.1, ["series_id"], "value")


@query("srt_1_sort", "o_orderkey i, rank i", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def _(spark, d):
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")))


# --- sets and samples


@query("set_1_unlabelled_pool", S, f"{RANGES} SELECT series_id, idx FROM series EXCEPT SELECT series_id, (b + e) // 2 FROM ranges")
def _(spark, d):
    df = hourly(spark, d)
    at = series.centres(series.pattern_ranges(df)).select("series_id", F.col("centre").alias("idx"))
    return df.join(at, ["series_id", "idx"], "left_anti")


@query("set_2_remove_overlaps", "o_custkey i", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    return table(spark, d, "orders").select("o_custkey").distinct().join(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


@query("set_3_weeks_minus_holidays", "series_id s, week i", f"{SERIES} SELECT DISTINCT series_id, idx // 168 AS week FROM series WHERE idx // 168 NOT IN (1, 3)")
def _(spark, d):
    weeks = hourly(spark, d).select("series_id", F.floor(F.col("idx") / 168).alias("week")).distinct()
    return weeks.join(spark.createDataFrame([(1,), (3,)], "week long"), "week", "left_anti")


@query("set_4_union", f"{S}, part i", f"{SERIES} SELECT series_id, idx, 0 AS part FROM series WHERE idx < 400 UNION ALL SELECT series_id, idx, 1 FROM series WHERE idx >= 400")
def _(spark, d):
    from ..operators.profile import concatenate

    df = hourly(spark, d)
    later = df.where("idx >= 400").withColumn("idx", F.col("idx") - 400)
    return concatenate(df.where("idx < 400"), later)


@query("set_5_logical_or", f"{S}, flag i", f"{SERIES} SELECT series_id, idx, max(f) AS flag FROM (SELECT series_id, idx, CASE WHEN value > 30 THEN 1 ELSE 0 END AS f FROM series UNION ALL SELECT series_id, idx, y FROM series) GROUP BY 1, 2")
def _(spark, d):
    df = hourly(spark, d)
    both = df.select("series_id", "idx", (F.col("value") > 30).cast("int").alias("f")).unionByName(df.select("series_id", "idx", F.col("y").alias("f")))
    return both.groupBy("series_id", "idx").agg(F.max("f").alias("flag"))


def sample_sql(source: str, members: int, n: int, seed: str, name: str = "member") -> str:
    return f"SELECT {name}, id FROM (SELECT m AS {name}, id, row_number() OVER (PARTITION BY m ORDER BY md5('{seed}:' || m || ':' || id), id) AS r FROM {source}, range({members}) t(m)) WHERE r <= {n}"


@query("smp_1_bags", "bag i, id i", f"{POINTS} {sample_sql('(SELECT * FROM pts WHERE label = 0)', 10, 50, 'bag', 'bag')} UNION ALL {sample_sql('(SELECT * FROM pts WHERE label = 1)', 10, 20, 'bag', 'bag')}")
def _(spark, d):
    return ensemble.bags(points(spark, d), 10, 50, 20)


@query("smp_2_member_samples", "member i, id i", f"{POINTS} {sample_sql('pts', 20, 16, 'iNNe')}")
def _(spark, d):
    return ensemble.sample(points(spark, d), 20, 16, "iNNe")


@query("smp_3_tree_samples", "tree_id i, id i", f"{POINTS} {sample_sql('pts', 10, 64, 'forest', 'tree_id')}")
def _(spark, d):
    return ensemble.sample(points(spark, d), 10, 64, "forest", "tree_id")


@query("smp_4_unlabelled_sample", "id i", f"{POINTS} SELECT id FROM pts WHERE label = 0 ORDER BY md5('u:' || id), id LIMIT 1000")
def _(spark, d):
    return points(spark, d).where("label = 0").orderBy(ensemble.hashed("u", "id"), "id").limit(1000)


@query("smp_5_weibull_variates", "series_id s, k i, gap d", "SELECT event_type AS series_id, k, 24 + pow(-ln(1 - pow((('0x' || substr(md5('gap:' || event_type || ':' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE, 1 / 24.0::DOUBLE)), 1 / 0.5::DOUBLE) AS gap FROM (SELECT DISTINCT event_type FROM events), range(1, 101) t(k)")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("series_id")).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(100))))
    return generate.weibull_variates(rows, 24.0, 0.5, 24.0, 1.0)


# --- detectors that are windows only


def suspicion_sql(x: str = "gap", a: float = 2.0, c: float = 3.0, scale: float = 20.0, alpha: float = 0.95) -> str:
    return f"""{_LAST}, probs AS (SELECT *, CASE WHEN {x} > 0 THEN pow(1 - exp(-pow({x} / {scale}::DOUBLE, {c}::DOUBLE)), {a}::DOUBLE) ELSE 0 END AS prob FROM since),
  flags AS (SELECT *, CASE WHEN prob > {alpha}::DOUBLE THEN 1 ELSE 0 END AS flag FROM probs)
  SELECT series_id, idx, ts, loc, prob, CASE WHEN flag = 1 AND coalesce(lag(flag) OVER ({BY}), 0) = 0 THEN 1 ELSE 0 END AS pred FROM flags"""


A = f"{S}, ts t, loc i, prob d, pred i"


@query(FLAGSHIP, A, f"{LOCATED}, {suspicion_sql()}")
@query("pip_3_predict_suspicion_time", A, f"{LOCATED}, {suspicion_sql()}")
def _(spark, d):
    return suspicion(located(spark, d), {"a": 2.0, "c": 3.0, "scale": 20.0})


@query("pip_3_predict_suspicion_usage", A, f"{LOCATED}, {suspicion_sql('usage', 1.5, 2.0, 300.0)}")
def _(spark, d):
    return suspicion(located(spark, d), {"a": 1.5, "c": 2.0, "scale": 300.0}, by="usage")


@query("pip_4_average_missing", A, f"{LOCATED}, {_MEAN}, {_LAST} SELECT s.series_id, s.idx, s.ts, s.loc, CASE WHEN s.gap > m.mean THEN 1 ELSE 0 END AS prob, CASE WHEN s.gap > m.mean THEN 1 ELSE 0 END AS pred FROM since s LEFT JOIN mean_gap m ON m.series_id = s.series_id")
def _(spark, d):
    df = located(spark, d)
    return average_suspicion(df, mean_interarrival(df))


def _noisy(spark, d):
    """Segment labels with gaps and false hits, from y and the values."""
    y = F.when(F.col("value") > 45, 1).when(F.col("idx") % 11 == 0, 0).otherwise(F.col("y"))
    return hourly(spark, d).withColumn("y", y)


_NOISY = "noisy AS (SELECT series_id, idx, CASE WHEN value > 45 THEN 1 WHEN idx % 11 = 0 THEN 0 ELSE y END AS y FROM series)"
_REC = RANGES.replace("WITH", "WITH RECURSIVE", 1)


def locate_sql(w: int) -> str:
    return f"""{_REC}, {_NOISY}, {support_sql(w, 'noisy')}, {threshold_sql('support')},
  above AS (SELECT s.series_id, s.idx FROM support s JOIN limits l ON l.series_id = s.series_id AND s.support >= l.threshold), runs AS {base.islands('above', 'true')},
  centred AS (SELECT series_id, (b + e) // 2 AS idx FROM runs), {repair_sql('centred', 'repaired')}, {apart_sql('repaired', w, 'kept')}
  SELECT s.series_id, s.idx, CASE WHEN k.idx IS NULL THEN 0 ELSE 1 END AS loc FROM series s LEFT JOIN kept k ON k.series_id = s.series_id AND k.idx = s.idx"""


@query("pip_1b_find_locations", f"{S}, loc i", locate_sql(4))
def _(spark, d):
    return find_locations(_noisy(spark, d), series.pattern_ranges(hourly(spark, d)), 4)


@query("pip_1c_find_locations_old", f"{S}, loc i", f"""{_REC}, {_NOISY}, {_RESET.replace('FROM series))', 'FROM noisy))')}, {threshold_sql('reset')},
  above AS (SELECT s.series_id, s.idx FROM reset s JOIN limits l ON l.series_id = s.series_id AND s.support >= l.threshold), runs AS {base.islands('above', 'true')},
  begun AS (SELECT series_id, b AS idx FROM runs), {repair_sql('begun', 'repaired')}, {apart_sql('repaired', 3, 'kept')}
  SELECT s.series_id, s.idx, CASE WHEN k.idx IS NULL THEN 0 ELSE 1 END AS loc FROM series s LEFT JOIN kept k ON k.series_id = s.series_id AND k.idx = s.idx""")  # fmt: skip
def _(spark, d):
    return find_locations_old(_noisy(spark, d), series.pattern_ranges(hourly(spark, d)), 3)


# --- generator


@query("gen_2_holidays", f"{S}, value d", f"""{SERIES}, weeks AS (SELECT series_id, w, row_number() OVER (PARTITION BY series_id ORDER BY md5('holiday:' || series_id || ':0:' || w)) AS r FROM (SELECT DISTINCT series_id, idx // 168 AS w FROM series WHERE idx // 168 < 4))
  SELECT s.series_id, s.idx, CASE WHEN k.r <= 1 OR (k.r <= 2 AND s.idx % 168 >= 96) THEN -1 ELSE s.value END AS value FROM series s LEFT JOIN weeks k ON k.series_id = s.series_id AND k.w = s.idx // 168""")  # fmt: skip
def _(spark, d):
    return generate.holidays(hourly(spark, d).withColumn("noise", F.lit(-1.0)), week=168, weeks=1, weekends=1, weekend=72, year=720)


@query("gen_5_test_sets", "series_id s, test_id i, idx i, value d, pattern i, missing_label i", f"""{RANGES}, sets AS (SELECT series_id, t AS test_id, max((b, e)) AS r, count(*) AS n FROM ranges, range(17) x(t) WHERE b // 168 >= t AND e // 168 < t + 2 GROUP BY 1, 2)
  SELECT s.series_id, k.test_id, s.idx, CASE WHEN s.idx BETWEEN k.r[1] AND k.r[2] THEN 0.5 WHEN s.idx >= k.r[2] + 40 THEN 0.25 ELSE s.value END AS value,
    CASE WHEN s.idx BETWEEN k.r[1] AND k.r[2] OR s.idx >= k.r[2] + 40 THEN 0 ELSE s.y END AS pattern, CASE WHEN s.idx = (k.r[1] + k.r[2]) // 2 THEN 1 ELSE 0 END AS missing_label
  FROM series s JOIN sets k ON k.series_id = s.series_id AND s.idx // 168 BETWEEN k.test_id AND k.test_id + 1 WHERE k.n > 1""")  # fmt: skip
def _(spark, d):
    df = hourly(spark, d).select("series_id", "idx", F.floor(F.col("idx") / 168).cast("long").alias("period"), "value", F.lit(0.5).alias("clean"), F.lit(0.25).alias("noise"), F.col("y").alias("loc"))
    return generate.test_sets(df, breakdown=40)


@query("est_17_rescale", "series_id s, range_id i, v a", f"{_PATTERNS} SELECT series_id, range_id, CASE WHEN list_max(pattern) > list_min(pattern) THEN list_transform(pattern, lambda x: 5 + (x - list_min(pattern)) / (list_max(pattern) - list_min(pattern)) * 3) ELSE list_transform(pattern, lambda x: 5.0::DOUBLE) END AS v FROM patterns")
def _(spark, d):
    df = hourly(spark, d)
    return series.extract_patterns(df, series.pattern_ranges(df)).withColumn("v", generate.rescale(F.col("pattern"), 5.0, 8.0))


@query("est_12_exponweib_cdf", "event_id i, p d", "SELECT event_id, CASE WHEN value - 1 > 0 THEN pow(1 - exp(-pow((value - 1) / 8.0::DOUBLE, 1.4::DOUBLE)), 2.5::DOUBLE) ELSE 0 END AS p FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.exponweib_cdf(F.col("value"), 2.5, 1.4, 1.0, 8.0).alias("p"))


@query("est_13_weibull_quantile", "event_id i, t d", "SELECT event_id, 8.0 * pow(-ln(1 - (event_id % 99 + 1) / 100.0::DOUBLE), 1 / 1.7::DOUBLE) AS t FROM events")
def _(spark, d):
    q = (F.col("event_id") % 99 + 1) / 100.0
    return table(spark, d, "events").select("event_id", (8.0 * F.pow(-F.log(1 - q), F.lit(1 / 1.7))).alias("t"))


@query("scl_5_squash", f"{S}, v d", f"{SERIES} SELECT series_id, idx, pow(2, -pow(value / 20.0::DOUBLE, 2)) AS v FROM series")
def _(spark, d):
    return hourly(spark, d).withColumn("v", X.squash(F.col("value"), 20.0))


