"""Queries: fitted estimators, checked by rows (and by tests of their invariants)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import ensemble, series
from . import generate
from .base import SERIES, hourly, located, points, table
from .catalog import query
from .detectors import descriptors, find_locations, fit_weibull, low_pass, shape_templates
from .q_series import _PATTERNS

SCORE = "id i, score d, pred i"


@query("est_3_isolation_forest", SCORE)
def _(spark, d):
    return ensemble.isolation_forest(points(spark, d))


@query("est_4_extended_isolation_forest", SCORE)
def _(spark, d):
    return ensemble.isolation_forest(points(spark, d), level=3)


@query("est_4b_tree_branches", "tree_id i, node_id i, path s")
def _(spark, d):
    return ensemble.branches(ensemble.forest(points(spark, d), 5, 64))


@query("est_5_one_class_svm", SCORE)
def _(spark, d):
    return ensemble.one_class_svm(points(spark, d))


@query("est_8_ssad", SCORE)
@query("est_9_convex_ssad", SCORE)
@query("flt_8_support_vectors", SCORE)
def _(spark, d):
    return ensemble.ssad(points(spark, d), width=64.0)


@query("est_10_bagging_svm", "id i, prob d, pred i")
def _(spark, d):
    p = points(spark, d).withColumn("label", F.greatest("label", F.lit(0)))
    return ensemble.bagging_svm(p)


@query("est_10b_bagging_forest", "id i, prob d, pred i")
def _(spark, d):
    p = points(spark, d).withColumn("label", F.greatest("label", F.lit(0)))
    return ensemble.bagging_forest(p)


@query("est_12_exponweib_fit", "series_id s, kind s, a d, c d, shift d, scale d, nll d")
def _(spark, d):
    return fit_weibull(descriptors(located(spark, d)))


@query("est_13_weibull_fit", "series_id s, k d, l d")
def _(spark, d):
    import numpy as np
    import pandas as pd

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k, lam, low, _ = numeric.weibull_fit(np.maximum(pdf.usage.to_numpy(), 1e-9))
        return pd.DataFrame({"series_id": [key[0]], "k": [k], "l": [lam * low]})

    return series.usage_between(located(spark, d)).groupBy("series_id").applyInPandas(fit, "series_id string, k double, l double")


@query("est_14_spectral_templates", "series_id s, template_id i, shape a")
def _(spark, d):
    df = hourly(spark, d)
    return shape_templates(df, series.pattern_ranges(df), 5)


@query("est_15_low_pass_locations", "series_id s, idx i, loc i")
def _(spark, d):
    df = hourly(spark, d)
    return find_locations(df, series.pattern_ranges(df), 4, smooth="low-pass")


_KERNEL = """(1 + 2 * coalesce(list_sum(list_transform(range(1, (n - 1) // 2 + 1), lambda j: cos(2 * pi() * j * (k / 2.0::DOUBLE - t) / n))), 0)
  + CASE WHEN n % 2 = 0 THEN cos(pi() * (k / 2.0::DOUBLE - t)) ELSE 0 END) / n"""


@query("est_16_fft_resample", "series_id s, range_id i, x a", f"{_PATTERNS}, sized AS (SELECT *, len(pattern) AS n FROM patterns) SELECT series_id, range_id, list_transform(range(2 * n), lambda k: list_sum(list_transform(range(n), lambda t: pattern[t + 1] * {_KERNEL}))) AS x FROM sized")
def _(spark, d):
    df = hourly(spark, d)
    return series.extract_patterns(df, series.pattern_ranges(df)).withColumn("x", generate.fft_resample("pattern", F.size("pattern") * 2))


def _shapes(spark, d):
    df = hourly(spark, d)
    runs = series.pattern_ranges(df)
    return series.extract_patterns(df, runs).select(F.concat_ws(":", "series_id", F.col("range_id").cast("string")).alias("k"), F.col("range_id").cast("double").alias("class"), F.col("pattern").alias("values"))


@query("gen_1_clean_power", "series_id s, idx i, usage d, noise d, hour i", f"""{SERIES}, energy AS (SELECT series_id, idx, ts, (value * (1000.0::DOUBLE / 60.0::DOUBLE) - y) * (60.0::DOUBLE / 1000.0::DOUBLE) AS v FROM series),
  holed AS (SELECT series_id, idx, ts, CASE WHEN idx % 19 = 5 AND idx >= 148 THEN NULL ELSE v END AS v FROM energy)
  SELECT h.series_id, h.idx, coalesce(h.v, t.v) AS usage, t.v AS noise, hour(h.ts) AS hour FROM holed h LEFT JOIN holed t ON t.series_id = h.series_id AND t.idx = 100 + h.idx % 48 WHERE h.ts >= TIMESTAMP '2024-01-03'""")  # fmt: skip
def _(spark, d):
    active = F.when((F.col("idx") % 19 == 5) & (F.col("idx") >= 148), None).otherwise(F.col("value"))
    df = hourly(spark, d).select("series_id", "idx", "ts", active.alias("Global_active_power"), F.col("y").cast("double").alias("Sub_metering_3"))
    return generate.clean_power(df, 100, 148, since="2024-01-03")


@query("gen_3_time_patterns", "series_id s, idx i, value d, loc i")
def _(spark, d):
    shapes = generate.make_patterns(_shapes(spark, d), [0.0, 1.0], (20, 28), (0.0, 1.0), (5.0, 9.0)).select("k", "shape")
    return generate.insert_by_time(hourly(spark, d), shapes, gap=48.0)


@query("gen_4_usage_patterns", "series_id s, idx i, value d, loc i")
def _(spark, d):
    return generate.insert_by_usage(hourly(spark, d), [[5.0, 9.0, 5.0], [4.0, 8.0, 8.0, 4.0]], usage=400.0)


@query("gen_6_get_patterns", "class d, k s, shape a")
def _(spark, d):
    return generate.make_patterns(_shapes(spark, d), [0.0, 1.0, 2.0], (20, 28), (0.0, 1.0), (5.0, 9.0))


@query("flt_9_low_pass_support", "series_id s, idx i, support d")
def _(spark, d):
    df = hourly(spark, d)
    return low_pass(df, series.pattern_ranges(df), 4)


@query("str_1_hourly_usage", "series_id s, ts t, value d", "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    """The batch twin of the streaming aggregate: the same plan over a bounded table."""
    from ..streaming.absence import hourly_usage

    return hourly_usage(table(spark, d, "events"))


@query("str_3_sessions", "series_id s, n i", """WITH steps AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
  runs AS (SELECT event_type, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM steps) SELECT event_type AS series_id, count(*) AS n FROM runs GROUP BY event_type, run""")  # fmt: skip
def _(spark, d):
    from ..streaming.absence import sessions

    return sessions(table(spark, d, "events"))


