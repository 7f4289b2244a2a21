"""Tables of the data model made from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Series for each event type: hourly sums over the hours of all events, 0 where there are none.

    y marks the hours 6 to 8 of days that are no multiple of five.
    """
    ev = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), "value")
    sums = ev.groupBy(F.col("event_type").alias("series_id"), "ts").agg(F.round(F.sum("value"), 3).alias("value"))
    span = sums.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    spine = sums.select("series_id").distinct().crossJoin(F.broadcast(span)).select("series_id", F.explode(F.expr("sequence(a, z, interval 1 hour)")).alias("ts"))  # span is one row
    out = spine.join(sums, ["series_id", "ts"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    y = F.hour("ts").isin(6, 7, 8) & (F.dayofmonth("ts") % 5 != 0)
    return series.index(out).select("series_id", "idx", "ts", "value", y.cast("int").alias("y"))


SERIES = """WITH hour_spine AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events)),
hour_sums AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 3) AS value FROM events GROUP BY 1, 2),
series AS (SELECT k.series_id, row_number() OVER (PARTITION BY k.series_id ORDER BY h.ts) - 1 AS idx, h.ts, coalesce(s.value, 0) AS value,
  CASE WHEN hour(h.ts) IN (6, 7, 8) AND day(h.ts) % 5 <> 0 THEN 1 ELSE 0 END AS y
  FROM (SELECT DISTINCT event_type AS series_id FROM events) k CROSS JOIN hour_spine h LEFT JOIN hour_sums s ON s.series_id = k.series_id AND s.ts = h.ts)"""


def islands(source: str, flag: str) -> str:
    return f"""(SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY min(idx)) - 1 AS range_id, min(idx) AS b, max(idx) AS e
  FROM (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS grp FROM {source} WHERE {flag}) GROUP BY series_id, grp)"""


RANGES = f"{SERIES},\nranges AS {islands('series', 'y = 1')}"
#: Occurrences at the centres of the labelled runs.
LOCATED = f"{RANGES},\nlocated AS (SELECT s.*, CASE WHEN r.b IS NULL THEN 0 ELSE 1 END AS loc FROM series s LEFT JOIN ranges r ON r.series_id = s.series_id AND s.idx = (r.b + r.e) // 2)"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly(spark, sf_dir)
    at = series.centres(series.pattern_ranges(df)).select("series_id", F.col("centre").alias("idx"))
    return series.on_spine(df, at, "loc")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from the embeddings: label 0 is an anomaly (1), label 1 normal (-1), others unlabelled."""
    label = F.when(F.col("label") == 0, 1).when(F.col("label") == 1, -1).otherwise(0)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), label.alias("label"))


POINTS = "WITH pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, CASE label WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS label FROM embeddings)"


def frame(w: int) -> str:
    return f"OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"


BY = "PARTITION BY series_id ORDER BY idx"
