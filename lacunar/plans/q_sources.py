"""Queries: what sources read back of what sinks, or files of their formats, hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series
from ..operators.store import scratch
from ..sources import files
from .base import SERIES, hourly
from .catalog import query
from .detectors import AverageMissing, DiscordDetector
from .q_series import _PATTERNS


def _rename(spark, path: str, name: str) -> None:
    """Gives the one part file of a folder a name, as the pattern files have."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = fs_path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        at = f.getPath()
        if at.getName().startswith("part-"):
            fs.rename(at, fs_path(f"{path}/{name}"))


@query("src_1_power_readings", "ts t, active d, volts d", f"{SERIES} SELECT ts, CASE WHEN idx % 19 = 5 THEN NULL ELSE value END AS active, idx AS volts FROM series")
def _(spark, d):
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    active = F.when(F.col("idx") % 19 != 5, F.col("value"))
    rows = hourly(spark, d).select(F.date_format("ts", "d/M/yyyy").alias("Date"), F.date_format("ts", "H:m:s").alias("Time"), text(active).alias("Global_active_power"), F.lit("0.1").alias("Global_reactive_power"), text(F.col("idx")).alias("Voltage"), F.lit("?").alias("Global_intensity"), *(F.lit("0").alias(f"Sub_metering_{k}") for k in (1, 2, 3)))
    path = scratch(spark)
    rows.write.option("sep", ";").option("header", True).csv(path)
    got = files.read_power(spark, path)
    return got.select(F.col("Date_Time").alias("ts"), F.col("Global_active_power").alias("active"), F.col("Voltage").alias("volts"))


def _clean(spark, d) -> DataFrame:
    return hourly(spark, d).select(F.col("ts").alias("timestamp"), F.col("value").alias("usage"), F.col("y").cast("double").alias("noise"), F.hour("ts").alias("hour"))


_CLEAN = f"{SERIES} SELECT ts AS timestamp, value AS usage, y AS noise, hour(ts) AS hour FROM series"


@query("src_2_cleaned_series", "timestamp t, usage d, noise d, hour i", _CLEAN)
def _(spark, d):
    path = scratch(spark)
    files.write_csv(_clean(spark, d), path)
    return files.read_clean(spark, path)


@query("snk_1_csv", "timestamp t, usage d, noise d, hour i", _CLEAN)
def _(spark, d):
    """The sink's files as any reader sees them: names in the header, plain text below."""
    path = scratch(spark)
    files.write_csv(_clean(spark, d), path)
    got = spark.read.option("header", True).csv(path)
    return got.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("usage").cast("double").alias("usage"), F.col("noise").cast("double").alias("noise"), F.col("hour").cast("int").alias("hour"))


@query("src_3_pattern_files", "class d, values a", f"{_PATTERNS} SELECT range_id AS class, pattern AS values FROM patterns")
def _(spark, d):
    df = hourly(spark, d)
    pats = series.extract_patterns(df, series.pattern_ranges(df))
    lines = pats.select(F.concat_ws(",", F.col("range_id").cast("double").cast("string"), F.transform("pattern", lambda x: x.cast("string"))))
    path = scratch(spark)
    lines.coalesce(1).write.text(path)  # one file of the format
    _rename(spark, path, "Shapes_TRAIN.csv")
    return files.read_patterns(spark, path)


@query("src_4_in_memory", "series_id s, idx i, ts t, value d", f"{SERIES} SELECT series_id, idx, ts, value FROM series")
def _(spark, d):
    """Vectors in the driver's memory, which is what this source reads."""
    return files.from_pandas(spark, hourly(spark, d).select("series_id", "ts", "value").toPandas())


@query("snk_2_test_sets", "test_id i, series_id s, idx i, value d", f"{SERIES} SELECT idx // 240 AS test_id, series_id, idx, value FROM series")
def _(spark, d):
    path = scratch(spark)
    files.write_tests(hourly(spark, d).withColumn("test_id", F.floor(F.col("idx") / 240).cast("int")), path)
    return spark.read.parquet(path)


@query("api_1_parameters", "name s, value s", """SELECT * FROM (VALUES ('average.missing_alpha', '0.9'), ('average.missing_features', 'all'), ('average.occurrence_detection', 'fingerprint'), ('average.detector', NULL),
  ('discord.ws', '12'), ('discord.missing_classifier', 'MatrixProfile'), ('discord.missing_alpha', '0.9'), ('discord.ddof', '1')) t(name, value)""")  # fmt: skip
def _(spark, d):
    """Parameters as given, as set later, and as they are by default."""
    made = {"average": AverageMissing(missing_alpha=0.9), "discord": DiscordDetector()}
    made["discord"].set_params(ws=12)
    rows = [(f"{k}.{c}", None if v is None else str(v)) for k, x in made.items() for c, v in x.get_params().items()]
    return spark.createDataFrame(rows, "name string, value string")
