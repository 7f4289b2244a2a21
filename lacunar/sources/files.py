"""File sources and sinks; schemas are declared, so nothing is inferred by a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POWER = "Date string, Time string, Global_active_power double, Global_reactive_power double, Voltage double, Global_intensity double, Sub_metering_1 double, Sub_metering_2 double, Sub_metering_3 double"
CLEAN = "timestamp timestamp_ntz, usage double, noise double, hour int"


def read_power(spark: SparkSession, path: str) -> DataFrame:
    """Household power readings: semicolons, ? for missing, day and time as one timestamp."""
    raw = spark.read.schema(POWER).option("sep", ";").option("header", True).option("nullValue", "?").csv(path)
    return raw.withColumn("Date_Time", F.to_timestamp_ntz(F.concat_ws(" ", "Date", "Time"), F.lit("d/M/yyyy H:m:s"))).drop("Date", "Time")


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN).option("header", True).csv(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(class, values) of the headerless files in a folder whose names hold TRAIN or TEST."""
    lines = spark.read.option("pathGlobFilter", "*{TRAIN,TEST}*").text(path)
    cells = F.transform(F.split("value", ","), lambda x: x.try_cast("double"))
    return lines.where("trim(value) <> ''").select(cells[0].alias("class"), F.slice(cells, 2, F.size(cells)).alias("values"))


def from_pandas(spark: SparkSession, pdf) -> DataFrame:
    """A Series from aligned vectors in a pandas frame with ts, value and perhaps y."""
    from ..operators.series import index
    from ..schema import check_time_series

    df = spark.createDataFrame(pdf)
    df = df if "series_id" in df.columns else df.withColumn("series_id", F.lit("0"))
    return index(check_time_series(df))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_tests(df: DataFrame, path: str) -> None:
    """Test sets as one table, a folder for each test_id."""
    df.write.partitionBy("test_id").parquet(path)
