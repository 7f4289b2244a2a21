"""Cleaning, and synthetic series with patterns put in and one taken out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric
from ..operators import series


VALUES = T.ArrayType(T.DoubleType())


def active_energy(active: Column, sub3: Column) -> Column:
    """Watt-hours of a minute outside the third meter, in kilowatts again."""
    return (active * (1000.0 / 60.0) - sub3) * (60.0 / 1000.0)


def fill_from_donor(df: DataFrame, first: int, last: int, col: str = "value") -> DataFrame:
    """Missing values from the donor rows [first, last), repeated along each series."""
    n = last - first
    donor = df.where(F.col("idx").between(first, last - 1)).select("series_id", (F.col("idx") - first).alias("_slot"), F.col(col).alias("_donor"))
    out = df.withColumn("_slot", F.col("idx") % n).join(donor, ["series_id", "_slot"], "left")
    bad = F.col(col).isNull() | F.isnan(col)
    return out.withColumn(col, F.when(bad, F.col("_donor")).otherwise(F.col(col))).drop("_slot", "_donor")


def clean_power(df: DataFrame, first: int, last: int, since: str = "2006-12-17") -> DataFrame:
    """(series_id, idx, timestamp, usage, noise, hour) from indexed power readings."""
    df = df.withColumn("value", active_energy(F.col("Global_active_power"), F.col("Sub_metering_3")))
    df = fill_from_donor(df, first, last)
    donor = df.where(F.col("idx").between(first, last - 1)).select("series_id", (F.col("idx") - first).alias("_slot"), F.col("value").alias("noise"))
    df = df.withColumn("_slot", F.col("idx") % (last - first)).join(donor, ["series_id", "_slot"], "left").drop("_slot")
    return df.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).select("series_id", "idx", F.col("ts").alias("timestamp"), F.col("value").alias("usage"), "noise", F.hour("ts").alias("hour"))


def thin(df: DataFrame, skip: int, every: int, most: int) -> DataFrame:
    """Every so many rows after the first skip, at most so many a series; positions count anew."""
    at = F.col("idx") - skip
    return df.where((at >= 0) & (at % every == 0) & (at < most * every)).withColumn("idx", F.floor(at / every).cast("long"))


def holidays(df: DataFrame, week: int, weeks: int, weekends: int, weekend: int, year: int, seed: str = "holiday") -> DataFrame:
    """Replaces value by noise in some whole weeks and some long weekends (ends of weeks) of each year.

    Weeks are drawn by hash; a holiday week is no long weekend too.
    """
    per_year = year // week
    df = df.withColumn("_y", F.floor(F.col("idx") / year)).withColumn("_w", F.floor((F.col("idx") % year) / week)).withColumn("_in", (F.col("idx") % year) % week)
    each = df.where(F.col("_w") < per_year).select("series_id", "_y", "_w").distinct()
    rank = F.row_number().over(Window.partitionBy("series_id", "_y").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "series_id", F.col("_y").cast("string"), F.col("_w").cast("string")).cast("binary"))))
    each = each.withColumn("_r", rank)
    out = df.join(each, ["series_id", "_y", "_w"], "left")
    off = (F.col("_r") <= weeks) | ((F.col("_r") <= weeks + weekends) & (F.col("_in") >= week - weekend))
    return out.withColumn("value", F.when(off, F.col("noise")).otherwise(F.col("value"))).drop("_y", "_w", "_in", "_r")


def hash_uniform(seed: str, *cols) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(seed), *cols).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)


def weibull_variates(rows: DataFrame, a: float, c: float, loc: float, scale: float, seed: str = "gap") -> DataFrame:
    """Adds gap: exponentiated Weibull draws fixed by (series_id, k)."""
    u = hash_uniform(seed, F.col("series_id"), F.col("k").cast("string"))
    return rows.withColumn("gap", loc + scale * F.pow(-F.log(1 - F.pow(u, F.lit(1.0 / a))), F.lit(1.0 / c)))


def insert_by_time(df: DataFrame, shapes: DataFrame, gap: float, superimpose: bool = True, seed: str = "gap") -> DataFrame:
    """Puts patterns in at sampled distances: adds loc, changes value.

    Places are running sums of the gaps; one whose pattern would reach into the
    next month moves back to end with its month. shapes: (k, shape) variations.
    """
    n = df.groupBy("series_id").agg(F.max("idx").alias("last"))
    draws = n.select("series_id", "last", F.explode(F.sequence(F.lit(1), F.ceil(F.col("last") / gap).cast("int") + 1)).alias("k"))
    draws = weibull_variates(draws, gap, 0.5, gap, 1.0, seed)
    at = F.floor(F.sum(F.floor("gap")).over(Window.partitionBy("series_id").orderBy("k"))).cast("long")
    count = shapes.count()  # a handful
    pick = F.pmod(F.xxhash64(F.lit(seed), "series_id", "k"), F.lit(count))
    numbered = shapes.select((F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("_pick"), "shape")
    placed = draws.withColumn("at", at).withColumn("_pick", pick).join(F.broadcast(numbered), "_pick").withColumn("len", F.size("shape")).where(F.col("at") + F.col("len") <= F.col("last"))
    months = series.month_counter(df).groupBy("series_id", "month").agg(F.max("idx").alias("month_end"), F.min("idx").alias("month_start"))
    placed = placed.join(months, "series_id").where((F.col("at") >= F.col("month_start")) & (F.col("at") <= F.col("month_end")))
    placed = placed.withColumn("at", F.greatest(F.col("month_start"), F.least(F.col("at"), F.col("month_end") - F.col("len") + 1)))
    cells = placed.select("series_id", "k", "at", F.posexplode("shape").alias("i", "v")).select("series_id", "k", (F.col("at") + F.col("i")).alias("idx"), "v")
    cells = cells.groupBy("series_id", "idx").agg(F.sum("v").alias("all"), F.max_by("v", "k").alias("top"))
    out = df.join(cells, ["series_id", "idx"], "left")
    value = F.col("value") + F.col("all") if superimpose else F.col("top")
    return out.withColumn("loc", F.col("all").isNotNull().cast("int")).withColumn("value", F.when(F.col("all").isNotNull(), value).otherwise(F.col("value"))).drop("all", "top")


def insert_by_usage(df: DataFrame, shapes: list[list[float]], usage: float, night_only: bool = False, superimpose: bool = True, seed: str = "usage") -> DataFrame:
    """Puts a pattern in whenever enough was used since the last one; each series in order, as it must be."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v, loc, rng = pdf.value.to_numpy().copy(), np.zeros(len(pdf), int), numeric.generator(seed, key[0])
        hours, months = pdf.ts.dt.hour.to_numpy(), pdf.ts.dt.month.to_numpy()
        draw = lambda: numeric.exponweib_quantile(rng.uniform(1e-9, 1 - 1e-9), usage, 0.5, usage, 1.0)
        need, used, i = draw(), 0.0, 1
        while i < len(v):
            used += v[i - 1]
            if used >= need and (not night_only or hours[i] <= 6):
                p = np.asarray(shapes[int(rng.integers(len(shapes)))])
                at = i
                if at + len(p) > len(v):
                    break
                while at > 0 and months[at] != months[at + len(p) - 1]:
                    at -= 1
                v[at : at + len(p)] = v[at : at + len(p)] + p if superimpose else p
                loc[at : at + len(p)] = 1
                i, used, need = max(i, at + len(p)), 0.0, draw()
            i += 1
        return pdf.assign(value=v, loc=loc)[["series_id", "idx", "ts", "value", "loc"]]

    rows = df.select("series_id", "idx", F.col("ts").cast("timestamp").alias("ts"), "value")
    return rows.groupBy("series_id").applyInPandas(run, "series_id string, idx long, ts timestamp, value double, loc int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_sets(df: DataFrame, breakdown: int, span: int = 2, most: int = 17) -> DataFrame:
    """(series_id, test_id, idx, value, pattern, missing_label) of sets that each lack their last pattern.

    df: (series_id, idx, period, value, clean, noise, loc). A set is ``span``
    periods from test_id on. The last whole pattern gives way to clean, and what
    comes ``breakdown`` rows after it to noise; missing_label marks its centre.
    Sets of less than two patterns are left out.
    """
    runs = series.pattern_ranges(df, "loc")
    at = df.select("series_id", "idx", "period")
    runs = runs.join(at.select("series_id", F.col("idx").alias("b"), F.col("period").alias("pb")), ["series_id", "b"]).join(at.select("series_id", F.col("idx").alias("e"), F.col("period").alias("pe")), ["series_id", "e"])
    starts = lambda lo, hi: F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), hi - span + 1), lo))
    sets = runs.where(F.col("pe") - F.col("pb") < span).select("series_id", "b", "e", starts(F.col("pb"), F.col("pe")).alias("test_id"))
    sets = sets.groupBy("series_id", "test_id").agg(F.max(F.struct("b", "e")).alias("r"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("test_id") < most))
    rows = df.withColumn("test_id", starts(F.col("period"), F.col("period"))).join(sets.select("series_id", "test_id", "r.b", "r.e"), ["series_id", "test_id"])
    gone = F.col("idx").between(F.col("b"), F.col("e"))
    late = F.col("idx") >= F.col("e") + breakdown
    return rows.select(
        "series_id", "test_id", "idx",
        F.when(gone, F.col("clean")).when(late, F.col("noise")).otherwise(F.col("value")).alias("value"),
        F.when(gone | late, 0).otherwise(F.col("loc")).alias("pattern"),
        (F.col("idx") == F.floor((F.col("b") + F.col("e")) / 2)).cast("int").alias("missing_label"),
    )


def rescale(values: Column, bottom: Column | float, top: Column | float) -> Column:
    """Min-max to [bottom, top]; constant arrays become bottom."""
    lo, hi = F.array_min(values), F.array_max(values)
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.transform(values, lambda x: F.when(hi > lo, lit(bottom) + (x - lo) / (hi - lo) * (lit(top) - lit(bottom))).otherwise(lit(bottom)))


@F.pandas_udf(VALUES)
def fft_resample(values: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([numeric.fft_resample(np.asarray(v, float), int(k)).tolist() for v, k in zip(values, n, strict=True)])


@F.pandas_udf(VALUES)
def _shaped(values: pd.Series, n: pd.Series, bottom: pd.Series, top: pd.Series) -> pd.Series:
    out = []
    for v, k, lo, hi in zip(values, n, bottom, top, strict=True):
        x = numeric.fft_resample(np.asarray(v, float), int(k))
        span = x.max() - x.min()
        out.append((lo + (x - x.min()) / span * (hi - lo) if span > 0 else np.full(len(x), lo)).tolist())
    return pd.Series(out)


def make_patterns(df: DataFrame, classes: list[float], lengths: tuple[int, int], bottom: tuple[float, float], top: tuple[float, float], seed: str = "shape") -> DataFrame:
    """(class, k, shape): the rows of some classes, resampled and rescaled to lengths and ranges drawn by hash."""
    rows = df.where(F.col("class").isin(classes)).withColumn("k", F.md5(F.to_json(F.struct("class", "values")).cast("binary")))
    u = lambda tag, lo, hi: lo + hash_uniform(seed + tag, F.col("k")) * (hi - lo)
    n = F.floor(u("n", *map(float, lengths))).cast("int")
    return rows.withColumn("shape", _shaped("values", n, u("b", *bottom), u("t", *top))).select("class", "k", "shape")
