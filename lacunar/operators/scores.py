"""Scalers, thresholds and scores.

Statistics of a group are one grouped aggregate or a window partitioned by the
group; order statistics are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def _over(keys: list[str]):
    return Window.partitionBy(*keys)


def _stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """df with a group's aggregates on each row: one small table, joined back."""
    named = [v.alias(k) for k, v in aggs.items()]
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*named)))  # one row
    return df.join(df.groupBy(*keys).agg(*named), keys)


def standard(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    aggs = {f"_{f}_{c}": g(c) for c in cols for f, g in (("m", F.avg), ("s", F.stddev_pop))}
    out = _stats(df, keys, **aggs)
    return out.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in cols}).drop(*aggs)


def minmax(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    aggs = {f"_{f}_{c}": g(c) for c in cols for f, g in (("a", F.min), ("z", F.max))}
    out = _stats(df, keys, **aggs)
    return out.withColumns({c: F.when(F.col(f"_z_{c}") > F.col(f"_a_{c}"), (F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_z_{c}") - F.col(f"_a_{c}"))).otherwise(0.0) for c in cols}).drop(*aggs)


def robust(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """(x - median) / interquartile range, exact percentiles; a range of 0 divides by 1."""
    aggs = {f"_q_{c}": F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for c in cols}
    out = _stats(df, keys, **aggs)
    iqr = lambda c: F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
    return out.withColumns({c: (F.col(c) - F.col(f"_q_{c}")[1]) / F.when(iqr(c) > 0, iqr(c)).otherwise(1.0) for c in cols}).drop(*aggs)


BINS = 4096


def order_statistic(df: DataFrame, col: str, share: float) -> float | None:
    """The value at position int(n * share) of the sorted column, the last one at most; None if it is null.

    Exact and without a sort: counts over BINS ranges of values tell the range
    that holds the position, which is cut again until it holds one value. Each
    round is a grouped count with BINS + 1 rows; nulls come first.
    """
    x = F.col(col).cast("double")
    top = df.agg(F.count(F.lit(1)), F.count(x), F.min(x), F.max(x)).first()
    rows, known, low, high = top
    at = min(int(rows * share), rows - 1) - (rows - known)
    if at < 0:
        return None
    while low < high:
        bin_ = F.when(x >= high, BINS).otherwise(F.least(F.floor((x - low) / F.lit(high - low) * BINS), F.lit(BINS - 1)))
        got = df.where((x >= low) & (x <= high)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("a"), F.max(x).alias("z"))
        for r in sorted(got.collect(), key=lambda r: r["bin"]):  # BINS + 1 rows at most
            if at < r["n"]:
                low, high = r["a"], r["z"]
                break
            at -= r["n"]
    return low


def contamination(df: DataFrame, share: float, keys: list[str], score: str = "score", name: str = "pred") -> DataFrame:
    """Labels 1 at or above the value at position int(n * (1 - share)) of the sorted scores, else -1.

    The position is an exact order statistic, clamped to the last one. Ties of
    the value all get 1, so at least n - int(n * (1 - share)) rows do. Without
    keys the scores are written once and counted by ranges, since no task could
    sort them all; with keys a window sorts each group.
    """
    if not keys:
        df = stored(df)
        value = order_statistic(df, score, 1 - share)
        return df.withColumn(name, F.when(F.col(score) >= F.lit(value).cast("double"), 1).otherwise(-1))
    n = F.count(F.lit(1)).over(_over(keys))
    rank = F.row_number().over(_over(keys).orderBy(score))
    at = F.least(F.floor(n * (1 - share)) + 1, n)
    ranked = df.withColumn("_at", at).withColumn("_rank", rank)
    value = F.max(F.when(F.col("_rank") == F.col("_at"), F.col(score))).over(_over(keys))  # of the same pass, so that equal scores stay equal
    out = ranked.withColumn("_t", value)
    return out.withColumn(name, F.when(F.col(score) >= F.col("_t"), 1).otherwise(-1)).drop("_at", "_rank", "_t")


def run_threshold(values: DataFrame, ranges: DataFrame, col: str = "support") -> DataFrame:
    """(series_id, threshold, spread): least of the runs' largest values, zeros left out; their deviation."""
    each = ranges.select("series_id", "range_id", F.explode(F.sequence("b", "e")).alias("idx"))
    top = each.join(values.select("series_id", "idx", col), ["series_id", "idx"]).groupBy("series_id", "range_id").agg(F.max(col).alias("top"))
    top = top.where("top <> 0")
    return top.groupBy("series_id").agg(F.min("top").alias("threshold"), F.stddev_pop("top").alias("spread"))


def binarise(x: Column, t: Column | float) -> Column:
    return (x >= t).cast("int")


def vote(df: DataFrame, key: list[str], pred: str = "pred") -> DataFrame:
    """Mean of the members' votes, min-max scaled, and 1 above a half."""
    v = df.groupBy(*key).agg(F.avg(pred).alias("prob"))
    v = minmax(v, ["prob"], [])
    return v.withColumn("pred", (F.col("prob") > 0.5).cast("int"))
