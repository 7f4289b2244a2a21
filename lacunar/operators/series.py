"""Series restructuring: runs, segments, labels, windows, gap rules.

A Series is (series_id, idx, ts, value, y). Every window is partitioned by
series_id, so that many series spread over the cluster; data-dependent window
lengths are columns, so that no operator needs a driver action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def along():
    """Each series in order."""
    return Window.partitionBy("series_id").orderBy("idx")


def ahead(w: int):
    """Frame of a segment of w values that starts at the row."""
    return along().rowsBetween(0, w - 1)


def index(df: DataFrame, order: str = "ts") -> DataFrame:
    return df.withColumn("idx", (F.row_number().over(Window.partitionBy("series_id").orderBy(order)) - 1).cast("long"))


def pattern_ranges(df: DataFrame, flag: Column | str = "y", compat: bool = False) -> DataFrame:
    """(series_id, range_id, b, e): maximal runs of flag = 1.

    compat: a run of one value at the very end of the runs is lost if it is not the only one.
    """
    flag = F.col(flag) if isinstance(flag, str) else flag
    ones = df.where(flag == 1).select("series_id", "idx").withColumn("grp", F.col("idx") - F.row_number().over(along()))
    runs = ones.groupBy("series_id", "grp").agg(F.min("idx").alias("b"), F.max("idx").alias("e"))
    by = Window.partitionBy("series_id").orderBy("b")
    runs = runs.withColumn("range_id", (F.row_number().over(by) - 1).cast("long"))
    if compat:
        last = F.max("b").over(Window.partitionBy("series_id"))
        runs = runs.withColumn("last", last).where(~((F.col("b") == F.col("last")) & (F.col("b") == F.col("e")) & (F.col("range_id") > 0)))
    return runs.select("series_id", "range_id", "b", "e")


def window_size(ranges: DataFrame) -> DataFrame:
    """(series_id, w): the mean run length, halves to even."""
    return ranges.groupBy("series_id").agg(F.bround(F.avg(F.col("e") - F.col("b") + 1)).cast("int").alias("w"))


def segments(df: DataFrame, w: int) -> DataFrame:
    """(series_id, idx, ts, seg): all full windows of w values, stride 1."""
    seg = F.collect_list("value").over(ahead(w))
    return df.withColumn("seg", seg).where(F.size("seg") == w).select("series_id", "idx", "ts", "seg")


def segments_sized(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Segments whose length is a column: sizes (series_id, w)."""
    whole = df.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("values"))
    starts = whole.join(sizes, "series_id").where(F.size("values") >= F.col("w"))
    starts = starts.select("series_id", "values", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.size("values") - F.col("w").cast("long"))).alias("idx"))
    return starts.select("series_id", "idx", F.slice("values", (F.col("idx") + 1).cast("int"), F.col("w")).alias("seg"))


def label_segments(starts: DataFrame, ranges: DataFrame, w: int) -> DataFrame:
    """(series_id, idx, label): 1 positive, -1 ignore, 0 unlabelled, for segment starts.

    A run [b, e] touches the starts b - w + 1 .. e. Positive are those between b
    and e + 1 - w, whichever is less; the rest is ignored. Later runs win.
    """
    first = F.col("e") + 1 - w
    lo, hi = F.least(first, F.col("b")), F.greatest(first, F.col("b"))
    hits = ranges.select("series_id", "range_id", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.col("b") - w + 1, F.col("e"))).alias("idx"))
    hits = hits.withColumn("label", F.when(F.col("idx").between(F.col("lo"), F.col("hi")), 1).otherwise(-1))
    hits = hits.groupBy("series_id", "idx").agg(F.max_by("label", F.col("range_id") * 2 + (F.col("label") < 0).cast("int")).alias("label"))
    return starts.select("series_id", "idx").join(hits, ["series_id", "idx"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def extract_patterns(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """(series_id, range_id, pattern): the values of each run, in order."""
    each = ranges.select("series_id", "range_id", F.explode(F.sequence("b", "e")).alias("idx"))
    got = each.join(df.select("series_id", "idx", "value"), ["series_id", "idx"])
    values = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"])
    return got.groupBy("series_id", "range_id").agg(values.alias("pattern"))


def znorm(seg: Column, flat_zero: bool = False) -> Column:
    """(x - mean) / population deviation; flat arrays stay, or become zeros."""
    n = F.size(seg)
    mean = F.aggregate(seg, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(seg, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    flat = F.transform(seg, lambda x: F.lit(0.0)) if flat_zero else seg
    return F.when(var > 1e-24, F.transform(seg, lambda x: (x - mean) / F.sqrt(var))).otherwise(flat)


def rolling_sum(df: DataFrame, w: int, col: str = "value") -> DataFrame:
    return df.withColumn("rolling", F.sum(col).over(ahead(w))).withColumn("_n", F.count(F.lit(1)).over(ahead(w))).where(F.col("_n") == w).drop("_n")


def shifted_support(df: DataFrame, w: int, col: str = "y") -> DataFrame:
    """Adds support: the rolling sum of w segment labels moved to the middle of the pattern.

    A closed form of padding, summing and shifting: for even w the sum over the
    w rows up to the row, for odd w over the rows up to the next one; zero before
    2 * (w // 2) - 1 and, for odd w, in the last row.
    """
    if w < 2:
        raise ValueError("w is 2 or more")
    frame = along().rowsBetween(-(w - 1), 0) if w % 2 == 0 else along().rowsBetween(-(w - 2), 1)
    last = F.col("idx") == F.max("idx").over(Window.partitionBy("series_id"))
    out = (F.col("idx") < 2 * (w // 2) - 1) | (last if w % 2 else F.lit(False))
    return df.withColumn("support", F.when(out, 0.0).otherwise(F.sum(F.col(col).cast("double")).over(frame)))


def centres(ranges: DataFrame) -> DataFrame:
    return ranges.select("series_id", "range_id", F.floor((F.col("b") + F.col("e")) / 2).cast("long").alias("centre"))


def keep_apart(found: DataFrame, w: int | Column, col: str = "idx", compat: bool = False) -> DataFrame:
    """Greedy rule per series: a detection stays if it is w or more after the last one that stayed.

    compat: the second detection always stays.
    """
    w = F.lit(w) if isinstance(w, int) else w

    def step(acc, x):
        stays = (F.size(acc) == 0) | (x - F.element_at(acc, -1) >= w)
        if compat:
            stays = stays | ((F.size(acc) == 1) & (x == F.element_at(F.col("_all"), 2)))
        return F.when(stays, F.concat(acc, F.array(x))).otherwise(acc)

    keys = [c for c in ("w",) if c in found.columns]
    lists = found.groupBy("series_id", *keys).agg(F.array_sort(F.collect_set(F.col(col).cast("long"))).alias("_all"))
    lists = lists.withColumn("_all", F.when(F.size("_all") > 1, F.col("_all")).otherwise(F.concat("_all", F.array(F.lit(None).cast("long")))) if compat else F.col("_all"))
    every = F.filter("_all", lambda x: x.isNotNull())
    kept = F.aggregate(every, F.array().cast("array<long>"), step)
    return lists.select("series_id", F.explode(kept).alias(col))


def on_spine(df: DataFrame, found: DataFrame, name: str, col: str = "idx", shift: int = 0) -> DataFrame:
    """Adds name: 1 at the (shifted) positions found, else 0; positions outside the series go."""
    at = found.select("series_id", (F.col(col) + shift).alias("idx")).distinct().withColumn(name, F.lit(1))
    return df.join(at, ["series_id", "idx"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def month_counter(df: DataFrame) -> DataFrame:
    step = F.when(F.lag(F.month("ts")).over(along()) != F.month("ts"), 1).otherwise(0)
    return df.withColumn("_step", step).withColumn("month", F.sum("_step").over(along())).drop("_step")


def support_with_reset(df: DataFrame, col: str = "y") -> DataFrame:
    """Adds support: the running sum of the flag, which begins anew after each 0."""
    island = F.sum(F.when(F.col(col) == 0, 1).otherwise(0)).over(along())
    by = Window.partitionBy("series_id", "_island").orderBy("idx")
    return df.withColumn("_island", island).withColumn("support", F.sum(col).over(by)).drop("_island")


def repair(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """found (series_id, idx), and all labelled centres (series_id, centre) if found has fewer."""
    a = found.groupBy("series_id").agg(F.count(F.lit(1)).alias("na"))
    short = labelled.groupBy("series_id").agg(F.count(F.lit(1)).alias("nb")).join(a, "series_id", "left").where(F.coalesce("na", F.lit(0)) < F.col("nb")).select("series_id")
    more = labelled.join(short, "series_id", "left_semi").select("series_id", F.col("centre").alias("idx"))
    return found.select("series_id", "idx").unionByName(more).distinct()


def last_event(df: DataFrame, loc: str = "loc") -> DataFrame:
    """Adds last (position of the last event, 0 before the first), gap and usage since then."""
    last = F.coalesce(F.max(F.when(F.col(loc) == 1, F.col("idx"))).over(along()), F.lit(0))
    before = Window.partitionBy("series_id", "last_before").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("last", last).withColumn("gap", F.col("idx") - F.col("last"))
    return df.withColumn("last_before", F.col("last")).withColumn("usage", F.coalesce(F.sum("value").over(before), F.lit(0.0))).drop("last_before")


def first_of_run(df: DataFrame, flag: str, name: str = "pred") -> DataFrame:
    return df.withColumn(name, F.when((F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(along()), F.lit(0)) == 0), 1).otherwise(0))


def interarrival(events: DataFrame) -> DataFrame:
    """events (series_id, idx): adds the distance to the next one; the last has none."""
    return events.withColumn("step", F.lead("idx").over(along()) - F.col("idx"))


def usage_between(df: DataFrame, loc: str = "loc") -> DataFrame:
    """(series_id, epoch, usage): sums of value from each event up to the next one."""
    epoch = F.sum(F.col(loc)).over(along())
    whole = df.withColumn("epoch", epoch).withColumn("_all", F.sum(loc).over(Window.partitionBy("series_id")))
    return whole.where((F.col("epoch") > 0) & (F.col("epoch") < F.col("_all"))).groupBy("series_id", "epoch").agg(F.sum("value").alias("usage"))
