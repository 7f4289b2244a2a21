"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target: its share, by weight, of ``total`` times all words,
but at most ``most`` times its own words; what is above is shared again by
weight. Within a source, documents are included unequally: the expected copies
of a document are target / words of its source, times a tilt that rises with
its size class (powers of two of the size) from 1 - TILT to 1 + TILT at most,
less where more than ``most`` copies would be expected. With F the share of the
source's words in smaller classes and half of its own class, the tilt
1 + TILT * (2 F - 1) leaves the expected words of the source at its target.

The whole part of the expected copies is allocated for certain. The rest of the
target is filled by a Pareto order sample of fixed size in words: documents are
ranked by the odds of a uniform number, fixed by the document's id and the
seed, over the odds of the fraction that is left of their expected copies, and
taken in that order until the words taken come nearest to the target.

Only built-in expressions are used. A source's order is cut first by ranges of
the logarithm of the rank, then by finer ranges of the one range in which the
target is met, so that no task ever sorts a whole source.

A null text has no words; such documents are of the least class. A null source
is a source of its own, last in the order. Rows that repeat are documents of
their own; ties go by id, then size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TILT = 0.5
#: Ranges of the rank's logarithm: so many to a unit, each cut into so many. The
#: logarithm of the odds of a uniform number has a density of a quarter at most.
COARSE, FINE = 16, 1024
#: Up to so many sources, their table (about 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 2_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)


def targets(sizes: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, size); one row for each source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("source")
    level = (F.sum("source_size").over(everything) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        by.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("level", level)
        .withColumn("target", F.when(F.col("cap") <= F.col("level") * F.col("weight"), F.col("cap")))
        .withColumn("first", F.max(F.when(F.col("target").isNull(), F.col("level"))).over(everything))
        .select("source", "source_size", F.coalesce("target", F.col("first") * F.col("weight")).alias("target"))
    )


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row, and the columns in keep."""
    whole_rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    whole_rows = whole_rows.withColumn("class", F.length(F.bin("size")))
    sized = materialize(whole_rows.drop(*(f"__keep_{c}" for c in keep)))
    classes = materialize(sized.groupBy("source", "class").agg(F.sum("size").alias("size")))
    sources = materialize(targets(classes, weights, total, most))
    small = sources.count() <= BROADCAST_SOURCES

    def at(rows: DataFrame, table: DataFrame, *more: str, how: str = "inner") -> DataFrame:
        """rows with the columns of table, which has a row for each source (and class)."""
        named = table.withColumnsRenamed({c: f"_{c}" for c in ("source", *more)})
        same = F.col("source").eqNullSafe(F.col("_source"))
        for c in more:
            same &= F.col(c) == F.col(f"_{c}")
        return rows.join(F.broadcast(named) if small else named, same, how).drop("_source", *(f"_{c}" for c in more))

    plan = materialize(_expected(at(classes, sources), most))

    def ranked(rows: DataFrame) -> DataFrame:
        rows = at(rows, plan, "class").withColumn("u", uniform(F.col("doc_id"), seed))
        rows = rows.withColumn("rank", F.when(F.col("part") > 0, _odds(F.col("u")) / _odds(F.col("part"))))
        rows = rows.withColumn("tie", F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size"))
        return rows.withColumn("coarse", F.floor(F.log("rank") * COARSE)).withColumn("fine", F.floor(F.log("rank") * (COARSE * FINE)))

    def met(some: DataFrame, by: str, edge: str, base: str) -> DataFrame:
        """The range in which the target is met, and the words before it; a row for each source."""
        upto = Window.partitionBy("source").orderBy(by)  # a row for each range that has documents
        sums = some.groupBy("source", by).agg(F.sum("size").alias("size"), F.first("wanted").alias("wanted"), F.first("base").alias("base"))
        sums = sums.withColumn("before", F.col("base") + F.sum("size").over(upto) - F.col("size")).where("before <= wanted")
        return materialize(sums.groupBy("source").agg(F.max(by).alias(edge), F.max_by("before", by).alias(base)))

    rows = ranked(sized).where("rank is not null")
    first = met(rows.withColumn("base", F.lit(0).cast("long")), "coarse", "edge", "base")
    rows = at(rows, first).where("coarse = edge")
    last = met(rows, "fine", "last", "before")
    rows = at(rows, last).where("fine = last")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("tie"))  # the documents of one fine range
    cut = rows.withColumn("upto", F.col("before") + upto).where(F.col("upto") - F.col("size") / 2 <= F.col("wanted"))
    cut = materialize(cut.groupBy("source").agg(F.max("tie").alias("cut")))

    out = at(at(ranked(whole_rows if keep else sized), last, how="left"), cut, how="left")
    more = F.coalesce(F.col("fine") < F.col("last"), F.lit(False)) | F.coalesce(F.col("tie") <= F.col("cut"), F.lit(False))
    out = out.withColumn("copies", F.col("whole") + F.when(F.col("rank").isNotNull() & more, 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies", *(F.col(f"__keep_{c}").alias(c) for c in keep))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _expected(classes: DataFrame, most: float) -> DataFrame:
    """Copies that a document of each (source, class) gets for certain, odds of one more, words still wanted."""
    smaller = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # some dozen classes
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = (2 * F.coalesce(F.sum("size").over(smaller), F.lit(0)) + F.col("size")).cast("double") / F.nullif("source_size", F.lit(0)) - 1
    lean = F.least(F.lit(TILT), F.lit(most) / F.nullif("ratio", F.lit(0.0)) - 1)
    found = classes.withColumn("ratio", ratio).withColumn("share", share).withColumn("lean", lean)
    found = found.withColumn("expected", F.when(F.col("ratio") > 0, F.least(F.col("ratio") * (1 + F.col("lean") * F.col("share")), F.lit(most))).otherwise(0.0))
    found = found.withColumn("whole", F.floor("expected").cast("long")).withColumn("part", F.col("expected") - F.col("whole"))
    certain = F.sum(F.col("whole") * F.col("size")).over(Window.partitionBy("source"))
    return found.withColumn("wanted", F.col("target") - certain).select("source", "class", "source_size", "target", "whole", "part", "wanted")


SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM by_source),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap
    ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target FROM levels),
classes AS (SELECT source, length(bin(size)) AS class, sum(size)::BIGINT AS size FROM sized GROUP BY ALL),
leans AS (SELECT c.source, c.class, c.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS ratio,
    (2 * coalesce(sum(c.size) OVER (PARTITION BY c.source ORDER BY c.class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c.size)::DOUBLE / nullif(t.source_size, 0) - 1.0::DOUBLE AS share
    FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
expected AS (SELECT *, CASE WHEN ratio > 0 THEN least(ratio * (1.0::DOUBLE + least(0.5::DOUBLE, 2.0::DOUBLE / nullif(ratio, 0) - 1.0::DOUBLE) * share), 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS expected FROM leans),
plan AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS part, target - sum(floor(expected)::BIGINT * size) OVER (PARTITION BY source) AS wanted FROM expected),
ranked AS (SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.part, p.wanted,
    (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source AND length(bin(s.size)) = p.class),
run AS (SELECT *, part > 0 AND sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source
    ORDER BY part > 0 DESC, CASE WHEN part > 0 THEN (u / (1.0::DOUBLE - u)) / (part / (1.0::DOUBLE - part)) END, doc_id NULLS FIRST, size) - size / 2.0::DOUBLE <= wanted AS more FROM ranked)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * (whole + CASE WHEN more THEN 1 ELSE 0 END) AS taken,
    whole + CASE WHEN more THEN 1 ELSE 0 END AS copies FROM run
"""
