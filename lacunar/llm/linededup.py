"""Line deduplication within an edit distance of one, by deletion neighbourhoods.

A line is removed if an earlier line of the corpus - smaller id, or same
document and further up - is equal to it, or if both have ``least`` characters
or more and are one edit apart. Blank lines stay. Lines are judged on the input,
so the earliest of its kind stays, and the rule needs no order of removal.

Equal lines meet by hash. For the rest, lines one edit apart share either the
first half or the second half of the shorter one, so only lines that share a
half with a different line (a grouped count, no pairs) go on, with the other
half alone. While that part is longer than ``LEAF`` characters it is halved
again in the same way, under a key that stands for all that is known to be
equal, so the work on a line is in proportion to its length. Of the part that
is left each line emits its deletion variants as hashed keys: with the position,
where equal keys mean one substitution; and without, where a variant equal to a
whole part means one insertion. Every key is reduced to its earliest line by
partial aggregates, so that a group of any size costs one row for each member,
and each (line, earliest) pair is verified: without the edit, both are equal.

Only built-in expressions are used. A null text is one empty line. A null id
sorts first. Of rows equal in id and text the first is judged as above and the
others lose all lines that are not blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, meet, parts

#: Least characters of lines that are compared within one edit.
LEAST = 20
#: Most characters of a part that emits its variants.
LEAF = 32
NO_ID = -(1 << 63)


def _filled(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _half(text: Column, base: Column, side: int, key: Column | None = None) -> tuple[Column, Column, Column]:
    """Key of the front (side 0) or back half of text, the rest of text, and how many characters come before the rest.

    base: characters of the shorter of the two texts that are to meet; key: what
    else they share. Both texts have one key, be they of base characters or one more.
    """
    p, n = F.floor(base / 2).cast("int"), F.length(text)
    half = F.substr(text, F.lit(1), p) if side == 0 else F.substr(text, n - (base - p) + 1, base - p)
    rest = F.substr(text, p + 1, n - p) if side == 0 else F.substr(text, F.lit(1), n - (base - p))
    return F.xxhash64(F.lit(side), F.lit(0) if key is None else key, base, half), rest, p if side == 0 else F.lit(0)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key another row has too."""
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    return rows.join(many, "key")


def removals(texts: DataFrame, dealt: DataFrame, least: int = LEAST) -> DataFrame:
    """(o, th, gone array of line numbers) of documents that lose lines.

    texts: (o id, th hash of text, t text); dealt: the same dealt by (o, th).
    """
    lines = texts.select("o", "th", F.posexplode(F.split("t", "\n", -1)).alias("no", "line")).where(_filled(F.col("line")))
    lines = lines.withColumn("n", F.length("line")).withColumn("at", F.struct("o", "th", "no")).withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(7), "line"))
    keys = [F.when(F.col("n") >= least, _half(F.col("line"), F.col("n") - longer, side)[0]).alias(f"k{2 * longer + side}") for longer in (0, 1) for side in (0, 1)]
    rows = materialize(lines.select("at", "h", "g", *keys))
    kinds = materialize(rows.groupBy("h", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(4))))
    again = kinds.where("times > 1").select("h", "g", "first", "times")
    equal = meet(rows, again, ["h", "g"], "times").where(F.col("at") != F.col("first")).select("at")
    close = _close(kinds, dealt)
    # a line one edit from an earlier one goes with all its copies: the first here, the others above
    return equal.unionByName(close).groupBy("at.o", "at.th").agg(F.collect_set("at.no").alias("gone"))


def _close(kinds: DataFrame, dealt: DataFrame) -> DataFrame:
    """(at) of the lines, each the first of its kind, that are one edit from an earlier one."""
    found = kinds.where("k0 is not null").select("first", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("i", "key"))
    by_doc = _shared(found).groupBy("first").agg(F.collect_set("i").alias("ways"))  # four at most
    by_doc = by_doc.groupBy(F.col("first.o").alias("o"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct(F.col("first.no").alias("no"), "ways")).alias("picked"))  # at most a document's lines
    picked = dealt.join(by_doc, ["o", "th"]).withColumn("all", F.split("t", "\n", -1)).select("o", "th", "all", F.explode("picked").alias("p"))
    picked = materialize(picked.select(F.struct("o", "th", F.col("p.no").alias("no")).alias("at"), F.element_at("all", F.col("p.no") + 1).alias("line"), "p.ways"))

    # nodes: the rest of a line that may hold the edit, after skip characters (longer: it has one more than its partner)
    names = ("key", "rest", "skip")

    def first_way(i: int) -> Column:
        made = _half(F.col("line"), F.length("line") - i // 2, i % 2)
        return F.when(F.array_contains("ways", i), F.struct(F.lit(i // 2).alias("longer"), *(x.alias(c) for c, x in zip(names, made, strict=True))))

    def next_way(side: int) -> Column:
        key, rest, skip = _half(F.col("rest"), F.col("m"), side, F.col("key"))
        return F.struct("longer", key.alias("key"), rest.alias("rest"), (F.col("skip") + skip).alias("skip"))

    def nodes(rows: DataFrame, ways: Column) -> DataFrame:
        made = rows.select("at", F.explode(ways).alias("x")).select("at", "x.longer", *(f"x.{c}" for c in names))
        return made.withColumn("m", F.length("rest") - F.col("longer"))

    left = nodes(picked, F.array_compact(F.array(*map(first_way, range(4)))))
    leaves = left.where(F.col("m") <= LEAF)
    left = left.where(F.col("m") > LEAF)
    while not left.isEmpty():  # each round halves the longest part
        left = materialize(_shared(nodes(left, F.array(next_way(0), next_way(1)))).select(*leaves.columns))
        leaves = leaves.unionByName(left.where(F.col("m") <= LEAF))
        left = left.where(F.col("m") > LEAF)

    def cut(text: str, i: Column) -> Column:
        return F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, F.length(text)))

    def role(rows: DataFrame, name: str, keys: Column) -> DataFrame:
        return rows.select("at", "skip", F.explode(keys).alias("x")).select("at", "x.key", (F.col("skip") + F.col("x.i")).alias("i"), F.lit(name).alias("role"))

    spots = lambda most: F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    keyed = lambda key, i: F.struct(key.alias("key"), i.alias("i"))
    equal, longer = leaves.where("longer = 0"), leaves.where("longer = 1")
    met = role(equal, "one", F.transform(spots(F.col("m")), lambda i: keyed(F.xxhash64("key", i, cut("rest", i), F.lit(1)), i)))
    met = met.unionByName(role(equal, "short", F.array(keyed(F.xxhash64("key", "rest", F.lit(2)), F.lit(0)))))
    met = met.unionByName(role(longer, "long", F.transform(spots(F.col("m") + 1), lambda i: keyed(F.xxhash64("key", cut("rest", i), F.lit(2)), i))))
    earliest = met.groupBy("key").agg(F.count(F.lit(1)).alias("many"), *(F.min(F.when(F.col("role") == r, F.struct("at", "i"))).alias(r) for r in ("one", "short", "long"))).where("many > 1")
    early = F.when(F.col("role") == "one", F.col("one")).when(F.col("role") == "short", F.col("long")).otherwise(F.col("short"))
    pairs = met.join(earliest, "key").withColumn("early", early).where("early.at < at").select("at", "i", "role", F.col("early.at").alias("early"), F.col("early.i").alias("j")).distinct()
    told = pairs.join(picked.select("at", "line"), "at").join(picked.select(F.col("at").alias("early"), F.col("line").alias("other")), "early")
    # the edit's place is known, so the distance is told in one pass over both lines
    one = F.when(F.col("role") == "one", cut("line", F.col("i")) == cut("other", F.col("j"))).when(F.col("role") == "long", cut("line", F.col("i")) == F.col("other"))
    return told.where(one.otherwise(F.col("line") == cut("other", F.col("j")))).select("at").distinct()


def dedup(df: DataFrame, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with text as deduplicated, and n_lines and n_removed (long), which replace columns of these names."""
    columns = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn("__line_o", F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))).withColumn("__line_th", F.xxhash64(t))  # the text itself is dealt once
    dealt = rows.repartition(parts(df, 8.0), "__line_o", "__line_th")
    named = lambda d: d.select(F.col("__line_o").alias("o"), F.col("__line_th").alias("th"), t.alias("t"))
    gone = materialize(removals(named(rows), named(dealt), least)).select(F.col("o").alias("__line_o"), F.col("th").alias("__line_th"), F.col("gone").alias("__line_gone"))
    copy = F.row_number().over(Window.partitionBy("__line_o", "__line_th").orderBy(F.lit(1)))  # rows equal in id and text
    out = dealt.join(gone, ["__line_o", "__line_th"], "left").withColumn("__line_copy", copy).withColumn("__line_all", F.split(t, "\n", -1))
    goes = lambda line, i: _filled(line) & ((F.col("__line_copy") > 1) | F.coalesce(F.array_contains("__line_gone", i), F.lit(False)))
    kept = F.when((F.col("__line_copy") > 1) | F.col("__line_gone").isNotNull(), F.filter("__line_all", lambda line, i: ~goes(line, i))).otherwise(F.col("__line_all"))
    out = out.withColumn("__line_kept", kept)
    changed = F.size("__line_kept") < F.size("__line_all")
    cleaned = F.when(changed, F.array_join("__line_kept", "\n")).otherwise(F.col(text)).alias(text)
    n_lines, n_removed = F.size("__line_all").cast("long"), (F.size("__line_all") - F.size("__line_kept")).cast("long")
    return out.select(*(cleaned if c == text else F.col(c) for c in columns), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def _sql(least: int = LEAST) -> str:
    """DuckDB: pairs that share a half, then equality of deletion variants."""
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM docs),
kinds AS (SELECT line, length(line) AS n, min((doc_id, no)) AS at FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
halves AS (
    SELECT *, n - s AS base, side, CASE WHEN side = 0 THEN substr(line, 1, (n - s) // 2) ELSE substr(line, n - (n - s - (n - s) // 2) + 1) END AS half
    FROM kinds, (VALUES (0), (1)) AS a(s), (VALUES (0), (1)) AS b(side) WHERE n >= {least}),
close AS (SELECT DISTINCT x.line FROM halves x JOIN halves y ON x.base = y.base AND x.side = y.side AND x.half = y.half AND x.line <> y.line AND y.at < x.at
    WHERE len(list_filter(range(1, greatest(x.n, y.n) + 1), lambda i:
        CASE WHEN x.n = y.n THEN substr(x.line, 1, i - 1) = substr(y.line, 1, i - 1) AND substr(x.line, i + 1) = substr(y.line, i + 1)
             WHEN x.n > y.n THEN substr(x.line, 1, i - 1) || substr(x.line, i + 1) = y.line
             ELSE substr(y.line, 1, i - 1) || substr(y.line, i + 1) = x.line END)) > 0),
judged AS (SELECT l.doc_id, l.no, l.line, coalesce((l.doc_id, l.no) <> k.at OR c.line IS NOT NULL, false) AS gone
    FROM lines l LEFT JOIN kinds k ON l.line = k.line LEFT JOIN close c ON l.line = c.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


SQL = _sql()
