"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct word shingles as 64-bit hashes; documents
with one set (128-bit hash of it) are one node from the start. Two sets link if
100 * intersection >= ``percent`` * union.

1. Tokens are ordered by the number of sets that hold them, ties by hash, so
   that common passages come last. Distinct sets are dealt over buckets by their
   hash; a bucket sends each of its tokens once, as 32 bits within one of many
   ranges, and gets back those that other sets hold too, with their number. (Two
   tokens of one code count as one here, which only costs order.)
2. Linked sets share a token among the first |x| - ceil(percent * |x|) + 1 of
   each. Prefix tokens that two sets share make both candidates.
3. Candidates are partitioned into groups of about ``GROUP`` tokens: a set joins the
   group of its most shared prefix token and of its size, so that similar sets
   come together. The token-group matrix says which groups hold a prefix token. Sets
   x and y that link share o = ceil(percent (|x| + |y|) / (100 + percent))
   tokens, hence o - ceil(percent max(|x|, |y|)) + 1 of their prefixes; a set is
   a query of the groups that hold as many of its prefix tokens as any of the
   group's sizes needs.
4. A task per group (queries dealt further if there are many) stores the union
   of its members' tokens. A query that has fewer tokens in the union than any
   link needs does not open the group; the others are counted against all
   members at once, exactly, and a forest of the links found is kept.
5. Components of the links give each document's component_id.

A null text, or one without words, has an empty set and links with nothing. A
text of fewer words than a shingle is one shingle. Rows that repeat have one
set, rows of one id are one node; a null id counts as the least id and is
returned as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import labels, materialize, meet, parts, small_batches, tidy, tidy_group, tidy_pair
from .components import components
from .lpf import _ddl, _grouped, _pack, _table, _unpack

#: Tokens of all members of a group, about.
GROUP = 1 << 20
QUERIES = 2048
#: Size classes for each factor e of the set size.
BANDS = 50
NO_ID = -(1 << 63)

_P = np.uint64(1099511628211)
_BYTE = np.array([pow(6364136223846793005, 2 * k + 3, 1 << 64) for k in range(256)], np.uint64)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_POW = np.array([pow(1099511628211, k, 1 << 64) for k in range(256)], np.uint64)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of n lower-cased words."""
    data = _FOLD[np.frombuffer(text, np.uint8)]
    blank = _BLANK[data]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(data) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.uint64)
    at = np.arange(first[0], len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    part = data[first[0] :]
    powers = _POW[at & 255]
    if at.max() > 255:  # bytes past the 256th of a word, alone: other words keep their hash
        far = np.flatnonzero((at > 255) & ~blank[first[0] :])
        powers[far] *= _mix(at[far].astype(np.uint64) >> np.uint64(8) | np.uint64(1 << 60))
    h = np.where(blank[first[0] :], np.uint64(0), _BYTE[part] * powers)
    w = _mix(np.add.reduceat(h, first - first[0]))
    k = min(n, len(w))
    s = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        s = (s ^ w[j : len(w) - k + 1 + j]) * _P + np.uint64(j + 1)
    return np.unique(_mix(s + np.uint64(k)))


def _needed(n: int, percent: int) -> int:
    """Least size of the intersection with any set that links with one of n tokens."""
    return -(-percent * n // 100)


BUCKET_MB = 8.0
_SENT = pa.schema([("r", pa.int32()), ("b", pa.int32()), ("blob", pa.binary())])
_BACK = pa.schema([("b", pa.int32()), ("r", pa.int32()), ("blob", pa.binary())])
_MADE = "kind int, token long, h1 long, h2 long, n int, z binary"


def _digest(s: np.ndarray) -> tuple[int, int]:
    a, z = np.frombuffer(xxhash.xxh3_128(s.tobytes()).digest(), np.int64).tolist()
    return a, z


def _codes(tokens: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and code of each token."""
    return ((tokens >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32), tokens.astype(np.uint32)


class _Sets:
    """The distinct sets of a bucket, each made from its text when it is asked for."""

    def __init__(self, t: pa.Table, n: int):
        self.n, self.unzip, seen = n, zstandard.ZstdDecompressor(), {}
        for a, c, z in zip(t["h1"].to_pylist(), t["h2"].to_pylist(), t["z"].to_pylist(), strict=True):
            seen.setdefault((a, c), z)
        self.ids = sorted(seen)
        self.zips = [seen[i] for i in self.ids]

    def __iter__(self):
        return (shingle_set(self.unzip.decompress(z), self.n) for z in self.zips)


def _send(n: int, ranges: int):
    def run(t: pa.Table) -> pa.Table:
        tokens = np.concatenate(list(_Sets(t, n)))
        tokens.sort()
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        times = np.diff(np.append(first, len(tokens))).astype(np.uint32)
        r, code = _codes(tokens[first], ranges)
        del tokens, first
        rows = []
        for k, i in _grouped(r):
            order = i[np.lexsort((code[i], times[i]))]
            c, m = code[order], times[order]
            once = int(np.searchsorted(m, 2))
            rows.append((k, t["b"][0].as_py(), _pack(np.diff(c[:once], prepend=np.uint32(0)), c[once:], m[once:])))
        return _table(rows, _SENT)

    return run


def _meet(t: pa.Table) -> pa.Table:
    codes, times, who = [], [], []
    for b, blob in zip(t["b"].to_pylist(), t["blob"].to_pylist(), strict=True):
        once, c, m = _unpack(blob, np.uint32, np.uint32, np.uint32)
        codes += [np.cumsum(once, dtype=np.uint32), c]
        times += [np.ones(len(once), np.int64), m.astype(np.int64)]
        who.append(np.full(len(once) + len(c), b))
    codes, times, who = (np.concatenate(x) for x in (codes, times, who))
    order = np.argsort(codes, kind="stable")
    c, b = codes[order], who[order]
    cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    total = np.repeat(np.add.reduceat(times[order], cut), np.diff(np.append(cut, len(c)))) if len(c) else times
    shared = np.flatnonzero(total > 1)
    r = t["r"][0].as_py()
    return _table([(k, r, _pack(c[shared[i]], total[shared[i]].astype(np.uint32))) for k, i in _grouped(b[shared])], _BACK)


def _prefixes(n: int, percent: int, ranges: int):
    """Shared prefix tokens of the distinct sets of a bucket, and the texts of sets that have any."""

    def run(t: pa.Table, d: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in _MADE.split(", ")]
        empty = pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        if not t.num_rows or not d.num_rows:
            return empty
        found = [(np.uint64(r), *_unpack(x, np.uint32, np.uint32)) for r, x in zip(d["r"].to_pylist(), d["blob"].to_pylist(), strict=True)]
        key = np.concatenate([r << np.uint64(32) | c.astype(np.uint64) for r, c, _ in found])
        held = np.concatenate([m for _, _, m in found])
        order = np.argsort(key)
        key, held = key[order], held[order]
        here, out = _Sets(t, n), [empty]
        for (h1, h2), z, s in zip(here.ids, here.zips, here, strict=True):
            r, code = _codes(s, ranges)
            k = r.astype(np.uint64) << np.uint64(32) | code
            at = np.minimum(np.searchsorted(key, k), len(key) - 1)
            rank = np.where(key[at] == k, held[at], 0)
            p = len(s) - _needed(len(s), percent) + 1
            first = np.argsort(rank, kind="stable")[:p]
            tokens = s[first[rank[first] > 0]].view(np.int64)
            if m := len(tokens):
                ids = [np.full(m + 1, x) for x in (h1, h2)]
                out.append(pa.Table.from_arrays([pa.array([0] * m + [1], pa.int32()), pa.array([*tokens.tolist(), None], pa.int64()), *map(pa.array, ids), pa.array(np.full(m + 1, len(s)), pa.int32()), pa.array([None] * m + [z], pa.binary())], names))
        return pa.concat_tables(out).combine_chunks()

    return run


def _open(n: int, percent: int):
    """Rows (g, part, query, o, z) sorted by group, part and role: links (a, b) of each."""

    class Group:
        def __init__(self, members: list[tuple[int, np.ndarray]]):
            tokens = np.concatenate([s for _, s in members])
            order = np.argsort(tokens, kind="stable")
            self.owner = np.repeat(np.arange(len(members)), [len(s) for _, s in members])[order]
            self.union, self.start = np.unique(tokens[order], return_index=True)
            self.end = np.append(self.start[1:], len(tokens))
            self.ids = np.array([o for o, _ in members])
            self.sizes = np.array([len(s) for _, s in members])
            self.root: dict[int, int] = {}

        def find(self, x: int) -> int:
            root = self.root
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def links(self, o: int, s: np.ndarray):
            at = np.searchsorted(self.union, s)
            at = at[self.union[np.minimum(at, len(self.union) - 1)] == s]
            if len(at) < _needed(len(s), percent):
                return  # the bound: no member can link
            size = self.end[at] - self.start[at]
            where = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = np.bincount(self.owner[where], minlength=len(self.ids))
            for k in np.flatnonzero(100 * both >= percent * (self.sizes + len(s) - both)):
                a, b = self.find(o), self.find(int(self.ids[k]))
                if a != b:
                    self.root[a] = b
                    yield o, int(self.ids[k])

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)

        unzip = zstandard.ZstdDecompressor()
        out: list[tuple[int, int]] = []
        key, members, group = None, [], None
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        for g, part, query, o, z in rows():  # members come before the queries
            if (g, part) != key:
                key, members, group = (g, part), [], None
            s = shingle_set(unzip.decompress(z), n)
            if not query:
                members.append((o, s))
                continue
            if group is None and members:
                group = Group(members)
            if group is not None:
                out.extend(group.links(o, s))
            if len(out) >= 10_000:
                yield batch()
                out = []
        yield batch()

    return run


def _met(posted: DataFrame, home: DataFrame, percent: int) -> DataFrame:
    """(h1, h2, n, times, to, needed): a prefix token of a set and a group that holds it too.

    posted: the sets' prefix tokens (h1, h2, n, token, times); home: the groups of
    sets (h1, h2, n, g). A set and a group share at most the tokens of each that
    any other holds. Where that, or the sizes, already rule out a link, their shared
    tokens do not meet, so that tokens shared by chance make no rows.
    """
    ids = ["h1", "h2"]
    sizes = home.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    own = posted.groupBy(*ids).agg(F.sum("times").alias("most_x"))
    seated = posted.join(home.select(*ids, "g"), ids)
    matrix = seated.groupBy("token", "g").agg(F.count(F.lit(1)).alias("held"), F.max("times").alias("t"))
    most = matrix.groupBy("g").agg(F.sum("t").alias("most_y"))
    matrix = matrix.join(sizes.join(most, "g"), "g").select("token", F.col("g").alias("to"), "held", "lo", "hi", "most_y")
    least = F.greatest(F.col("lo"), F.ceil(F.col("n") * percent / 100.0))
    most = F.least(F.col("hi"), F.floor(F.col("n") * 100.0 / percent))
    both = lambda y: F.ceil((F.col("n") + y) * percent / (100.0 + percent)) - F.ceil(F.greatest(F.col("n").cast("long"), y) * percent / 100.0)
    needed = F.least(both(least) + 1, both(most))
    pairs = seated.join(own, ids).join(matrix, "token").where("g <> to or held > 1").where(least <= most).where(F.least("most_x", "most_y") >= needed)
    return pairs.select(*ids, "n", "times", "to", needed.alias("needed"))


def _asked(posted: DataFrame, home: DataFrame, percent: int) -> DataFrame:
    """The queries (h1, h2, n, g) of each group, by the token-group matrix."""
    ids = ["h1", "h2"]
    return _met(posted, home, percent).groupBy(*ids, "n", "to").agg(F.sum("times").alias("both"), F.first("needed").alias("needed")).where("both >= needed").select(*ids, "n", F.col("to").alias("g"))


def join(df: DataFrame, n: int = 3, percent: int = 90, text: str = "text", key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of df."""
    small_batches(df.sparkSession)
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("o"), F.col(text).cast("binary").alias("t"))
    buckets = parts(df, BUCKET_MB)
    ranges = 4 * buckets
    bucket = labels(buckets)  # a partition for each

    def describe(batches):
        for b in batches:
            sets = [shingle_set(x.as_py() or b"", n) for x in b.column(1)]
            h = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in h], pa.int64()), pa.array([x for _, x in h], pa.int64())], ["o", "n", "h1", "h2"])

    def zipped(batches):
        z, seen = zstandard.ZstdCompressor(3), set()
        for batch in batches:
            rows = []
            for x in batch.column(0):
                t = x.as_py() or b""
                s = shingle_set(t, n)
                if len(s) and (h := _digest(s)) not in seen:  # copies in one task go once
                    if len(seen) < 1_000_000:
                        seen.add(h)
                    rows.append((int(bucket[h[0] % buckets]), *h, z.compress(t)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["b", "h1", "h2", "z"])

    ids = ["h1", "h2"]
    nodes = materialize(docs.mapInArrow(tidy(describe), "o long, n long, h1 long, h2 long"))
    dealt = docs.select("t").mapInArrow(tidy(zipped), "b int, h1 long, h2 long, z binary").repartition(buckets, "b")
    back = dealt.groupBy("b").applyInArrow(tidy_group(_send(n, ranges)), _ddl(_SENT)).repartition(ranges, "r").groupBy("r").applyInArrow(tidy_group(_meet), _ddl(_BACK))
    made = materialize(dealt.groupBy("b").cogroup(back.groupBy("b")).applyInArrow(tidy_pair(_prefixes(n, percent, ranges)), _MADE))
    held = made.where("kind = 0").select("token", *ids, "n")  # a set has a token once
    alike = held.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64(*ids)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *ids)).alias("y")).where("m > 1")
    # tokens with the very same sets say the same: one of them stays, with their number
    alike = alike.groupBy("m", "x", "y").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("times")).select("token", "times", "m")
    posted = materialize(meet(held, materialize(alike), ["token"], "m"))

    home = posted.groupBy(*ids, "n").agg(F.max(F.struct("m", "token"))["token"].alias("g")).withColumn("g", F.xxhash64("g", F.floor(F.log("n") * BANDS)))
    crowd = home.groupBy("g").agg(F.sum("n").alias("c"))
    home = materialize(home.join(crowd, "g").select(*ids, "n", F.xxhash64("g", F.pmod(F.xxhash64(*ids), F.ceil(F.col("c") / group))).alias("g")))
    ask = materialize(_asked(posted, home, percent).select(*ids, "g"))

    crowd = ask.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("c"))
    asking = ask.join(crowd, "g").select("g", F.pmod(F.xxhash64(*ids), F.col("c")).alias("part"), F.lit(1).alias("query"), *ids)
    living = home.join(crowd, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("part"), F.lit(0).alias("query"), *ids)
    first = nodes.where("n > 0").groupBy(*ids).agg(F.min("o").alias("node"), F.count(F.lit(1)).alias("rows"))
    seats = asking.unionByName(living).join(first, ids).join(made.where("kind = 1").select(*ids, "z"), ids)
    dealt = seats.select("g", "part", "query", F.col("node").alias("o"), "z").repartition(parts(df, 16.0), "g", "part").sortWithinPartitions("g", "part", "query", "o")
    edges = dealt.mapInArrow(tidy(_open(n, percent)), "a long, b long")

    known = nodes.where("n > 0").where(F.col("o") != NO_ID)
    several = known.groupBy("o").agg(F.min(F.struct(*ids)).alias("x"), F.max(F.struct(*ids)).alias("y")).where("x <> y").select("o")
    if not several.isEmpty():  # an id joins the nodes of its sets
        own = known.select("o", *ids).distinct().join(several, "o").join(first, ids)
        edges = edges.unionByName(own.select(F.col("o").alias("a"), F.col("node").alias("b")))

    found = components(edges).withColumnRenamed("node", "_node")
    classes = first.join(found, F.col("node") == F.col("_node"), "left").select(*ids, "rows", F.coalesce("component", "node").alias("least"))
    named = meet(nodes.where("n > 0"), materialize(classes), ids, "rows").select("o", "n", "least")
    named = named.unionByName(nodes.where("n = 0").select("o", "n", F.col("o").alias("least")))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return named.select(shown("o").alias("doc_id"), F.col("n").alias("n_shingles"), shown("least").alias("component_id"))


def one_of_each(df: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df that are the first of their component, by id, then a hash of the text.

    Rows equal in id and text are one document, of which one stays. Rows of one
    id and different texts are documents of their own. Rows without an id have
    nothing to be told apart by and stay.
    """
    rows = df.where(F.col(key).isNotNull()).withColumn("__near_th", F.xxhash64(F.col(text))).withColumn("__near_id", F.col(key).cast("long"))
    texts = rows.groupBy("__near_id").agg(F.min("__near_th").alias("a"), F.max("__near_th").alias("z"))
    if not texts.where("a <> z").isEmpty():  # ids do not tell texts apart: number them in order
        order = rows.select("__near_id", "__near_th").distinct().repartitionByRange("__near_id").sortWithinPartitions("__near_id", "__near_th")
        order = materialize(order.withColumn("__near_no", F.monotonically_increasing_id()))
        rows = rows.join(order, ["__near_id", "__near_th"]).drop("__near_id").withColumnRenamed("__near_no", "__near_id")
    found = join(rows, n, percent, text, "__near_id")
    stays = found.where("doc_id = component_id").select(F.col("doc_id").alias("__near_stays")).distinct()
    kept = rows.join(stays, F.col("__near_id") == F.col("__near_stays"))
    kept = kept.withColumn("__near_row", F.row_number().over(Window.partitionBy("__near_id").orderBy("__near_th"))).where("__near_row = 1")
    return kept.select(*df.columns).unionByName(df.where(F.col(key).isNull()))
