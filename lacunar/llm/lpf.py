"""Removal of repeated strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier:
in a smaller id, or in the same document further up. Strings are judged on the
input; matches never cross documents.

In suffix order, the nearest entries before and after a suffix that start earlier
(previous and next smaller position) give its longest earlier match, the longest
previous factor. ``longest_previous_factor`` is that array for one buffer;
``repeated`` tells for the windows of a range which of its values reach LENGTH.

Strings meet by content. Each window of LENGTH bytes has an anchor: of the
``GRAM``-byte grams inside it the one with the least hash, so that equal windows
have equal anchors. The windows of one anchor are a run, and its bytes a context.

1. Documents are dealt over buckets, compressed. A bucket sends the distinct
   hashes of its anchors to ranges of hashes, never a row for each occurrence,
   and gets back those that occur elsewhere or twice.
2. It sends each distinct context of those anchors once, with its earliest
   place; later copies inside the bucket are marked on the spot.
3. Per range of hashes, equal contexts keep the earliest place; contexts that
   differ but share an anchor are put in suffix order, and every window whose
   longest previous factor has LENGTH bytes is marked. (Every window of a
   context that equals an earlier one has such a factor, so these are marked
   whole and kept once.)
4. The buckets join the marked places and cut them out.

A null text is empty. A null id is the least id, returned as null. Rows of one
id are ordered by a hash of their text; equal rows are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labels, parts, tidy, tidy_group, tidy_pair

LENGTH = 100
GRAM = 32
#: Bytes of text whose anchors are found at once, and MB of input in a bucket.
CHUNK = 2_000_000
BUCKET_MB = 8.0
NO_ID = -(1 << 63)

_BYTE = np.array([pow(6364136223846793005, 2 * k + 1, 1 << 64) for k in range(256)], np.uint64)
_BASE = 1099511628211


def ranks(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bytes, rank of each position by the order of so many bytes), for 1, 2, 4... up to length or more."""
    r = np.unique(data, return_inverse=True)[1].astype(np.int64) + 1
    have, n = 1, len(data)
    yield have, r
    while have < length and n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = r[have:]
        key = r * (int(r.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        r = np.empty(n, np.int64)
        r[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
        have *= 2
        yield have, r


def smaller_before(a: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, -1 where there is none.

    All values climb a tree of minima together, to the first block on their left
    that holds a smaller value, and go down to the last such value in it.
    """
    n = len(a)
    size = 1 << max(1, n - 1).bit_length()
    tree = np.full(2 * size, np.iinfo(np.int64).max)
    tree[size : size + n] = a
    k = size
    while k > 1:
        tree[k // 2 : k] = np.minimum(tree[k : 2 * k : 2], tree[k + 1 : 2 * k : 2])
        k //= 2
    node = np.arange(size, size + n)
    todo = np.arange(n)
    while len(todo):
        at = node[todo]
        found = (at & 1 == 1) & (tree[at - 1] < a[todo])
        node[todo[found]] -= 1
        todo = todo[~found]
        node[todo] >>= 1
        todo = todo[node[todo] > 1]
    node[node == 1] = 0
    todo = np.flatnonzero((node > 0) & (node < size))
    while len(todo):
        right = 2 * node[todo] + 1
        node[todo] = np.where(tree[right] < a[todo], right, right - 1)
        todo = todo[node[todo] < size]
    return np.where(node > 0, node - size, -1)


def _neighbours(order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, the nearest in suffix order before and after it that starts earlier (or -1)."""
    n = len(order)
    before, after = np.full(n, -1), np.full(n, -1)
    k = smaller_before(place[order])
    before[order] = np.where(k >= 0, order[k], -1)
    back = order[::-1]
    k = smaller_before(place[back])
    after[back] = np.where(k >= 0, back[k], -1)
    return before, after


def longest_previous_factor(data: bytes) -> np.ndarray:
    """LPF of one text: longest match of each suffix with one that starts earlier."""
    n = len(data)
    levels = list(ranks(np.frombuffer(data, np.uint8), n))
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(n)
    lpf = np.zeros(n, np.int64)
    for other in _neighbours(np.argsort(levels[-1][1], kind="stable"), place):
        match = np.zeros(n, np.int64)
        for have, r in reversed(levels):
            a, b = place + match, other + match
            inside = (other >= 0) & (np.maximum(a, b) + have <= n)
            match += have * (inside & (r[np.minimum(a, n - 1)] == r[np.clip(b, 0, n - 1)]))
        lpf = np.maximum(lpf, match)
    return lpf


def repeated(data: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows at starts have a longest previous factor of length bytes or more.

    place: rank of each window's true position in the corpus. Suffixes are put in
    order by their first bytes (length, up to a power of two); the nearest before
    and after a suffix that start earlier hold its longest earlier match, of which
    only whether it has length bytes is looked at.
    """
    for have, r in ranks(data, length):
        if have <= length:
            half, short = have, r
        order = r
    before, after = _neighbours(np.lexsort((place, order[starts])), place)
    out = np.zeros(len(starts), bool)
    tail = length - half
    for other in (before, after):
        some = np.flatnonzero(other >= 0)
        a, b = starts[some], starts[other[some]]
        out[some] |= (short[a] == short[b]) & (short[a + tail] == short[b + tail])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each run; ends: where the documents in data end."""
    n, wide = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, have = _BYTE[data], 1
    while have < gram:
        step = min(have, gram - have)
        h = h[: len(h) - step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        have += step
    h = _mix(h)
    key = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < wide:
        step = min(have, wide - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the leftmost least gram of each window
    inside = np.ones(len(at), bool)
    for e in ends[:-1].tolist():  # windows that begin before an end and reach past it
        inside[max(0, e - length + 1) : e] = False
    s = np.flatnonzero(inside)
    if not len(s):
        return np.zeros(0, np.uint64), s, s
    a = at[s]
    cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([cut[1:], [len(s)]]) - 1
    return h[a[cut]], s[cut], s[last]


class _Bucket:
    """Documents of a bucket in order of (o, tie)."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("o", "ascending"), ("th", "ascending")])
        unzip = zstandard.ZstdDecompressor()
        self.o, th = t["o"].to_numpy(), t["th"].to_numpy()
        n = len(th)
        new = np.concatenate([[True], (self.o[1:] != self.o[:-1]) | (th[1:] != th[:-1])]) if n else np.zeros(0, bool)
        i = np.arange(n)
        self.tie = (th >> 24 << 24) + i - np.maximum.accumulate(np.where(new, i, 0))
        self.texts = [unzip.decompress(z.as_py()) for z in t["z"]]

    def parts(self):
        """Index of the first document, bytes, ends of some whole documents at a time."""
        k = 0
        while k < len(self.texts):
            first, size = k, 0
            while k < len(self.texts) and (k == first or size + len(self.texts[k]) <= CHUNK):
                size += len(self.texts[k])
                k += 1
            some = self.texts[first:k]
            yield first, b"".join(some), np.cumsum([len(x) for x in some])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _range(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _grouped(r: np.ndarray):
    order = np.argsort(r, kind="stable")
    if not len(r):
        return
    cut = np.flatnonzero(np.concatenate([[True], r[order][1:] != r[order][:-1]]))
    for a, z in zip(cut, [*cut[1:], len(r)], strict=True):
        yield int(r[order[a]]), order[a:z]


_SENT = pa.schema([("r", pa.int32()), ("b", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_DUPS = pa.schema([("b", pa.int32()), ("hashes", pa.binary())])
_MADE = pa.schema([("kind", pa.int32()), ("k", pa.int32()), ("b", pa.int32()), ("blob", pa.binary())])
_MARK = pa.schema([("b", pa.int32()), ("blob", pa.binary())])
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(len(x := a.tobytes()).to_bytes(8, "little") + x for a in arrays)
    return zstandard.ZstdCompressor(1).compress(raw)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for k in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, k, n // np.dtype(k).itemsize, at + 8))
        at += 8 + n
    return out


_PLACES = (np.int64, np.int64, np.int64, np.int64)  # o, tie, start, end


def _ddl(s: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'int'}" for f in s)


def cut(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of df."""
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("o"), F.col(text).cast("binary").alias("t"))
    n = parts(df, BUCKET_MB)
    ranges = 4 * n
    bucket, range_ = labels(n), labels(ranges)  # a partition for each
    docs = docs.withColumn("th", F.xxhash64("t")).withColumn("b", F.pmod(F.xxhash64("o", "th"), F.lit(n)).cast("int"))

    def zipped(batches):
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket[b.column(0).to_numpy()]), b.column(1), b.column(2), pa.array([z.compress(x.as_py() or b"") for x in b.column(3)], pa.binary())], ["b", "o", "th", "z"])

    dealt = docs.select("b", "o", "th", "t").mapInArrow(tidy(zipped), "b int, o long, th long, z binary").repartition(n, "b")

    def send(t: pa.Table) -> pa.Table:
        b = t["b"][0].as_py()
        found = [runs(np.frombuffer(data, np.uint8), ends, length)[0] for _, data, ends in _Bucket(t).parts()]
        h, times = np.unique(np.concatenate(found), return_counts=True)
        rows = [(r, b, h[i][times[i] == 1].tobytes(), h[i][times[i] > 1].tobytes()) for r, i in _grouped(range_[_range(h, ranges)])]
        return _table(rows, _SENT)

    def meet(t: pa.Table) -> pa.Table:
        once = [np.frombuffer(x.as_py(), np.uint64) for x in t["once"]]
        twice = [np.frombuffer(x.as_py(), np.uint64) for x in t["twice"]]
        h = np.concatenate([*once, *twice])
        b = t["b"].to_numpy()
        who = np.concatenate([np.repeat(b, [len(x) for x in once]), np.repeat(b, [len(x) for x in twice])])
        sure = np.zeros(len(h), bool)
        sure[sum(map(len, once)) :] = True
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.concatenate([[False], s[1:] == s[:-1]])
        dup = sure[order] | same | np.concatenate([same[1:], [False]]) if len(s) else sure
        return _table([(k, s[dup][i].tobytes()) for k, i in _grouped(who[order][dup])], _DUPS)

    def contexts(t: pa.Table, d: pa.Table) -> pa.Table:
        if not t.num_rows or not d.num_rows:
            return _table([], _MADE)
        b, bucket = t["b"][0].as_py(), _Bucket(t)
        dups = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in d["hashes"]]))
        seen: dict[bytes, None] = {}
        first: list[list] = [[], [], [], [], []]  # hash, document, start, last window, bytes
        marks: list[list] = [[], [], []]
        for doc, data, ends in bucket.parts():
            h, a, z = runs(np.frombuffer(data, np.uint8), ends, length)
            at = np.searchsorted(dups, h)
            hit = np.flatnonzero((at < len(dups)) & (dups[np.minimum(at, len(dups) - 1)] == h))
            which = np.searchsorted(ends, a[hit], "right")
            base = np.concatenate([[0], ends[:-1]])[which]
            for g, i, s, e, k in zip(h[hit].tolist(), (which + doc).tolist(), a[hit].tolist(), z[hit].tolist(), base.tolist(), strict=True):
                c = data[s : e + length]
                if c in seen:
                    for col, v in zip(marks, (i, s - k, e - k + length), strict=True):
                        col.append(v)
                else:
                    seen[c] = None
                    for col, v in zip(first, (g, i, s - k, e - k, c), strict=True):
                        col.append(v)
        rows = []
        if marks[0]:
            i = np.array(marks[0])
            rows.append((1, b, b, _pack(bucket.o[i], bucket.tie[i], np.array(marks[1]), np.array(marks[2]))))
        h = np.array(first[0], np.uint64)
        i, s, e = (np.array(x, np.int64) for x in first[1:4])
        for r, j in _grouped(range_[_range(h, ranges)]):
            rows.append((0, r, b, _pack(h[j], bucket.o[i[j]], bucket.tie[i[j]], s[j], e[j], np.frombuffer(b"".join(first[4][x] for x in j.tolist()), np.uint8))))
        return _table(rows, _MADE)

    def judge(t: pa.Table) -> pa.Table:
        told = t.filter(pa.compute.equal(t["kind"], 1)).select(["b", "blob"])  # marks of the buckets, on their way
        t = t.filter(pa.compute.equal(t["kind"], 0))
        if not t.num_rows:
            return told
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        who = []
        for b, blob in zip(t["b"].to_pylist(), t["blob"].to_pylist(), strict=True):
            for c, x in zip(cols, _unpack(blob, np.uint64, *_PLACES, np.uint8), strict=True):
                c.append(x)
            who.append(np.full(len(cols[0][-1]), b))
        h, o, tie, s, e, data = (np.concatenate(c) for c in cols)
        who = np.concatenate(who)
        size = e - s + length
        at = np.cumsum(size) - size
        order = np.lexsort((s, tie, o))  # the corpus order of contexts
        raw, seen, whole, kept = data.tobytes(), {}, [], []
        for i in order.tolist():
            c = raw[at[i] : at[i] + size[i]]
            if c in seen:
                whole.append(i)
            else:
                seen[c] = None
                kept.append(i)
        marks = [(who[whole], o[whole], tie[whole], s[whole], e[whole] + length)]
        kept = np.array(kept, np.int64)
        kinds, inverse, times = np.unique(h[kept], return_inverse=True, return_counts=True)
        kept = kept[times[inverse] > 1]  # in corpus order: contexts that share an anchor but differ
        if len(kept):
            n = size[kept]
            here = np.cumsum(n) - n
            part = data[np.repeat(at[kept] - here, n) + np.arange(n.sum())]
            w = n - length + 1
            owner = np.repeat(np.arange(len(kept)), w)
            k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            # equal starts cannot meet in two runs of one document, so places order by context and window
            place = np.lexsort((s[kept][owner] + k, tie[kept][owner], o[kept][owner]))
            rank = np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            hit = repeated(part, here[owner] + k, rank, length)
            i, k = kept[owner[hit]], k[hit]
            if len(i):
                new = np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1] + 1)])
                f = np.flatnonzero(new)
                g = np.concatenate([f[1:], [len(i)]]) - 1
                marks.append((who[i[f]], o[i[f]], tie[i[f]], s[i[f]] + k[f], s[i[f]] + k[g] + length))
        b, *rest = (np.concatenate(x) for x in zip(*marks, strict=True))
        return pa.concat_tables([told, _table([(k, _pack(*(x[i].astype(np.int64) for x in rest))) for k, i in _grouped(b)], _MARK)])

    def finish(t: pa.Table, m: pa.Table) -> pa.Table:
        bucket = _Bucket(t)
        found = [_unpack(x.as_py(), *_PLACES) for x in m["blob"]]
        o, tie, a, z = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((a, tie, o))
        o, tie, a, z = o[order], tie[order], a[order], z[order]
        new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (tie[1:] != tie[:-1])])) if len(o) else np.zeros(0, np.int64)
        place = {(int(o[i]), int(tie[i])): (i, j) for i, j in zip(new.tolist(), [*new[1:].tolist(), len(o)], strict=True)} if len(o) else {}
        rows = []
        for k, x in enumerate(bucket.texts):
            gone = spans = 0
            digest = hashlib.sha256()
            if at := place.get((int(bucket.o[k]), int(bucket.tie[k]))):
                starts, ends = a[at[0] : at[1]], np.maximum.accumulate(z[at[0] : at[1]])
                f = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
                starts, ends = starts[f], ends[np.concatenate([f[1:], [len(ends)]]) - 1]
                gone, spans, last = int((ends - starts).sum()), len(f), 0
                for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(x[last:i])
                    last = j
                digest.update(x[last:])
            else:
                digest.update(x)
            rows.append((None if bucket.o[k] == NO_ID else int(bucket.o[k]), len(x), gone, spans, digest.hexdigest()))
        return _table(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    dups = dealt.groupBy("b").applyInArrow(tidy_group(send), _ddl(_SENT)).repartition(ranges, "r").groupBy("r").applyInArrow(tidy_group(meet), _ddl(_DUPS))
    made = dealt.groupBy("b").cogroup(dups.groupBy("b")).applyInArrow(tidy_pair(contexts), _ddl(_MADE))
    marks = made.repartition(ranges, "k").groupBy("k").applyInArrow(tidy_group(judge), _ddl(_MARK))
    return dealt.groupBy("b").cogroup(marks.groupBy("b")).applyInArrow(tidy_pair(finish), _OUT)
