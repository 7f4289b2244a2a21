"""Best-fit packing of tokenised documents, certified by bounds.

Documents become pieces of at most ``size`` tokens (``pieces``). ``pack`` runs one
best-fit decreasing over all of them: pieces of one length are alike, so their
number by length gives the whole packing (``plan``), as ranges of bins that take
the same. Pieces are then ranked within their length, bucket by bucket, and look
up their bin. Lower bounds from dual feasible functions (``bound``) tell from the
same numbers how far from the fewest bins the packing can be.

A null text is an empty document: one piece that holds only the end id. Rows
that repeat are documents of their own.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunked, materialize, small_batches, tidy, tidy_pair

SIZE = 2048
#: Pieces that one task places, about.
PARTITION = 40_000
#: Bytes of text tokenised at once; the lower-cased words, and words as written,
#: that a worker remembers: the first it meets, which are the frequent ones.
CHUNK = 4_000_000
KNOWN, SEEN = 300_000, 150_000
#: Of the words as written, so many stay from one task to the next; of the lower-cased ones KNOWN.
KEPT = 100_000


class Words:
    """Token ids by word for a tokenizer that never joins across white space.

    A batch is cut at ASCII white space, its distinct words are tokenised once
    and their ids gathered by index. Lower-cased runs of letters are looked up
    without the stop or comma after them, which is a word of its own there.
    """

    def __init__(self, path: str, end: int = 0):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end = np.array([end], "<u4").tobytes()
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for t, i in vocab.items():
            self.closes[i] = t.endswith("</w>")
        self.seen: dict[str, bytes] = {}  # as written
        self.known: dict[str, bytes] = {}  # lower-cased runs of letters
        self.dot = {p: self._one([p])[0] for p in ".,"}

    def _one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of runs of letters: many in one call, cut after each closing token."""
        out: dict[str, bytes] = {}
        for k in range(0, len(stems), 1000):
            some = stems[k : k + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) == len(some):
                data, a = ids.tobytes(), 0
                for s, z in zip(some, cuts.tolist(), strict=True):
                    out[s] = data[4 * a : 4 * z]
                    a = z
            else:
                out.update(zip(some, self._one(some), strict=True))
        return out

    def forget(self) -> None:
        """Keeps the first words of each kind for the worker's next task."""
        self.known = dict(islice(self.known.items(), KNOWN))
        self.seen = dict(islice(self.seen.items(), KEPT))

    def ids(self, words: list[str]) -> list[bytes]:
        seen = self.seen
        out = [seen.get(w) for w in words]
        new = [w for w, x in zip(words, out, strict=True) if x is None]
        if new:
            found = dict(zip(new, self._new(new), strict=True))
            if len(seen) < SEEN:
                seen.update(found)
            out = [found[w] if x is None else x for w, x in zip(words, out, strict=True)]
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        known, dot, stems = self.known, self.dot, []
        for w in words:
            s = w[:-1] if w[-1] in dot and len(w) > 1 else w
            if not s.isalpha():
                s = None
            else:
                s = s.lower()
                # the tokenizer lower-cases letter by letter, without final sigma
                if not s.isascii() and ("\u03c2" in s or not s.isalpha()):
                    s = None
            stems.append(s)
        fresh = self._learn(list(dict.fromkeys(s for s in stems if s is not None and s not in known)))
        if len(known) < KNOWN:
            known.update(fresh)
        elif fresh:
            known = {s: known[s] for s in stems if s in known} | fresh
        odd = [w for w, s in zip(words, stems, strict=True) if s is None]
        odd = dict(zip(odd, self._one(odd), strict=True))
        return [odd[w] if s is None else known[s] if w[-1] not in dot else known[s] + dot[w[-1]] for w, s in zip(words, stems, strict=True)]

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text's begin and end."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = (data == 32) | (data >= 9) & (data <= 13)
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[~space])).dictionary_encode()
        flat = [*self.ids(words.dictionary.to_pylist()), self.end]
        at = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        index = np.insert(words.indices.to_numpy(zero_copy_only=False), at, len(flat) - 1)
        sizes = np.array([len(x) // 4 for x in flat], np.int32)
        pool = np.frombuffer(b"".join(flat), "<u4")
        n = sizes[index]
        upto = np.cumsum(n, dtype=np.int32)
        where = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[index] - upto + n, n)
        where += np.arange(len(where), dtype=np.int32)
        return pool[where], np.concatenate([[0], upto[at + np.arange(len(texts))]])


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The worker's own Words; a task forgets most words at its end, so that idle workers stay small."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """The pieces of every whole text, in one narrow pass. tokenizer: a file's path."""
    small_batches(df.sparkSession)

    def run(batches):
        words = words_of(tokenizer)
        try:
            for b in batches:
                keys, rows, k = b.column(0).to_pylist(), [], 0
                for part in chunked((x.as_py() or b"" for x in b.column(1)), CHUNK):
                    ids, at = words.documents(part)
                    data = memoryview(ids.astype("<u4").tobytes())
                    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        for p, s in enumerate(range(a, z, size)):
                            e = min(z, s + size)
                            rows.append((keys[k], p, s - a, e - s, zlib.crc32(data[4 * s : 4 * e])))
                        k += 1
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        finally:
            words.forget()

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(tidy(run), PIECES)


def bound(counts: np.ndarray, size: int = SIZE) -> int:
    """Least number of bins by dual feasible functions; counts[n]: pieces of n tokens."""
    n = np.flatnonzero(counts)
    c = counts[n].astype(np.int64)
    if not len(n):
        return 0
    best = -(-int((n * c).sum()) // size)
    for low in range(1, size // 2 + 1):  # pieces over size - low fill a bin, those under low vanish
        f = np.where(n > size - low, size, np.where(n < low, 0, n))
        best = max(best, -(-int((f * c).sum()) // size))
    for k in range(1, 33):  # rounds down to k-ths of a bin, whole (k + 1)-ths stay
        whole = (k + 1) * n % size == 0
        f = np.where(whole, k * n, (k + 1) * n // size * size)
        best = max(best, -(-int((f * c).sum()) // (size * k)))
    return best


def best_fit(lengths: list[int], size: int = SIZE) -> tuple[list[int], int]:
    """The bin of each piece, longest first into the fullest bin that has room; number of bins."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    room: list[list[int]] = [[] for _ in range(size + 1)]
    free, bins, out = 0, 0, [0] * len(lengths)
    for i in order:
        n = lengths[i]
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b = size, bins
            bins += 1
        out[i] = b
        r -= n
        if r:
            if not room[r]:
                free |= 1 << r
            room[r].append(b)
    return out, bins


def plan(counts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over all pieces; counts[n]: pieces of n tokens.

    Rows (length, rank, times, bin, offset) by length and rank: the pieces of that
    length from that rank on go, so many a bin, to the bins from that one on, at
    that offset. Each length cuts at most two ranges of bins, so the rows depend
    on size, not on the number of pieces. Also the number of bins.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # (first bin, bins) that have so much left
    free, bins, out = 0, 0, []

    def put(r: int, b: int, m: int) -> None:
        nonlocal free
        if r and m:
            free |= 1 << r
            room[r].append((b, m))

    for n in np.flatnonzero(counts)[::-1].tolist():
        rank, left = 0, int(counts[n])
        while left:
            fits = free >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                b, m = room[r].pop()
                if not room[r]:
                    free ^= 1 << r
            else:
                r, b, m = size, bins, -(-left // (size // n))
                bins += m
            # a bin that took one has the least room that fits: it takes all it can
            for q, k in ((r // n, min(m, left // (r // n))), (left % (r // n), 1)):
                if q and k and m and left >= q * k:
                    out.append((n, rank, q, b, size - r))
                    put(r - q * n, b, k)
                    rank, left, b, m = rank + q * k, left - q * k, b + k, m - k
            put(r, b, m)
    return np.array(sorted(out), np.int64).reshape(-1, 5), bins


_PACKED = PIECES + ", sequence_id long, offset long"


def _place(rows: np.ndarray, size: int):
    """A bucket's pieces, with their bin; and how many of each length the buckets before it hold."""
    names = [x.split()[0] for x in _PACKED.split(", ")]
    key = rows[:, 0] << 40 | rows[:, 1]

    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        t = t.sort_by([(k, "ascending") for k in ("length", "doc_id", "piece", "ids_crc32", "start")])
        before = np.zeros(size + 1, np.int64)
        before[c["length"].to_numpy()] = c["before"].to_numpy()
        n = t["length"].to_numpy()
        rank = before[n] + np.arange(len(n)) - np.searchsorted(n, n)
        _, first, times, b, offset = rows[np.searchsorted(key, n << 40 | rank, "right") - 1].T
        at = rank - first
        t = t.append_column("sequence_id", pa.array(b + at // times)).append_column("offset", pa.array(offset + at % times * n))
        return t.select(names).combine_chunks()

    return run


def pack(found: DataFrame, size: int = SIZE, partition: int = PARTITION) -> DataFrame:
    """Adds sequence_id and offset to the pieces of found (columns PIECES)."""
    found = materialize(found)
    hist = np.zeros(size + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # size rows at most
        hist[r["length"]] = r["count"]
    rows, _ = plan(hist, size)
    parts = max(1, round(int(hist.sum()) / partition))
    dealt = found.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    held = dealt.groupBy("b", "length").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("b"))  # a row for each bucket
    held = materialize(held.select("b", "length", (upto - F.col("n")).alias("before")))  # written, so that both sides are dealt anew by b
    return dealt.groupBy("b").cogroup(held.groupBy("b")).applyInArrow(tidy_pair(_place(rows, size)), _PACKED)
