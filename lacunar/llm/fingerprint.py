"""Canonical exact digests of documents.

The canonical form of a text is its NFKC form, case-folded, NFKC again, with
each run of white space as one blank and none at the ends. Its fingerprint is
the 128-bit xxh3 of that form in UTF-8, as 32 hex digits. Rows are grouped by
fingerprint, and in each group of two or more the canonical texts are compared
byte by byte (their least and greatest must be equal); should two texts ever
share a hash, those after the first in byte order get a suffix ``-1``, ``-2``...
The likeness of two exact digests is 1 or 0.

A null text is an empty one. A null id sorts before all ids. Rows with one id
keep an order by text; each is a document of its own.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, meet, parts, tidy

LEAST = -(1 << 63)


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return " ".join(nfkc(nfkc(text).casefold()).split())


def fingerprint(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode())


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of every row, in one narrow pass, before grouping."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.string())], ["doc_id", "fingerprint"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidy(run), "doc_id long, fingerprint string")


def collisions(texts: DataFrame) -> DataFrame:
    """(fingerprint, canon, ordinal >= 1) of different texts behind one fingerprint.

    texts: (fingerprint, canon). Least and greatest text come from partial
    aggregates, so a group of any size leaves each task as one row.
    """
    bad = texts.groupBy("fingerprint").agg(F.min("canon").alias("a"), F.max("canon").alias("z")).where("a <> z").select("fingerprint")
    from pyspark.sql import Window

    each = texts.join(bad, "fingerprint", "left_semi").distinct()
    return each.withColumn("ordinal", F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")) - 1).where("ordinal > 0")


def _splits(ids: DataFrame, n: int) -> list[int]:
    """Ids that start n ranges of about equal row counts; the first is the least id."""
    probs = [k / n for k in range(1, n)] or [0.5]
    row = ids.agg(F.min("o").alias("a"), F.percentile_approx("o", probs, 20 * n).alias("q")).first()
    return sorted({row["a"], *(row["q"] or [])}) if row["a"] is not None else [0]


def edited_pairs(df: DataFrame, text: str = "text", key: str = "doc_id", per_part_mb: float = 16.0) -> DataFrame:
    """Fingerprints of each text and of its edited form (see the query's contract).

    Texts cross the network once, compressed, dealt by ranges of ids; the first
    row of each range goes to the range before it too, so that a task that
    streams its sorted range always holds the next document.
    """
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("o"), F.col(text).alias("t"))
    n = parts(df, per_part_mb)
    splits = np.array(_splits(docs.select("o"), 8 * n), np.int64)
    count = len(splits)
    before = {int(s): (k - 1) % count for k, s in enumerate(splits)}

    def hashed(batches):
        for b in batches:
            o = b.column(0).to_numpy()
            fps = [fingerprint(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(splits, o, "right") - 1, pa.int32()), pa.array(fps, pa.string())], ["o", "bucket", "fingerprint"])

    def packed(batches):
        zip_ = zstandard.ZstdCompressor(3)
        for b in batches:
            rows = []
            for o, at, x in zip(b.column(0).to_pylist(), (np.searchsorted(splits, b.column(0).to_numpy(), "right") - 1).tolist(), b.column(1), strict=True):
                z = zip_.compress((x.as_py() or "").encode())
                rows.append((at, 0, o, 1, z))
                if o in before:
                    rows.append((before[o], 1, o, 1, z))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "guard", "o", "kind", "z"])

    prints = materialize(docs.mapInArrow(tidy(hashed), "o long, bucket int, fingerprint string"))
    shared = materialize(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    marks = meet(prints, shared, ["fingerprint"], "copies").select("bucket", F.lit(0).alias("guard"), "o", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("z"))
    texts = docs.mapInArrow(tidy(packed), "bucket int, guard int, o long, kind int, z binary")
    dealt = texts.unionByName(marks).repartition(n, "bucket").sortWithinPartitions("bucket", "guard", "o", "kind", "z")

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canon string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def paired(batches):
        unzip = zstandard.ZstdDecompressor()
        held = None  # bucket, id, text, canonical text, fingerprint, marked
        marked = None

        def pair(row, text, canon):
            _, o, t, c, fp, mark = row
            q = len(t) // 4
            e = t[: len(t) - q] + text[:q]
            ec = canonical(e)
            return (None if o == LEAST else o, len(t), hashlib.sha256(e.encode()).hexdigest(), fp, fp if ec == c else xxhash.xxh3_128_hexdigest(ec.encode()), float(ec == c), float(canon == c), c if mark else None)

        for b in batches:
            rows = []
            for bucket, guard, o, kind, z in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if kind == 0:
                    marked = (bucket, o)
                    continue
                if guard and (held is None or held[0] != bucket):
                    continue  # only the first guard is the next document
                t = unzip.decompress(z).decode()
                c = canonical(t)
                if held is not None:
                    rows.append(pair(held, t, c))
                held = None if guard else (bucket, o, t, c, xxhash.xxh3_128_hexdigest(c.encode()), marked == (bucket, o))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    found = materialize(dealt.mapInArrow(tidy(paired), schema))
    clash = collisions(found.where("canon is not null").select("fingerprint", "canon"))
    if not clash.isEmpty():
        found = found.join(clash, ["fingerprint", "canon"], "left").withColumn("fingerprint", F.concat_ws("-", "fingerprint", "ordinal"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
