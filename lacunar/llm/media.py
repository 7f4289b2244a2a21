"""AVI motion-JPEG columns: lossless intra frames, RIFF indexes, shots.

``encode`` stores bytes as an AVI file whose video stream holds lossless JPEG
frames (process 14 of ITU-T T.81: SOF3, predictor 1, 8-bit samples). The
Huffman table gives category s a code of 9 - s bits, so that code and extra
bits take 9 bits for every sample. Such a stream is ordinary lossless JPEG and
yet needs no bit-serial decoding: NumPy unpacks all samples of a frame at once.
``decode_frame`` follows other Huffman tables bit by bit, and reads baseline
(DCT) frames as motion-JPEG files hold them, of which the luma plane counts.

Rows with a null payload count as empty; an empty payload is 64 zero bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

WIDTH, HEIGHT, FPS = 64, 16, 25
FRAME = WIDTH * HEIGHT
UNIT = 64
BINS = 16


def _words() -> np.ndarray:
    """The 9-bit word of each difference from -255 to 255."""
    d = np.arange(-255, 256)
    s = np.ceil(np.log2(np.abs(d) + 1)).astype(int)
    return (((2 << (8 - s)) - 2 << s) | np.where(d < 0, d + (1 << s) - 1, d)).astype(np.uint16)


WORDS = _words()
DIFFS = np.zeros(512, np.int16)
DIFFS[WORDS] = np.arange(-255, 256)

_SHIFT = np.arange(9)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00")
    + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
)


def pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG of each frame of an array (frames, HEIGHT, WIDTH) of bytes."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    w = WORDS[d.reshape(-1, 8) + 255]
    out = np.empty((len(w), 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (w[:, i - 1] << (8 - i)) & 255 | (w[:, i] >> (i + 1))
    out[:, 8] = w[:, 7] & 255
    scan = out.reshape(len(x), -1)
    return [_HEAD + s.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for s in scan]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode(payload: bytes) -> bytes:
    """An AVI file that holds payload; its length is in the stream's strd chunk."""
    n = max(1, -(-len(payload) // FRAME))
    grid = np.zeros(n * FRAME, np.uint8)
    grid[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = encode_frames(grid.reshape(n, HEIGHT, WIDTH))
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    chunks, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
        chunks.append(c)
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _walk(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield bytes(data[at : at + 4]), at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


class BrokenMedia(ValueError):
    """Bytes that are not an AVI file, or one whose frames cannot be read."""


def parse(media: bytes) -> tuple[list[tuple[int, int]], int | None, float]:
    """Place and size of each video frame, stored length, frames a second.

    Frames come from the RIFF index (idx1) or, in files that have them, from the
    OpenDML indexes (indx and ix..); without either, from the chunks of movi.
    """
    data = memoryview(media)
    if len(data) < 12 or bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise BrokenMedia("not an AVI file")
    old: list[tuple[int, int]] = []
    wide: list[tuple[int, int]] = []
    seen: list[tuple[int, int]] = []
    length, fps, movi = None, float(FPS), None
    stack = [(k, a + 4, a + n) for k, (name, a, n) in enumerate(_walk(data, 0, len(data))) if name == b"RIFF"][::-1]
    try:
        while stack:
            riff, start, end = stack.pop()
            lists = []
            for name, at, size in _walk(data, start, end):
                if name == b"LIST":
                    kind = bytes(data[at : at + 4])
                    if kind == b"movi" and movi is None:
                        movi = at
                    lists.append((riff, at + 4, at + size))
                elif name == b"strd" and size >= 8:
                    length = struct.unpack_from("<Q", data, at)[0]
                elif name == b"strh":
                    scale, rate = struct.unpack_from("<II", data, at + 20)
                    fps = rate / scale if scale and rate else fps
                elif name == b"idx1":
                    for k in range(size // 16):
                        kind, _, off, n = struct.unpack_from("<4sIII", data, at + 16 * k)
                        if kind[2:] in (b"dc", b"db"):
                            old.append((off, n))
                elif name == b"indx" or name[:2] == b"ix":
                    wide += _opendml(data, at)
                elif name[2:] in (b"dc", b"db"):
                    seen.append((at, size))
            stack += lists[::-1]
    except struct.error as e:
        raise BrokenMedia("a chunk ends early") from e
    if wide:
        found = wide
    elif old and movi is not None:
        base = movi if old[0][0] < movi else 0  # offsets from movi, or in some files from the start
        found = [(base + off + 8, n) for off, n in old]
    else:
        found = seen
    if any(a + n > len(data) for a, n in found):
        raise BrokenMedia("a frame lies beyond the end")
    return found, length, fps


def _opendml(data: memoryview, at: int) -> list[tuple[int, int]]:
    """Frames of an index of chunks; one of indexes has none of its own, since those lie in movi."""
    entry, _, kind, n = struct.unpack_from("<HBBI", data, at)
    if kind != 1:
        return []
    base = struct.unpack_from("<Q", data, at + 12)[0]
    rows = [struct.unpack_from("<II", data, at + 24 + 4 * entry * k) for k in range(n)]
    return [(base + off, size & 0x7FFFFFFF) for off, size in rows]


def _serial(scan: bytes, counts: bytes, values: bytes, n: int) -> np.ndarray:
    """Differences of n samples under any Huffman table, bit by bit."""
    codes, code, k = {}, 0, 0
    for length, c in enumerate(counts, 1):
        for _ in range(c):
            codes[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits, at, out = np.unpackbits(np.frombuffer(scan, np.uint8)).tolist(), 0, np.zeros(n, np.int16)
    for i in range(n):
        code = length = 0
        while (length, code) not in codes:
            code, length, at = code << 1 | bits[at], length + 1, at + 1
        s, v = codes[length, code], 0
        for _ in range(s):
            v, at = v << 1 | bits[at], at + 1
        out[i] = v - (1 << s) + 1 if s and v < 1 << (s - 1) else v
    return out


_FIXED = (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))


def _scan(jpeg: bytes) -> tuple[bytes, tuple[bytes, bytes], int, int]:
    """Scan bytes, Huffman table, height and width of a lossless JPEG frame."""
    at, table, height, width = 2, _FIXED, 0, 0
    while jpeg[at] == 0xFF:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            table = body[1:17], body[17 : 17 + sum(body[1:17])]
        elif marker == 0xC3:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("one component is expected")
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a lossless JPEG frame")
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("predictor 1 is expected")
            return jpeg[at:-2].replace(b"\xff\0", b"\xff"), table, height, width
    raise ValueError("no scan")


def _undo(d: np.ndarray) -> np.ndarray:
    """Samples from differences (frames, height, width) under predictor 1."""
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_COS = np.array([[math.sqrt((1 if u else 0.5) / 4) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def read(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = length = 0
        while (length, code) not in codes:
            if self.at >= len(self.bits) or length > 16:
                raise BrokenMedia("a scan ends early")
            code, length, self.at = code << 1 | self.bits[self.at], length + 1, self.at + 1
        return codes[length, code]

    def value(self, size: int) -> int:
        v = self.read(size)
        return v - (1 << size) + 1 if size and v < 1 << (size - 1) else v


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, c in enumerate(counts, 1):
        for _ in range(c):
            out[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode_baseline(jpeg: bytes) -> np.ndarray:
    """The luma plane (height, width) of a baseline JPEG frame, as motion-JPEG files hold it."""
    quant, tables, parts, at, every = {}, {}, [], 2, 0
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(float)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            _, height, width, count = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
        elif marker == 0xDA:
            picks = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            break
    else:
        raise BrokenMedia("no scan")
    if not parts:
        raise BrokenMedia("not a baseline JPEG frame")
    h, v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    _, lh, lv, lq = parts[0]
    plane = np.zeros((down * lv * 8, across * lh * 8))
    scans = re.split(b"\xff[\xd0-\xd7]", jpeg[at:]) if every else [jpeg[at:]]
    before, bits = dict.fromkeys((p[0] for p in parts), 0), None
    for unit in range(across * down):
        if bits is None or every and unit % every == 0:
            scan = scans[unit // every if every else 0]
            bits, before = _Bits(scan.split(b"\xff\xd9")[0].replace(b"\xff\0", b"\xff")), dict.fromkeys(before, 0)
        for name, ph, pv, _ in parts:
            try:
                dc, ac = tables[picks[name] >> 4], tables[16 | picks[name] & 15]
            except KeyError as e:
                raise BrokenMedia("a Huffman table is missing") from e
            for k in range(ph * pv):
                block = np.zeros(64)
                before[name] += bits.value(bits.symbol(dc))
                block[0], i = before[name], 1
                while i < 64:
                    s = bits.symbol(ac)
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15 and i < 64:
                        block[_ZIGZAG[i]] = bits.value(s & 15)
                    i += 1
                if name == parts[0][0]:
                    q = np.zeros(64)
                    q[_ZIGZAG] = quant[lq]
                    y, x = (unit // across * pv + k // ph) * 8, (unit % across * ph + k % ph) * 8
                    plane[y : y + 8, x : x + 8] = _COS.T @ (block * q).reshape(8, 8) @ _COS
    return np.clip(np.round(plane[:height, :width] + 128), 0, 255).astype(np.uint8)


def _lossless(jpeg: bytes) -> bool:
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at + 1] != 0xDA:
        if jpeg[at + 1] in (0xC0, 0xC1, 0xC3):
            return jpeg[at + 1] == 0xC3
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    return False


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Samples (height, width) of a lossless frame, or the luma of a baseline one."""
    try:
        if not _lossless(jpeg):
            return decode_baseline(jpeg)
        scan, (counts, values), h, w = _scan(jpeg)
        if (counts, values) == _FIXED and h * w % 8 == 0:
            return _undo(_unpack(scan).reshape(1, h, w))[0]
        return _undo(_serial(scan, counts, values, h * w).reshape(1, h, w))[0]
    except (struct.error, IndexError, KeyError, ValueError) as e:
        raise BrokenMedia("a frame is cut short") from e


def _unpack(scan: bytes) -> np.ndarray:
    b = np.frombuffer(scan, np.uint8).reshape(-1, 9).astype(np.uint16)
    w = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        w[:, i] = (b[:, i] << (i + 1) | b[:, i + 1] >> (7 - i)) & 511
    return DIFFS[w]


def decode(media: bytes) -> tuple[np.ndarray, int | None, float]:
    """All frames (frames, height, width), the stored length, frames a second; empty chunks repeat the frame before."""
    places, length, fps = parse(media)
    jpegs = [media[a : a + n] for a, n in places]
    if not any(jpegs):
        return np.zeros((0, HEIGHT, WIDTH), np.uint8), length, fps
    if all(j.startswith(_HEAD) for j in jpegs):  # frames of encode: all at once
        scans = [j[len(_HEAD) : -2].replace(b"\xff\0", b"\xff") for j in jpegs]
        if all(8 * len(x) == 9 * FRAME for x in scans):
            return _undo(_unpack(b"".join(scans)).reshape(len(scans), HEIGHT, WIDTH)), length, fps
    frames: list[np.ndarray] = []
    for j in jpegs:
        if j:
            frames.append(decode_frame(j))
        elif frames:
            frames.append(frames[-1])
    if len({f.shape for f in frames}) > 1:
        raise BrokenMedia("frames differ in size")
    return np.stack(frames), length, fps


def shots(frames: np.ndarray, window: int = 8, times: float = 2.5, least: float = 0.12) -> list[int]:
    """First frame of each shot.

    A cut lies before a frame whose histogram differs from the last one's by
    more than the mean plus ``times`` deviations of the ``window`` differences
    before, and by ``least`` at least (both as shares of the samples).
    """
    n = len(frames)
    if n < 2:
        return [0] if n else []
    size = frames[0].size
    codes = frames.reshape(n, -1) // (256 // BINS) + np.arange(n)[:, None] * BINS
    hist = np.bincount(codes.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * size)
    s1 = np.concatenate([[0.0], np.cumsum(diff)])
    s2 = np.concatenate([[0.0], np.cumsum(diff * diff)])
    i = np.arange(len(diff))
    lo = np.maximum(0, i - window)
    m = np.maximum(1, i - lo)
    mean = (s1[i] - s1[lo]) / m
    dev = np.sqrt(np.maximum(0, (s2[i] - s2[lo]) / m - mean * mean))
    cut = (diff > mean + times * dev) & (diff >= least)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def _bytes(col: pa.Array) -> Iterator[bytes]:
    for x in col:
        yield x.as_py() or b""


CLIPS = "doc_id long, clip int, first_frame int, n_frames int, start_s double, end_s double, mean_luma double"


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, media): the AVI file of each text's padded UTF-8 bytes."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(pad(x)) for x in _bytes(b.column(1))], pa.binary())], ["doc_id", "media"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("b")).mapInArrow(tidy(run), "doc_id long, media binary")


def clips(media: DataFrame, broken: str = "skip") -> DataFrame:
    """Timed clip rows, one for each shot, of a (doc_id, media) table.

    A null or empty medium has no clips, nor has one that cannot be read, unless
    broken is "raise".
    """

    def run(batches):
        for b in batches:
            rows = []
            for key, data in zip(b.column(0).to_pylist(), _bytes(b.column(1)), strict=True):
                if not data:
                    continue
                try:
                    frames, _, fps = decode(data)
                except BrokenMedia:
                    if broken == "raise":
                        raise
                    continue
                starts = shots(frames)
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True)):
                    rows.append((key, k, a, z - a, a / fps, z / fps, float(frames[a:z].mean())))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in CLIPS.split(", ")])

    return media.select(F.col("doc_id").cast("long"), F.col("media")).mapInArrow(tidy(run), CLIPS)


def digest(data: bytes) -> tuple:
    """Stores data, reads it back and describes it: the columns of SUMMARY but the id."""
    media = encode(pad(data))
    frames, length, fps = decode(media)
    payload = frames.tobytes()[:length]
    starts = shots(frames)
    ends = [*starts[1:], len(frames)]
    feature = f"frames={len(frames)};shots={len(starts)};cuts={','.join(f'{a / fps:.2f}' for a in starts[1:])};longest={max(z - a for a, z in zip(starts, ends, strict=True))};luma={frames.mean():.4f}"
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature)


SUMMARY = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def summary(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores, reads back and describes every text in one narrow pass; null is empty."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            cols = list(zip(*map(digest, _bytes(b.column(1))), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in SUMMARY.split(", ")])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("b")).mapInArrow(tidy(run), SUMMARY)
