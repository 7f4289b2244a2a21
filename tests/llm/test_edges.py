"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunar.llm import common, fingerprint, langid, linededup, lpf, media, mixing, packing, quality, queries, tgm, urlfilter
from lacunar.llm.common import crc_mod
from lacunar.llm.components import components

DDL = "doc_id long, text string, lang string, source string, n_chars long, size int, b int, o string, th string, u double, at int, first string, _t string, _row int, n_lines int, copies int"
WORDS = "the of and to in is that for it with as was on be by his this are from at".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "er", "ing"]) for _ in range(n))


def rows():
    rng = random.Random(5)
    body = _text(rng, 80)
    long = "\n".join(_text(rng, 300) for _ in range(60)) + " x" * 20 + "y" * 70_000
    texts = [(1, body), (2, body), (2, body), (2, body + " end"), (3, None), (None, body), (None, None), (4, ""), (5, long), (6, long), (7, "a\n\n\nb"), (8, "ŒÉ ﬁ ½ 中文 \u0000   x"), (9, "   "), (9, "12 34"), (10, body.upper()), (1 << 62, "tail")]
    return [(i, t, None if k % 3 == 0 else "en" if k % 2 else "fr", None if k % 5 == 0 else f"s{k % 2}", None, k, k, "o", "th", 0.5, 1, "f", "t", 1, 2, 3) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (5, None, 1), (None, 1, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


def _quality(d):
    field = quality.train(d, labels(d.sparkSession))
    return quality.score(d, field, crc_mod("doc_id", 5) == 0)


def _lang(d):
    return langid.predict(d, langid.train(d), crc_mod("doc_id", 4) == 2)


CASES = {
    "fingerprint": (fingerprint.edited_pairs, "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
    "media": (media.summary, "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"),
    "quality": (_quality, "doc_id held_out score predicted"),
    "lpf": (lpf.cut, "doc_id n_bytes n_removed n_spans kept_sha256"),
    "tgm": (tgm.join, "doc_id n_shingles component_id"),
    "langid": (_lang, "doc_id held_out lang_pred score"),
    "mixing": (mixing.mix, "doc_id size source_size target taken copies"),
    "packing": (lambda d: packing.pack(packing.pieces(d, queries.tokenizer())), "doc_id piece start length ids_crc32 sequence_id offset"),
}


@pytest.mark.parametrize("name", CASES)
def test_all_rows_come_back(name, docs, empty):
    run, columns = CASES[name]
    out = run(docs)
    assert out.columns == columns.split()
    got = out.collect()
    keys = lambda rs: sorted(str(r[0]) for r in rs)
    if name == "packing":
        assert sorted({str(r[0]) for r in got}) == sorted({str(r[0]) for r in rows()})
    else:
        assert keys(got) == keys(rows())
    nothing = run(empty)
    assert nothing.columns == columns.split()
    assert nothing.collect() == []


def test_line_dedup_keeps_columns_and_rows(docs, empty):
    out = linededup.dedup(docs)
    assert out.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_removed"]
    got = out.collect()
    assert all(r["_t"] == "t" and r["_row"] == 1 and r["th"] == "th" for r in got)
    assert len(got) == len(rows())
    assert sum(r["text"] is None for r in got) == 2
    # the copies of the body lose it; the first row in order (no id) keeps it
    kept = [(r["doc_id"], r["n_removed"]) for r in got if r["size"] in (0, 1, 2, 5)]
    assert sorted(kept, key=str) == [(1, 1), (2, 1), (2, 1), (None, 0)]
    assert linededup.dedup(empty).collect() == []


def test_equal_texts_have_equal_values(docs):
    for name, col in (("fingerprint", "fingerprint"), ("media", "media_sha256"), ("quality", "score"), ("langid", "lang_pred")):
        got = [r[col] for r in CASES[name][0](docs.where("text is not null")).where("doc_id = 1 or doc_id is null").collect()]
        assert got[0] == got[1]


def test_repeated_rows_are_ordered_in_lpf(docs):
    got = lpf.cut(docs).where("doc_id = 2 or doc_id = 1 or doc_id is null").collect()
    whole = [r for r in got if r["n_removed"] == 0 and r["n_bytes"] > 100]
    assert len(whole) == 1 and whole[0]["doc_id"] is None  # the earliest copy of all
    assert all(r["n_spans"] == 1 for r in got if r["n_removed"])


def test_one_of_each_drops_copies_and_keeps_rows_without_id(docs):
    got = tgm.one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(None) == 2 and ids.count(1) == 1 and ids.count(2) == 0 and ids.count(9) == 2 and ids.count(5) == 1 and ids.count(6) == 0
    assert {3, 4, 7, 8, 9, 1 << 62} <= set(ids)


def test_rows_of_one_id_and_other_texts_stay(spark):
    rng = random.Random(12)
    a, c = _text(rng, 60), _text(rng, 60)
    df = spark.createDataFrame([(1, a), (1, c), (1, c), (2, c + " end"), (3, a)], "doc_id long, text string")
    assert sorted(map(tuple, tgm.one_of_each(df).collect())) == sorted([(1, a), (1, c)])


def test_labels_deal_a_partition_to_each(spark):
    for n in (1, 7, 64):
        found = common.labels(n)
        got = spark.createDataFrame([(int(x),) for x in found], "b int").repartition(n, "b").select("b", F.spark_partition_id().alias("p")).collect()
        assert {r["p"] for r in got} == set(range(n)) and [r["b"] for r in sorted(got, key=lambda r: r["p"])] == found.tolist()


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    got = components(edges).collect()
    assert {r["component"] for r in got} == {0} and len(got) == n


def test_urls(spark):
    from lacunar.llm.queries import RULES

    urls = [(1, "https://A.B.org/x?y"), (2, None), (3, "no scheme"), (4, "http://example.org/es/1"), (5, "http://sub.example.org/en/12#f"), (6, "ftp://x.com/fr/"), (7, "http://x.com/de/a?b/"), (8, "http://notexample.org"), (9, "http://example.net/?q"), (None, "://"), (9, "http://example.net/?q"), (10, "http://org/")]
    out = urlfilter.judge(spark.createDataFrame([(*u, "z", "r") for u in urls], "page_id long, url string, host string, rule string"), RULES)
    got = {r["page_id"]: r for r in out.collect()}
    assert got[1]["host"] == "a.b.org" and got[1]["path"] == "/x" and got[1]["rule"] == "org/" and got[1]["verdict"] == "allow"
    assert got[2]["host"] == got[2]["path"] == got[3]["host"] == got[3]["path"] == ""
    assert got[4]["rule"] == "example.org/es/" and got[4]["verdict"] == "block"
    assert got[5]["rule"] == "example.org/en/1" and got[6]["rule"] == "com/fr/" and got[7]["verdict"] == "block"
    assert got[8]["rule"] is None and got[8]["path"] == "" and got[9]["rule"] is None and got[10]["rule"] == "org/"
    assert out.count() == len(urls)
    none = urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), RULES)
    assert none.collect() == []


def test_media_round_trip_and_foreign_tables():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 1024, 5000):
        data = rng.randbytes(n)
        frames, length, fps = media.decode(media.encode(media.pad(data)))
        assert frames.tobytes()[:length] == media.pad(data) and fps == 25
    jpeg = media.encode_frames(media.np.frombuffer(rng.randbytes(1024), media.np.uint8).reshape(1, 16, 64))[0]
    scan, table, h, w = media._scan(jpeg)
    assert (media._serial(scan, *table, h * w) == media._unpack(scan).ravel()).all()


def test_media_clips(spark):
    dark, light = bytes(1024), bytes([200]) * 1024
    df = spark.createDataFrame([(1, media.encode(dark * 3 + light * 4)), (2, None)], "doc_id long, media binary")
    got = media.clips(df).orderBy("clip").collect()
    assert [(r["first_frame"], r["n_frames"], r["start_s"]) for r in got] == [(0, 3, 0.0), (3, 4, 0.12)]


def test_media_names_every_cut(spark):
    text = "".join(chr(97 + k % 2 * 20) * 1024 * 10 for k in range(14))
    feature = media.summary(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["feature"]
    assert "shots=14" in feature and feature.split("cuts=")[1].split(";")[0].count(",") == 12


def _baseline(samples, restart=0):
    """A baseline JPEG of 8 x 8 blocks that hold one value each: DC codes alone."""
    blocks = [int(round((v - 128) * 8 / 4)) for v in samples]  # quantised by 4
    bits, before = "", 0
    out = b""
    for k, b in enumerate(blocks):
        if restart and k and k % restart == 0:
            bits += "1" * (-len(bits) % 8)
            out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
            bits, before = "", 0
        d, before = b - before, b
        s = abs(d).bit_length()
        bits += format(s, "04b") + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "") + "0"  # end of block
    bits += "1" * (-len(bits) % 8)
    out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = media._segment
    tables = seg(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + seg(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
    head = seg(0xDB, b"\0" + bytes([4] * 64)) + seg(0xC0, bytes([8, 0, 8, 0, 8 * len(samples), 1, 1, 0x11, 0])) + tables
    return b"\xff\xd8" + head + (seg(0xDD, bytes([0, restart])) if restart else b"") + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + out + b"\xff\xd9"


def _avi(frames, index=True):
    chunks = b"".join(media._chunk(b"00dc", f) for f in frames)
    body = b"AVI " + media._chunk(b"LIST", b"movi" + chunks)
    if index:
        at, rows = 4, b""
        for f in frames:
            rows += media.struct.pack("<4sIII", b"00dc", 16, at, len(f))
            at += len(media._chunk(b"00dc", f))
        body += media._chunk(b"idx1", rows)
    return media._chunk(b"RIFF", body)


def test_baseline_frames_and_files_without_an_index(spark):
    for restart in (0, 1, 2):
        got = media.decode_frame(_baseline([10, 200, 128, 60], restart))
        assert got.shape == (8, 32) and [abs(int(x) - v) <= 1 for x, v in zip(got[3, 4::8], [10, 200, 128, 60], strict=True)] == [True] * 4
    dark, light = _baseline([20] * 4), _baseline([220] * 4)
    for index in (True, False):
        frames, _, _ = media.decode(_avi([dark] * 3 + [light] * 4 + [b""], index))
        assert frames.shape == (8, 8, 32) and media.shots(frames) == [0, 3]
    lossless = media.encode(bytes(1024) * 2 + bytes([200]) * 1024)
    bare = lossless.replace(b"idx1", b"JUNK")
    assert (media.decode(bare)[0] == media.decode(lossless)[0]).all()
    df = spark.createDataFrame([(1, _avi([dark, light, light])), (2, lossless[:-40]), (3, b"no film"), (4, lossless[: len(lossless) // 2])], "doc_id long, media binary")
    assert [(r["doc_id"], r["clip"], r["n_frames"]) for r in media.clips(df).orderBy("doc_id", "clip").collect() if r["doc_id"] == 1] == [(1, 0, 1), (1, 1, 2)]
    for x in (b"", b"no film", lossless[: len(lossless) // 2], _avi([dark[:60]])):
        with pytest.raises(media.BrokenMedia):
            media.decode(x)


def test_opendml_index():
    frames = media.encode_frames(media.np.zeros((3, 16, 64), media.np.uint8))
    chunks = b"".join(media._chunk(b"00dc", f) for f in frames)
    places, at = [], 0
    for f in frames:
        places.append((at + 8, len(f)))
        at += len(media._chunk(b"00dc", f))
    base = 12 + 8 + 4  # of the first chunk in movi
    ix = media.struct.pack("<HBBI4sQI", 2, 0, 1, 2, b"00dc", base, 0) + b"".join(media.struct.pack("<II", *p) for p in places[:2])
    film = media._chunk(b"RIFF", b"AVI " + media._chunk(b"LIST", b"movi" + chunks + media._chunk(b"ix00", ix)))
    assert len(media.decode(film)[0]) == 2  # the index names two of the three


def test_packing_is_gapless_and_tight(docs):
    got = CASES["packing"][0](docs).toPandas()
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by.length.sum().max() <= 2048
    assert ((by.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length) == got.sort_values(["sequence_id", "offset"]).offset).all()
    hist = packing.np.bincount(got.length, minlength=2049)
    assert got.sequence_id.nunique() == packing.bound(hist)


def test_hash_helpers(docs):
    assert docs.where("doc_id = 4").select(crc_mod("doc_id", 5).alias("m")).first()["m"] == zlib.crc32(b"4") % 5
    r = media.summary(docs.where("doc_id = 4")).first()
    assert r["payload_bytes"] == 64 and r["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest()
    assert docs.select(F.max(mixing.words(F.col("text")))).first()[0] > 0


def test_a_long_word_or_run_of_blanks_leaves_other_words_alone(spark):
    base = _text(random.Random(3), 80)
    half = base.index(" ", len(base) // 2)
    texts = [base, f"{base} {'u' * 300}", base[:half] + " " * 300 + base[half:], base[:half] + "\n" * 600 + base[half:]]
    sets = [set(tgm.shingle_set(t.encode()).tolist()) for t in texts]
    assert sets[0] < sets[1] and len(sets[1]) == len(sets[0]) + 1
    assert sets[0] == sets[2] == sets[3]
    words = [c * 256 + d for c in "ab" for d in ("", "c", "d")] + ["a" * k for k in (255, 511, 512, 513, 1000)]
    assert len({tgm.shingle_set(w.encode())[0] for w in words}) == len(words)  # long words are told apart
    got = tgm.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_hot_keys_meet_as_others_do(spark):
    from lacunar.llm.common import meet

    def both(keys):
        rows = spark.range(len(keys)).withColumn("k", F.element_at(F.array(*map(F.lit, keys)), F.col("id").cast("int") + 1))
        groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("a")).where("c > 1")
        got, want = meet(rows, groups, ["k"], "c"), rows.join(groups, "k")
        return sorted(map(tuple, got.select("id", "k", "c", "a").collect())), sorted(map(tuple, want.select("id", "k", "c", "a").collect()))

    got, want = both([7] * 900 + [k // 2 for k in range(100, 3100)])  # one hot, many of two rows, 7 apart
    assert got == want and len(got) == 3900
    got, want = both([k // 2 for k in range(4000)])  # none hot
    assert got == want and len(got) == 4000
    assert both([1, 1, 2])[0] == [(0, 1, 2, 0), (1, 1, 2, 0)]


def test_an_id_joins_all_that_its_texts_link_with(spark):
    a, b, c = (_text(random.Random(k), 40) for k in range(3))
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (2, a), (9, c), (7, None), (7, a)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in tgm.join(df).where("n_shingles > 0").collect())
    assert got == [(2, 2), (3, 2), (5, 2), (5, 2), (7, 2), (9, 9)]


def test_tokens_shared_by_chance_make_no_rows_of_the_matrix(spark):
    """Queries as by the plain matrix, from rows that do not grow with the square of a token's sets."""
    rng = np.random.default_rng(4)
    sets = [(i, int(n)) for i, n in enumerate(rng.integers(20, 2000, 150))] + [(200 + i, 300 + i) for i in range(6)]
    tokens = {i: {1: 1} | {int(t): 1 for t in rng.integers(10, 400, 3)} | ({1000 + j: 1 for j in range(60)} if i >= 200 else {}) for i, _ in sets}
    group = {i: 7 if i >= 200 else i for i, _ in sets}
    posted = spark.createDataFrame([(i, 0, n, t, k) for i, n in sets for t, k in tokens[i].items()], "h1 long, h2 long, n int, token long, times long")
    home = spark.createDataFrame([(i, 0, n, group[i]) for i, n in sets], "h1 long, h2 long, n int, g long")
    percent, want, plain = 80, set(), 0
    for i, n in sets:
        for g in set(group.values()):
            held = [t for t in tokens[i] if sum(t in tokens[j] for j, _ in sets if group[j] == g) > (group[i] == g)]
            plain += len(held)
            inside = [m for j, m in sets if group[j] == g]
            lo, hi = max(min(inside), -(-n * percent // 100)), min(max(inside), n * 100 // percent)
            both = lambda y: -(-(n + y) * percent // (100 + percent)) - -(-max(n, y) * percent // 100)  # noqa: E731, B023
            if held and lo <= hi and len(held) >= min(both(lo) + 1, both(hi)):
                want.add((i, g))
    got = {(r["h1"], r["g"]) for r in tgm._asked(posted, home, percent).collect()}
    assert got == want and any(i >= 200 for i, _ in got)
    assert plain > 20_000 > 4 * tgm._met(posted, home, percent).count()
