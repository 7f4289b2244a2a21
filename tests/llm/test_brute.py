"""Operators against brute-force versions on small tables, and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import pytest

from lacunar.llm import fingerprint, linededup, lpf, mixing, packing, queries, tgm

DATA = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
LETTERS = "abcdefghijklmnopqrstuvwxyzéß"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8)))


def corpus(seed=11, n=60):
    """Texts with copies, near copies, shared passages, one-edit lines and case changes."""
    rng = random.Random(seed)
    vocab = [word(rng) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, common = line(60), line(9)
    texts = []
    for i in range(n):
        lines = [line(rng.randint(3, 14)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), common)
        if i % 5 == 0:
            lines.append(passage)
        if i and i % 4 == 0:  # a line of another document, one edit away or equal
            old = rng.choice(rng.choice(texts).split("\n"))
            k = rng.randint(0, max(0, len(old) - 1))
            lines.append(rng.choice([old, old[:k] + "q" + old[k + 1 :], old[:k] + old[k + 1 :], old[:k] + "z" + old[k:]]))
        if i and i % 7 == 0:  # a near copy
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
            continue
        if i and i % 11 == 0:
            texts.append(rng.choice(texts))
            continue
        texts.append("\n".join(lines))
    return [(i * 3, t, f"s{i % 4}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(docs).collect()}
    for k, (i, t, _) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_next"] == float(fingerprint.canonical(t) == fingerprint.canonical(nxt))
        assert got[i]["edited_fingerprint"] == fingerprint.fingerprint(e)


def test_canonical_form_is_worked_out_apart(spark):
    """By tables of pairs, not by the module's own function; the hash by its published values."""
    import unicodedata

    import xxhash

    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        t = unicodedata.normalize("NFKC", "".join(c.casefold() for c in t))
        out = []
        for c in t:
            if c.isspace():
                out.append(" ") if out and out[-1] != " " else None
            else:
                out.append(c)
        return "".join(out).strip(" ")

    same = [("ﬁne  Straße", "FINE STRASSE"), ("A\u030a b", "å\tB"), ("①\u00a02", "1 2 "), ("ΣΑΣ", "σας"), ("", " \n ")]
    for a, b in same:
        assert fingerprint.fingerprint(a) == fingerprint.fingerprint(b) == xxhash.xxh3_128_hexdigest(plain(a).encode())
    other = [("a b", "ab"), ("é", "e"), ("o'k", "ok")]
    assert all(fingerprint.fingerprint(a) != fingerprint.fingerprint(b) for a, b in other)
    assert fingerprint.fingerprint("") == "99aa06d3014798d86001c324468d497f"
    rows = [(i, t) for i, t in enumerate(x for pair in same + other for x in pair)]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: xxhash.xxh3_128_hexdigest(plain(t).encode()) for i, t in rows}


def test_field_marginals_by_all_labellings():
    import itertools
    import math

    from lacunar.llm import quality

    np = quality.np
    rng = random.Random(21)
    e = np.array([rng.gauss(0, 2) for _ in range(9)])
    docs = np.array([0, 4, 5, 9])
    field = quality.Field(np.zeros(quality.FEATURES), np.array([[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)]))
    bad, pairs, log_z = field.marginals(e, docs, pairs=True)
    want, total, expected = np.zeros(9), 0.0, np.zeros((2, 2))
    for a, z in itertools.pairwise(docs.tolist()):
        weight = {}
        for y in itertools.product((0, 1), repeat=z - a):
            steps = list(itertools.pairwise(y))
            weight[y] = math.exp(sum(e[a + i] * v for i, v in enumerate(y)) + sum(field.t[s] for s in steps))
        norm = sum(weight.values())
        total += math.log(norm)
        for y, w in weight.items():
            want[a:z] += np.array(y) * w / norm
            for s in itertools.pairwise(y):
                expected[s] += w / norm
    assert np.allclose(bad, want) and np.allclose(pairs, expected) and abs(log_z - total) < 1e-9


def test_ftrl_by_dense_updates():
    import math

    from lacunar.llm import langid

    np = langid.np
    rng = random.Random(22)
    rows = []
    for _ in range(40):
        at = sorted(rng.sample(range(12), 4))
        rows.append((np.array(at), np.array([rng.random() for _ in at]), rng.randrange(3)))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.01
    got = langid.ftrl(rows, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n = {}, {}

    def weight(i, c):
        a1, a2 = (0.0, 0.0) if i == "bias" else (l1, l2)
        s = z.get((i, c), 0.0)
        return 0.0 if abs(s) <= a1 else -(s - math.copysign(a1, s)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / alpha + a2)

    for _ in range(2):
        for at, v, y in rows:
            x = {**dict(zip(at.tolist(), v.tolist(), strict=True)), "bias": 1.0}
            w = {(i, c): weight(i, c) for i in x for c in range(3)}
            s = [sum(w[i, c] * x[i] for i in x) for c in range(3)]
            p = [math.exp(k) / sum(map(math.exp, s)) for k in s]
            for i in x:
                for c in range(3):
                    g = (p[c] - (c == y)) * x[i]
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, c]
                    n[i, c] = old + g * g
    for i in range(12):
        assert np.allclose(got[i], [weight(i, c) for c in range(3)])
    assert np.allclose(got[-1], [weight("bias", c) for c in range(3)])
    assert (got[:12] == 0).any()  # the elastic net leaves some out


def test_temperature_by_search():
    from lacunar.llm import langid

    np = langid.np
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3)) + 1.0 * np.eye(3)[y]
    t = langid.calibrate(6 * logits, y)

    def loss(t):
        s = 6 * logits / t
        return -(s[np.arange(400), y] - np.log(np.exp(s).sum(1))).mean()

    assert loss(t) <= min(loss(x) for x in (t / 1.5, t * 1.5, 1.0))


def test_a_clash_is_told_apart(spark):
    t = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a"), ("y", "c"), ("y", "c")], "fingerprint string, canon string")
    assert [tuple(r) for r in fingerprint.collisions(t).collect()] == [("x", "b", 1)]


def test_lpf_array():
    rng = random.Random(2)
    for n in (0, 1, 7, 60, 200):
        x = bytes(rng.choice(b"abc") for _ in range(n))
        want = [max((next(k for k in range(n - i + 1) if i + k == n or x[i + k] != x[j + k]) for j in range(i)), default=0) for i in range(n)]
        assert lpf.longest_previous_factor(x).tolist() == want


def test_nearest_smaller_values():
    rng = random.Random(3)
    for n in (1, 2, 3, 17, 200):
        a = lpf.np.array(rng.sample(range(1000), n))
        want = [max((j for j in range(i) if a[j] < a[i]), default=-1) for i in range(n)]
        assert lpf.smaller_before(a).tolist() == want


def test_windows_with_a_long_previous_factor():
    rng = random.Random(4)
    for length in (1, 3, 4, 7, 100):
        data = bytes(rng.choice(b"ab") for _ in range(150)) * 2 + bytes(rng.choice(b"ab") for _ in range(60))
        starts = lpf.np.arange(len(data) - length + 1)
        place = lpf.np.array(rng.sample(range(len(starts)), len(starts)))
        win = [data[i : i + length] for i in starts]
        want = [any(win[j] == win[i] and place[j] < place[i] for j in starts) for i in starts]
        assert lpf.repeated(lpf.np.frombuffer(data, lpf.np.uint8), starts, place, length).tolist() == want


def test_repeated_strings(docs, rows):
    got = {r["doc_id"]: r for r in lpf.cut(docs).collect()}
    seen, removed = set(), 0
    for i, t, _ in rows:
        x = t.encode()
        gone = bytearray(len(x))
        for p in range(len(x) - 99):
            if x[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(x[p : p + 100])
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (sum(gone), spans, hashlib.sha256(kept).hexdigest())
        removed += sum(gone)
    assert removed > 1000


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def linked(rows, n, percent):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(docs, rows, n, percent):
    want, sets = linked(rows, n, percent)
    got = {r["doc_id"]: r for r in tgm.join(docs, n, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def edits(a, b):
    """Edit distance up to 2."""
    if abs(len(a) - len(b)) > 1:
        return 2
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def dedup_lines(rows, least=linededup.LEAST):
    before, out = [], {}
    for i, t, *_ in rows:
        keep = []
        for line in t.split("\n"):
            gone = line in before or len(line) >= least and any(len(x) >= least and edits(line, x) <= 1 for x in before)
            if line.strip(" \t\v\f\r"):
                before.append(line)
                keep += [] if gone else [line]
            else:
                keep.append(line)
        out[i] = keep
    return out


def test_line_dedup_of_short_blank_and_very_long_lines(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdef ") for _ in range(200_000))
    k = 123_456
    texts = ["same short line\n \n\n" + long, "same short line\n \n\n" + long[:k] + "X" + long[k + 1 :], long[:k] + long[k + 1 :] + "\nsame short lines", long[:7] + "Y" + long[7:], long[:k] + "XX" + long[k + 2 :]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()}
    assert got[0] == texts[0] and got[1] == " \n" and got[2] == "same short lines" and got[3] == ""
    assert got[4] == ""  # one edit from the second text


def test_line_dedup(docs, rows):
    want = dedup_lines(rows)
    got = {r["doc_id"]: r for r in linededup.dedup(docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: "\n".join(x) for i, x in want.items()}
    exact = Counter(x for _, t, _ in rows for x in t.split("\n") if len(x) >= 20)
    assert sum(r["n_removed"] for r in got.values()) > sum(v - 1 for v in exact.values())  # some are one edit away


def test_mixing_sql(docs, rows):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = {tuple(r) for r in con.sql(mixing.SQL).fetchall()}
    got = mixing.mix(docs)
    assert {tuple(r) for r in got.collect()} == want
    by = got.toPandas()
    assert (by.taken <= 2 * by["size"]).all()


def test_inclusion_is_unequal_and_ranked_by_pareto_odds(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([1, 3, 10, 40, 150, 600]), "a" if i % 3 else "b") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("target"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    low = got[got.target == got[got.copies < 2].target.max()]
    share = low.groupby("size").copies.mean()
    assert share.loc[600] > share.loc[10] + 0.1  # longer documents are likelier
    u = {i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in low.doc_id}
    some = low[low.doc_id.isin(u)]
    taken, left = some[some.copies == some.copies.max()], some[some.copies == some.copies.min()]
    assert max(u[i] for i in taken.doc_id) > min(u[i] for i in left.doc_id)  # not the order of the uniform numbers alone


def test_pieces(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer())
    odd = [(10_000, "It's WE'LL e.g. 12,3 «ça» ΑΣ. ŉ <|endoftext|>x . , .,", "s"), (10_001, "w " * 5000, "s")]
    df = docs.sparkSession.createDataFrame([*rows, *odd], "doc_id long, text string, source string")
    got = {}
    for r in packing.pieces(df, queries.tokenizer()).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, _ in [*rows, *odd]:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(packing.np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got[i]) == want


def test_bounds_and_best_fit():
    rng = random.Random(4)
    for _ in range(200):
        n = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        where, bins = packing.best_fit(n, 12)
        fill = Counter()
        for b, x in zip(where, n, strict=True):
            fill[b] += x
        assert max(fill.values()) <= 12 and len(fill) == bins

        def fewest(left, free):
            if not left:
                return len(free)
            x, rest = left[0], left[1:]
            options = [fewest(rest, [*free[:k], f - x, *free[k + 1 :]]) for k, f in enumerate(free) if f >= x]
            return min([*options, fewest(rest, [*free, 12 - x])])

        assert packing.bound(packing.np.bincount(n, minlength=13), 12) <= (fewest(sorted(n)[::-1], []) if len(n) < 7 else bins) <= bins


def test_exchange_over_partitions(docs):
    got = packing.pack(packing.pieces(docs, queries.tokenizer(), size=512), size=512, partition=8).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 512
    assert got.sequence_id.nunique() <= packing.bound(packing.np.bincount(got.length, minlength=513), 512) + 2
    assert not got.duplicated(["doc_id", "piece"]).any()


def test_packing_over_partitions_is_one_best_fit(spark):
    rng = random.Random(6)
    for top in (1, 2, 5, 12, 60):
        n = [rng.randint(1, top) for _ in range(rng.randint(1, 400))]
        assert packing.plan(packing.np.bincount(n, minlength=61), 60)[1] == packing.best_fit(n, 60)[1]
    n = [rng.randint(500, 2048) for _ in range(8000)]
    df = spark.createDataFrame([(i, 0, 0, x, i % 7) for i, x in enumerate(n)], packing.PIECES)
    got = packing.pack(df, partition=1000).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got.doc_id) == list(range(8000)) and got.groupby("sequence_id").length.sum().max() <= 2048
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.sequence_id.nunique() == packing.best_fit(n)[1]


@here
def test_quality_and_language_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.op4_quality_classifier(spark, DATA).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    lang = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language_id(spark, DATA).join(lang, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_url_ratio_is_that_of_counted_contexts(spark):
    """Against dictionaries of every context, order by order."""
    import math

    from lacunar.llm import urlfilter

    rng = random.Random(13)
    make = lambda kind: f"http://x{rng.randint(0, 9)}.net/{kind}/" + "".join(rng.choice("abcdef0123"[:6] if kind == "p" else "0123ef") for _ in range(rng.randint(3, 12)))
    rules = [urlfilter.Rule("good.org", "/", True), urlfilter.Rule("bad.org", "/", False)]
    urls = [make(rng.choice("pq")) for _ in range(60)]
    urls += [u.replace(".net", ".good.org") for u in (make("p") for _ in range(80))] + [u.replace(".net", ".bad.org") for u in (make("q") for _ in range(80))]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    seen = [Counter(), Counter()]
    for u in urls:
        if ".net" not in u:
            s = "\0" * 5 + u + "\1"
            for i in range(5, len(s)):
                for k in range(6):
                    seen["good" in u].update([(k, s[i - k : i]), (k, s[i - k : i], s[i])])

    def ratio(u):
        s, total = "\0" * 5 + u + "\1", 0.0
        for i in range(5, len(s)):
            p = [1 / 256, 1 / 256]
            for k in range(6):
                p = [(seen[c][k, s[i - k : i], s[i]] + 2 * p[c]) / (seen[c][k, s[i - k : i]] + 2) for c in (0, 1)]
            total += math.log(p[1] / p[0])
        return total / (len(u) + 1)

    logit = {i: math.log(r["score"] / (1 - r["score"])) for i, r in got.items() if 0 < r["score"] < 1}
    pairs = sorted((ratio(urls[i]), z) for i, z in logit.items())
    (x0, z0), (x1, z1) = pairs[0], pairs[-1]
    slope = (z1 - z0) / (x1 - x0)
    assert slope > 0 and len(pairs) > 100
    assert all(abs(z - (z0 + slope * (x - x0))) < 1e-6 * (1 + abs(z)) for x, z in pairs)  # scores are a curve over the same ratios
    assert all(got[i]["verdict"] == ("allow" if "/p/" in u else "block") for i, u in enumerate(urls))


@here
def test_url_model_agrees_with_its_rules(spark):
    got = queries.op2_url_filters(spark, "/root/testdata/sf0.1").where("rule is not null").toPandas()
    assert ((got.score >= 0.5) == (got.verdict == "allow")).mean() > 0.97


@here
def test_line_dedup_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    assert {tuple(r) for r in queries.op7_line_dedup(spark, DATA).collect()} == {tuple(r) for r in con.sql(linededup.SQL).fetchall()}
