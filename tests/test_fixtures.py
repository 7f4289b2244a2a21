"""Hand-worked cases of the series operators and the NumPy routines."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunar.functions import expressions as X
from lacunar.functions import numeric
from lacunar.operators import ensemble, neighbors, profile, scores, series
from lacunar.plans import detectors, generate
from lacunar.schema import SchemaError, check_points, check_time_series


def make(spark, values=None, y=None, loc=None):
    n = len(next(x for x in (values, y, loc) if x is not None))
    rows = [("s", i, float((values or [0] * n)[i]), (y or [0] * n)[i], (loc or [0] * n)[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, idx long, value double, y int, loc int")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(idx as int))"))


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy(names[0] if "idx" not in df.columns else "idx").collect()]


@pytest.mark.parametrize("y, want, compat", [([1, 0, 1, 1], [(0, 0), (2, 3)], [(0, 0), (2, 3)]), ([0, 1, 1, 0, 1], [(1, 2), (4, 4)], [(1, 2)]), ([0, 0, 1], [(2, 2)], [(2, 2)])])
def test_runs(spark, y, want, compat):
    df = make(spark, y=y)
    assert column(series.pattern_ranges(df), "b", "e") == want
    assert column(series.pattern_ranges(df, compat=True), "b", "e") == compat


@pytest.mark.parametrize("n, w, run, want", [(10, 4, (3, 4), [-1, 1, 1, 1, -1, 0, 0]), (10, 3, (2, 6), [-1, -1, 1, 1, 1, -1, -1, 0]), (8, 4, (0, 1), [1, -1, 0, 0, 0])])
def test_segment_labels(spark, n, w, run, want):
    df = make(spark, y=[int(run[0] <= i <= run[1]) for i in range(n)])
    starts = series.segments(df, w)
    assert column(series.label_segments(starts, series.pattern_ranges(df), w), "idx", "label") == list(enumerate(want))


def test_gap_rule(spark):
    found = spark.createDataFrame([("s", i) for i in (5, 6, 7, 20)], "series_id string, idx long")
    assert column(series.keep_apart(found, 4), "idx") == [5, 20]
    assert column(series.keep_apart(found, 4, compat=True), "idx") == [5, 6, 20]


def test_since_events(spark):
    df = make(spark, values=range(1, 8), loc=[0, 0, 1, 0, 0, 1, 0])
    got = series.last_event(df)
    assert column(got, "gap") and [r["gap"] for r in got.orderBy("idx").collect()] == [0, 1, 0, 1, 2, 0, 1]
    assert [r["usage"] for r in got.orderBy("idx").collect()] == [0, 1, 0, 3, 7, 0, 6]
    assert {(r["kind"], r["v"]) for r in detectors.descriptors(df).collect()} == {("time", 3.0), ("usage", 12.0)}


def test_average_missing(spark):
    df = make(spark, loc=[0, 0, 1, 0, 0, 1, 0, 0, 0, 0])
    got = detectors.average_suspicion(df, detectors.mean_interarrival(df)).orderBy("idx").collect()
    assert [r["pred"] for r in got] == [0] * 9 + [1]


def test_first_of_run(spark):
    df = make(spark, y=[0, 1, 1, 0, 1, 1])
    assert [i for i, p in column(series.first_of_run(df, "y"), "idx", "pred") if p] == [1, 4]


def test_contamination(spark):
    df = spark.createDataFrame([(i, i / 10) for i in range(10)], "id long, score double")
    assert sorted(r["score"] for r in scores.contamination(df, 0.25, []).where("pred = 1").collect()) == [0.7, 0.8, 0.9]
    assert scores.contamination(df, 0.0, []).where("pred = 1").count() == 1


def test_warping(spark):
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1.0, 3.0, 3.0, 5.0])], "a array<double>, b array<double>")
    assert one.select(X.dtw(F.col("a"), F.col("b"))).first()[0] == pytest.approx(math.sqrt(2))
    rng = np.random.default_rng(1)
    for band in (None, 1, 3):
        a, b = rng.normal(size=6).tolist(), rng.normal(size=6).tolist()
        got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(X.dtw(F.col("a"), F.col("b"), band)).first()[0]
        assert got == pytest.approx(numeric.dtw(np.array(a), np.array(b), band))
        assert got <= np.linalg.norm(np.subtract(a, b)) + 1e-12


def test_profile_of_flat_and_equal_windows(spark):
    flat = make(spark, values=[1] * 8 + [5, 2, 7, 1, 9, 3, 8, 2])
    got = {r["idx"]: r["d"] for r in profile.distance_profile(flat, spark.createDataFrame([("s", 0)], "series_id string, start int"), 5).collect()}
    assert got[1] == 0 and got[9] == pytest.approx(2.0)
    assert profile.matrix_profile(flat, 5).where("mp is null").count() == 0
    wave = make(spark, values=[math.sin(i) + (i % 3) for i in range(30)] * 2)
    got = profile.matrix_profile(wave, 6, ddof=0).collect()
    assert min(r["mp"] for r in got) < 1e-5
    assert len(got) == 55


def test_squash_window_size_hour_month_support(spark):
    one = spark.range(1)
    assert one.select(X.squash(F.lit(3.0), 3.0)).first()[0] == pytest.approx(0.5)
    runs = spark.createDataFrame([("s", 0, 0, 1), ("s", 1, 5, 7)], "series_id string, range_id long, b long, e long")
    assert series.window_size(runs).first()["w"] == 2
    six = one.select(*X.hour_code(F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))).first()
    assert six[0] == pytest.approx(1) and six[1] == pytest.approx(0)
    months = spark.createDataFrame([("s", i, f"2023-{m:02d}-01" if m == 12 else f"2024-{m:02d}-01") for i, m in enumerate([12, 12, 1, 1, 2])], "series_id string, idx long, d string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    assert [m for _, m in column(series.month_counter(months), "idx", "month")] == [0, 0, 1, 1, 2]
    assert [v for _, v in column(series.shifted_support(make(spark, y=[1, 1, 1, 1, 0, 0, 0, 0]), 4), "idx", "support")] == [0, 0, 0, 4, 3, 2, 1, 0]


def test_posterior(spark):
    pts = spark.createDataFrame([(1, [0.0], 0.5)], "id long, features array<double>, prior double")
    lab = spark.createDataFrame([(2, [1.0], 1), (3, [-1.0], -1)], "id long, features array<double>, label int")
    assert ensemble.posterior(pts, lab, eta=1.0, alpha=2.0).first()["score"] == pytest.approx(0.5)


def test_routines():
    assert numeric.c_factor(256) == pytest.approx(10.2448, abs=1e-4) and numeric.c_factor(1) == 0
    rng = np.random.default_rng(3)
    x = 40 * (-np.log(1 - rng.uniform(size=400))) ** (1 / 1.8)
    k, lam, low, _ = numeric.weibull_fit(x)
    assert lam * low == pytest.approx(40, rel=0.15) and k == pytest.approx(1.8, rel=0.15)
    a, c, loc, scale, nll = numeric.exponweib_fit(x)
    assert nll <= numeric.exponweib_nll(x, 1.0, 1.8, 0.0, 40.0) + 1.0
    assert numeric.exponweib_quantile(0.5, 1.0, 1.0, 0.0, 1.0) == pytest.approx(math.log(2))
    wave = np.sin(np.arange(200) / 8) + np.sin(np.arange(200) * 2.5)
    assert np.abs(numeric.filtfilt(numeric.butter(4, 0.2), wave) - np.sin(np.arange(200) / 8))[20:-20].max() < 0.05
    up = numeric.fft_resample(np.sin(2 * np.pi * np.arange(20) / 20), 40)
    assert np.allclose(up, np.sin(2 * np.pi * np.arange(40) / 40), atol=1e-9)


def test_machines():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(4, 1, (40, 2))])
    y = np.repeat([-1.0, 1.0], 40)
    k = numeric.kernel(x, x, "linear")
    w, b = numeric.svc(k, y, np.ones(80))
    assert (np.sign(k @ w + b) == y).mean() > 0.95 and abs(w.sum()) < 1e-6
    k = numeric.kernel(x, x, "rbf", gamma=0.5)
    a, rho = numeric.one_class(k, 0.2)
    assert a.sum() == pytest.approx(16) and ((k @ a - rho) < -1e-6).mean() <= 0.25
    lab = np.zeros(80)
    lab[:5], lab[40:45] = 1, -1
    w, rho = numeric.ssad(k, lab)
    cy = np.where(lab >= 0, 1.0, -1.0)
    alpha = w * cy
    assert (alpha * cy).sum() == pytest.approx(1, abs=1e-3) and alpha[lab != 0].sum() >= 1 - 1e-3 and (alpha >= -1e-9).all()
    labels, _ = numeric.kmeans(x, 2, apart=[(0, 79)])
    assert labels[0] != labels[79]
    assert len(np.unique(numeric.spectral(k, 2)[:40])) == 1


def test_outlier_stands_out(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).tolist(), 0) for i in range(60)] + [(60, [9.0, 9.0, 9.0], 1)]
    pts = spark.createDataFrame(rows, "id long, features array<double>, label int")
    for got in (neighbors.knno(pts, 5), neighbors.lof(pts, 5), neighbors.inne(pts, 20, 8), ensemble.isolation_forest(pts, 30), ensemble.one_class_svm(pts, nu=0.2)):
        top = got.orderBy(F.desc("score")).first()
        assert top["pred"] == 1
        assert got.where("id = 60").first()["pred"] == 1
        assert got.agg(F.min("score")).first()[0] >= 0 and got.agg(F.max("score")).first()[0] <= 1
    assert ensemble.semi_supervised(pts, clusters=3, k=5).where("id = 60").first()["pred"] == 1


def test_params_and_schema(spark):
    d = detectors.AbsenceDetector(detector=detectors.FingerprintDetector(w=4))
    assert d.get_params()["detector__w"] == 4
    assert d.set_params(detector__w=5, missing_alpha=0.9).detector.w == 5
    with pytest.raises(ValueError):
        d.set_params(nothing=1)
    with pytest.raises(NotImplementedError):
        detectors.DiscordDetector(missing_classifier="WCAD").fit(None)
    with pytest.raises(SchemaError):
        check_time_series(spark.createDataFrame([(1,)], "a int"))
    assert check_points(spark.createDataFrame([(1, 2.0)], "id long, features double")).first()["features"] == [2.0]


def test_absence_is_found(spark):
    """A weekly pattern, once left out, is flagged once, after it failed to come."""
    at = [i for k, i in enumerate(range(10, 400, 24)) if k != 12]
    df = make(spark, values=[1.0] * 400, loc=[int(i in at) for i in range(400)])
    model = detectors.fit_weibull(detectors.descriptors(df.where("idx < 250")), "time")
    rows = detectors.suspicion(df, model).where("pred = 1").collect() if model.first()["kind"] != "average" else detectors.average_suspicion(df, detectors.mean_interarrival(df)).where("pred = 1 and idx < 346").collect()
    missing = 10 + 12 * 24
    assert rows and all(missing < r["idx"] < missing + 24 or r["idx"] > 390 for r in rows)


def test_generator(spark):
    shapes = spark.createDataFrame([("a", [5.0, 6.0, 7.0])], "k string, shape array<double>")
    df = make(spark, values=[0.0] * 600)
    got = generate.insert_by_time(df, shapes, gap=48.0)
    runs = series.pattern_ranges(got, "loc")
    assert runs.count() >= 2
    assert got.where("loc = 1").agg(F.min("value")).first()[0] >= 5.0
    assert generate.insert_by_usage(make(spark, values=[1.0] * 300), [[5.0, 6.0]], usage=20.0).where("loc = 1").count() > 0


def test_order_statistic_is_exact(spark):
    import random

    from lacunar.operators import scores

    rng = random.Random(7)
    for values in ([1.0], [2.0, 2.0, 2.0], [rng.choice([0.0, 1e-300, 1e-9, 1.0, 1.0 + 2**-52, 1e12, -5.0]) for _ in range(300)], [rng.gauss(0, 1) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for share in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert scores.order_statistic(df, "x", share) == sorted(values)[min(int(len(values) * share), len(values) - 1)]
    df = spark.createDataFrame([(None,), (None,), (3.0,), (4.0,)], "x double")
    assert scores.order_statistic(df, "x", 0.25) is None and scores.order_statistic(df, "x", 0.5) == 3.0
    assert scores.contamination(df.limit(0), 0.1, [], "x").collect() == []


def test_profile_does_not_depend_on_its_blocks(spark):
    import random

    from lacunar.operators import profile

    rng = random.Random(3)
    df = spark.createDataFrame([("a", i, rng.random()) for i in range(130)] + [("b", i, 1.0) for i in range(40)], "series_id string, idx long, value double")
    want = {(r["series_id"], r["idx"]): round(r["mp"], 9) for r in profile.matrix_profile(df, 7).collect()}
    got = {(r["series_id"], r["idx"]): round(r["mp"], 9) for r in profile.matrix_profile(df, 7, block=16).collect()}
    assert got == want and len(want) == 124 + 34


def test_point_detector_takes_each_series_alone(spark):
    import random

    from lacunar.plans.detectors import ADBase

    rng = random.Random(5)
    rows = [(s, i, "2024-01-01 00:00:00", rng.random() + (s == "b"), int(i % 24 == 7)) for s in "ab" for i in range(96)]
    df = spark.createDataFrame(rows, "series_id string, idx long, ts string, value double, y int").selectExpr("series_id", "idx", "cast(ts as timestamp_ntz) as ts", "value", "y")
    both = {(r["series_id"], r["idx"]): (round(r["score"], 9), r["pred"]) for r in ADBase(features="stat").fit_predict(df).collect()}
    alone = {(r["series_id"], r["idx"]): (round(r["score"], 9), r["pred"]) for s in "ab" for r in ADBase(features="stat").fit_predict(df.where(f"series_id = '{s}'")).collect()}
    assert both == alone and len(both) == 192
    import pytest

    with pytest.raises(ValueError):
        ADBase(features="stat", missing_classifier="IF").fit_predict(df)


def test_fingerprints_of_other_rows(spark):
    """Shapes, windows and limits come from the labels of each series; other rows need none."""
    shapes = {"a": [0.0, 5.0, 9.0, 5.0, 0.5, 1.0], "b": [9.0, 4.0, 1.0, 7.0]}
    rows, starts = [], {}
    for s, shape in shapes.items():
        rng = np.random.default_rng(len(shape))
        values = rng.normal(0, 1, 260)
        starts[s] = list(range(10, 240, 40))
        for k, b in enumerate(starts[s]):
            values[b : b + len(shape)] = np.array(shape) * 10 + 0.1 * (k % 3) * np.arange(len(shape)) ** 2  # later ones are like labelled ones
        rows += [(s, i, float(v), int(any(b <= i < b + len(shape) for b in starts[s][:4]))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, idx long, value double, y int").withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(idx as int))"))
    sizes = detectors.learnt_sizes(df, series.pattern_ranges(df))
    assert {r["series_id"]: r["w"] for r in sizes.collect()} == {"a": 6, "b": 4}
    train, later = df.where("idx < 160"), df.where("idx >= 160").withColumn("idx", F.col("idx") - 160).drop("y")
    for kind in ("dtw", "feature"):
        d = detectors.FingerprintDetector(detector_type=kind, features="stat").fit_fingerprints(train)
        got = {(r["series_id"], r["idx"]) for r in d.predict_fingerprints(later).where("loc = 1").collect()}
        for s, shape in shapes.items():
            w = len(shape)
            want = [b - 160 + w // 2 - 1 for b in starts[s] if b >= 160]
            assert all(any(x == s and abs(i - p) <= 2 for x, i in got) for p in want), (kind, s, got)
    whole = detectors.FingerprintDetector().fit_predict_fingerprints(train).where("loc = 1").groupBy("series_id").count().collect()
    assert all(r["count"] >= 4 for r in whole) and len(whole) == 2
    absent = detectors.AverageMissing().fit(train).predict(later)
    assert absent.columns == ["series_id", "idx", "ts", "loc", "prob", "pred"] and absent.count() == later.count()
    with pytest.raises(ValueError):
        detectors.FingerprintDetector(detector_type="none").fit_fingerprints(train)


ODD_PAIRS = {
    "euclidean": (lambda x, y: neighbors.distances(x, y, "euclidean"), lambda x, y: X.distance(x, y, "euclidean")),
    "manhattan": (lambda x, y: neighbors.distances(x, y, "manhattan"), lambda x, y: X.distance(x, y, "manhattan")),
    "minkowski": (lambda x, y: neighbors.distances(x, y, "minkowski"), lambda x, y: X.distance(x, y, "minkowski")),
    "linear": (lambda x, y: numeric.kernel(x, y, "linear"), X.dot),
    "rbf": (lambda x, y: np.exp(-(neighbors.distances(x, y) ** 2) / 2.0), lambda x, y: X.rbf(x, y, 2.0)),
    "cosine": (lambda x, y: neighbors.distances(x, y, "cosine"), lambda x, y: X.distance(x, y, "cosine")),
}


@pytest.mark.parametrize("kind", ODD_PAIRS)
def test_pairs_equal_the_column_functions_on_odd_vectors(spark, kind):
    measure, column_of = ODD_PAIRS[kind]
    rows = [(i, np.random.default_rng(i).normal(size=3).tolist(), i % 3 - 1) for i in range(40)]
    rows += [(100, rows[2][1], 1), (101, None, 1), (102, [1.0, None, 2.0], 1), (103, [1.0, 2.0], 1), (104, [0.0, 0.0, 0.0], 1), (105, [math.nan, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1)]
    p = spark.createDataFrame(rows, "id long, features array<double>, label int")
    some = p.where("label = 1").select(F.col("id").alias("other"), F.col("features").alias("y"))
    both = p.select("id", F.col("features").alias("x")).join(some, F.col("id") != F.col("other"))
    want = {(r["id"], r["other"]): r["d"] for r in both.select("id", "other", F.when(F.size("x") == F.size("y"), column_of(F.col("x"), F.col("y"))).alias("d")).collect()}
    for i, o in want:
        if {i, o} & {101, 102}:  # a null within is null
            want[i, o] = None
    for block in (7, 1024):
        got = {(r["id"], r["other"]): r["d"] for r in neighbors.pairs(p, p.where("label = 1"), measure, block=block).collect()}
        assert got.keys() == want.keys()
        for k, d in want.items():
            assert (got[k] is None) == (d is None) and (d is None or np.isclose(got[k], d, atol=1e-9, equal_nan=True)), (k, got[k], d)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_distance_queries_make_no_row_pairs_in_the_plan(spark):
    """Rows meet as blocks: the plans of joins by row had not ended over 10,256 points."""
    from lacunar.plans import catalog

    for name in BY_BLOCKS:
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "collect_list" in plan, name


BY_BLOCKS = ["dis_3_euclidean", "dis_6_manhattan", "dis_6_minkowski", "dis_7_linear_kernel", "dis_8_rbf_kernel", "dis_5_angular"]


def test_sided_clusters_equal_clusters_of_all_pairs():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x, sides = rng.normal(size=(90, 4)), rng.integers(-1, 2, 90) if seed else np.ones(90, int)
        pairs = [(int(i), int(j)) for i in np.flatnonzero(sides == 1) for j in np.flatnonzero(sides == -1)]
        want, got = numeric.kmeans(x, 2 + seed % 5, apart=pairs), numeric.kmeans(x, 2 + seed % 5, sides=sides)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    many = np.random.default_rng(1).normal(size=(22_000, 4))  # 121 million pairs
    labels, _ = numeric.kmeans(many, 6, sides=np.tile([1, -1], 11_000), rounds=3)
    assert len(labels) == 22_000


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_equal_brute_force_with_copies(spark, metric):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(60, 3)), np.ones((25, 3)), rng.normal(size=(5, 3))])
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    d = neighbors.distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(90), d.shape), d), axis=1)[:, :7]
    for block in (8, 1024):
        got = {(r["id"], r["rank"]): r["other"] for r in neighbors.knn(pts, pts, 7, metric, block=block).collect()}
        assert got == {(i, j + 1): int(want[i, j]) for i in range(90) for j in range(7)}


def test_semi_supervised_machine_without_a_whole_kernel(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), -1 if i < 150 else 0) for i in range(260)] + [(300 + i, (rng.normal(size=4) + 4).tolist(), 1) for i in range(40)]
    pts = spark.createDataFrame(rows, "id long, features array<double>, label int")
    x = np.array([r[1] for r in rows])
    w = rng.normal(size=300)
    assert np.allclose(ensemble._products(spark, x, "rbf", 0.1)(w), numeric.kernel(x, x, "rbf", 0.1) @ w)
    for kind, gamma in (("linear", 0.1), ("rbf", 50.0), ("poly", 0.1)):  # 50: out of the range of the factors
        assert np.allclose(numeric.kernel_times(x, x, w, kind, gamma), numeric.kernel(x, x, kind, gamma) @ w)
    assert numeric.top_eigenvalue(lambda z: x @ (x.T @ z), 300) == pytest.approx(np.linalg.eigvalsh(x @ x.T)[-1], rel=2e-3)
    want = {r["id"]: (r["score"], r["pred"]) for r in ensemble.ssad(pts, width=8.0).collect()}
    whole, most = numeric.kernel, []
    monkeypatch.setattr(ensemble, "WHOLE", 10)
    monkeypatch.setattr(ensemble, "_products", lambda _, x, kind, gamma: lambda z: numeric.kernel_times(x, x, z, kind, gamma))  # a job for each would take a minute
    monkeypatch.setattr(numeric, "kernel", lambda x, y, *more: most.append(len(x)) or whole(x, y, *more))
    got = {r["id"]: (r["score"], r["pred"]) for r in ensemble.ssad(pts, width=8.0).collect()}
    assert max(most, default=0) <= 256 and got.keys() == want.keys()
    for i, (score, pred) in got.items():
        assert pred == want[i][1] and score == pytest.approx(want[i][0], abs=2e-3)


@pytest.mark.parametrize("held", [4200, 4199])
def test_cluster_prior_takes_all_points(spark, monkeypatch, held):
    import hashlib

    monkeypatch.setattr(ensemble, "HELD", held)
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=3).tolist(), int(rng.choice([0, 0, 0, 0, 0, 0, 1, -1]))) for i in range(4200)]
    pts = spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(3)
    rows.sort(key=lambda r: hashlib.md5(f"cop:{r[0]}".encode()).hexdigest())
    x = np.array([r[1] for r in rows])
    _, c = numeric.kmeans(x, 6, sides=np.array([r[2] for r in rows]))
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    k, gap = d.argmin(1), np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.diag(np.full(6, np.inf))
    radius, n = np.array([d[k == j, j].max() for j in range(6)]), np.bincount(k, minlength=6)
    want = d.min(1) / radius[k] * (gap.min(1) / gap.min(1).max())[k] / (n / n.max())[k]
    got = {r["id"]: r["prior"] for r in ensemble.cluster_prior(pts, 6).collect()}
    assert len(got) == 4200 and np.allclose([got[r[0]] for r in rows], want, rtol=1e-9)
    for part in (pts.where("label = 0"), pts.where("label <> 0"), pts.where("id < 3")):  # no labels, nothing else, fewer points than clusters
        assert ensemble.cluster_prior(part, 6).count() == part.count()


@pytest.mark.parametrize("query", ["est_8_ssad", "est_9_convex_ssad", "flt_8_support_vectors"])
def test_semi_supervised_machine_is_fitted_on_all_points(spark, monkeypatch, query):
    from lacunar.plans import catalog, q_estimators

    rng = np.random.default_rng(13)
    x = rng.normal(size=(1500, 5)) * [1, 1, 0.3, 0.3, 0.1]
    y = np.where(np.arange(1500) < 120, -1, np.where(np.arange(1500) < 200, 1, 0))
    pts = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label int").repartition(3)
    monkeypatch.setattr(q_estimators, "points", lambda spark, d: pts)
    fit, fitted = numeric.ssad_fit, []
    monkeypatch.setattr(numeric, "ssad_fit", lambda k, y, *more, **named: fitted.append(y) or fit(k, y, *more, **named))
    got = {r["id"]: r["score"] for r in catalog.queries()[query](spark, "").collect()}
    assert len(got) == 1500 and len(fitted) == 1 and sorted(fitted[0]) == sorted(-y)


def test_semi_supervised_machine_reaches_the_least_value():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(250, 4)) / 4
    y = np.where(np.arange(250) < 30, 1.0, np.where(np.arange(250) < 50, -1.0, 0.0))
    cy = np.where(y >= 0, 1.0, -1.0)
    for gamma, far, tol in ((0.05, False, 1e-5), (0.05, True, 1e-5), (2.0, False, 1e-3)):  # narrow kernels end by their rounds
        k, near = numeric.kernel(x, x, "rbf", gamma), numeric.moments(x, gamma)
        z = rng.normal(size=250)
        if far:
            assert abs(near[0](z) - k @ z).max() <= near[1] * abs(z).sum()
        w, _, s = numeric.ssad_fit(k, y, near=near if far else None)
        a, g = w * cy, cy * (k @ w)
        assert np.allclose(s, k @ w) and w.sum() == pytest.approx(1) and a[y != 0].sum() >= 1 - 1e-6 and a.min() >= 0 and a.max() <= 1
        # the least of the linear problem: p of the normals, q of the anomalies, 1 + q - p of the others, p + q >= 1
        p, q, u = (np.append(0, np.cumsum(np.repeat(np.sort(g[y == v]) / 2, 2))) for v in (1, -1, 0))  # by halves
        best = min(p[i] + q[j] + u[2 + j - i] for i in range(len(p)) for j in range(len(q)) if i + j >= 2 and 0 <= 2 + j - i < len(u))
        assert a @ g - best <= tol * (a @ g) / 2
