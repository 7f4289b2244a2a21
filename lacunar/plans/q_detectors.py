"""Queries: point detectors and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble, neighbors, scores
from .base import POINTS, SERIES, frame, hourly, islands, points
from .catalog import query
from .detectors import ADBase, AverageMissing, FingerprintDetector, AbsenceDetector, DiscordDetector, PatternDetector
from .q_distances import _DTW, _KNN, dtw_sql, mp_sql
from .q_series import _LAST, _MEAN, A, apart_sql, contamination_sql, sample_sql, z_sql

SCORE = "id i, score d, pred i"


def minmax_sql(col: str, over: str = "") -> str:
    return f"CASE WHEN max({col}) OVER ({over}) > min({col}) OVER ({over}) THEN ({col} - min({col}) OVER ({over})) / (max({col}) OVER ({over}) - min({col}) OVER ({over})) ELSE 0 END"


@query("est_1_knno", SCORE, f"{_KNN}, scored AS (SELECT id, {minmax_sql('d')} AS score FROM (SELECT id, d FROM knn WHERE rank = 10)) {contamination_sql('scored', 0.1)}")
def _(spark, d):
    return neighbors.knno(points(spark, d))


_LOF = f"""{POINTS}, pairs AS (SELECT a.id, b.id AS other, list_distance(a.features, b.features) AS d FROM pts a JOIN pts b ON true),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM pairs QUALIFY rank <= 10),
  dens AS (SELECT n.id, 1 / (avg(greatest(n.d, k.d)) + 1e-10) AS lrd FROM near n JOIN near k ON k.id = n.other AND k.rank = 10 GROUP BY 1),
  lofs AS (SELECT n.id, avg(o.lrd / m.lrd) AS lof FROM near n JOIN dens o ON o.id = n.other JOIN dens m ON m.id = n.id GROUP BY 1),
  scored AS (SELECT id, lof, {minmax_sql('lof')} AS score FROM lofs)"""


@query("est_2_lof", "id i, lof d, score d, pred i", f"{_LOF} {contamination_sql('scored', 0.1)}")
def _(spark, d):
    return neighbors.lof(points(spark, d))


_SPHERES = f"""{POINTS}, drawn AS ({sample_sql('pts', 100, 16, 'iNNe')}), centres AS (SELECT d.member, p.* FROM drawn d JOIN pts p USING (id)),
  gaps AS (SELECT a.member, a.id, b.id AS nn, list_distance(a.features, b.features) AS d FROM centres a JOIN centres b ON a.member = b.member AND a.id <> b.id),
  radii AS (SELECT member, id, min(d) AS radius, arg_min(nn, (d, nn)) AS nn FROM gaps GROUP BY 1, 2),
  spheres AS (SELECT a.member, a.id, a.radius, 1 - CASE WHEN a.radius > 0 THEN b.radius / a.radius ELSE 1 END AS ratio FROM radii a JOIN radii b ON b.member = a.member AND b.id = a.nn)"""


@query("est_6_hyperspheres", "member i, id i, radius d, ratio d", f"{_SPHERES} SELECT * FROM spheres")
def _(spark, d):
    return neighbors.hyperspheres(points(spark, d), 100, 16)


_INNE = f"""{_SPHERES}, tied AS (SELECT p.id, s.member, s.id AS centre, s.radius, s.ratio, list_distance(p.features, c.features) AS d FROM pts p JOIN spheres s ON true JOIN pts c ON c.id = s.id),
  best AS (SELECT id, member, arg_min(CASE WHEN d <= radius * (1 + 1e-12) THEN ratio ELSE 1 END, (d, centre)) AS s FROM tied GROUP BY 1, 2), scored AS (SELECT id, avg(s) AS score FROM best GROUP BY 1)"""


@query("joi_5_nearest_sphere", "id i, score d", f"{_INNE} SELECT * FROM scored")
@query("agg_11_isolation_mean", "id i, score d", f"{_INNE} SELECT * FROM scored")
@query("est_6_inne", "id i, score d", f"{_INNE} SELECT * FROM scored")
def _(spark, d):
    return neighbors.inne(points(spark, d), 100, 16)


_ETA = f"{_KNN.replace('rank <= 10', 'rank <= 30')}, kd AS (SELECT d FROM knn WHERE rank = 30), eta AS (SELECT greatest(1e-8, count(*) / sum(1 / CASE WHEN d > 0 THEN d ELSE (SELECT min(d) FROM kd WHERE d > 0) END)) AS eta FROM kd)"


@query("agg_7_harmonic_eta", "eta d", f"{_ETA} SELECT eta FROM eta")
def _(spark, d):
    return ensemble.harmonic_eta(points(spark, d))


def _prior(p):
    return p.withColumn("prior", F.pmod(F.col("id"), F.lit(97)) / 97.0)


_SUMS = """near2 AS (SELECT p.id, p.prior, l.label, pow(2, -pow(list_distance(p.features, l.features) / (SELECT eta FROM eta), 2)) AS s FROM priors p JOIN pts l ON l.label <> 0),
  sums AS (SELECT id, any_value(prior) AS prior, coalesce(sum(s) FILTER (label = 1), 0) AS da, coalesce(sum(s) FILTER (label = -1), 0) AS dn FROM near2 GROUP BY 1)"""
_POST = f"{_ETA}, priors AS (SELECT id, features, (id % 97) / 97.0::DOUBLE AS prior FROM pts), {_SUMS}"


@query("joi_7_label_distances", "id i, score d", f"{_POST} SELECT id, (prior + 2.3 * da) / (1 + 2.3 * (da + dn)) AS score FROM sums")
@query("est_7_semi_supervised_posterior", "id i, score d", f"{_POST} SELECT id, (prior + 2.3 * da) / (1 + 2.3 * (da + dn)) AS score FROM sums")
def _(spark, d):
    p = _prior(points(spark, d))
    eta = ensemble.harmonic_eta(p).first()["eta"]
    return ensemble.posterior(p, p.where("label <> 0"), eta)


@query("est_7_semi_supervised_other_prior", SCORE, f"""{_ETA}, raw AS (SELECT id, features, {minmax_sql('(id * 37 % 101)')} AS score FROM pts), lim AS (SELECT min(score) AS g FROM ({contamination_sql('raw', 0.1)}) WHERE pred = 1),
  priors AS (SELECT id, features, 1 - pow(2, -pow(score / ((SELECT g FROM lim) + 1e-8), 2)) AS prior FROM raw), {_SUMS},
  scored AS (SELECT id, (prior + 2.3 * da) / (1 + 2.3 * (da + dn)) AS score FROM sums) {contamination_sql('scored', 0.1)}""")  # fmt: skip
def _(spark, d):
    p = points(spark, d)
    return ensemble.semi_supervised(p, base="other", prior=p.select("id", (F.col("id") * 37 % 101).cast("double").alias("score")))


@query("est_7_semi_supervised", SCORE)
def _(spark, d):
    return ensemble.semi_supervised(points(spark, d))


_CLUSTERED = f"{POINTS}, cl AS (SELECT id, id % 5 AS c, features[1] AS x FROM pts), mids AS (SELECT c, avg(x) AS m, count(*) AS n FROM cl GROUP BY 1)"


@query("agg_5_cluster_sizes", "c i, share d", f"{_CLUSTERED} SELECT c, n / max(n) OVER () AS share FROM mids")
def _(spark, d):
    n = points(spark, d).groupBy((F.col("id") % 5).alias("c")).count()
    top = n.agg(F.max("count").alias("top"))  # one row
    return n.crossJoin(F.broadcast(top)).withColumn("share", F.col("count") / F.col("top"))


@query("agg_6_cluster_spread", "c i, intra d, deviation d", f"{_CLUSTERED}, intra AS (SELECT c, max(abs(x - m)) AS intra FROM cl JOIN mids USING (c) GROUP BY 1), inter AS (SELECT a.c, min(abs(a.m - b.m)) AS d FROM mids a JOIN mids b ON a.c <> b.c AND abs(a.m - b.m) >= 1e-8 GROUP BY 1) SELECT c, intra, d / max(d) OVER () AS deviation FROM intra JOIN inter USING (c)")
def _(spark, d):
    cl = points(spark, d).select((F.col("id") % 5).alias("c"), F.col("features")[0].alias("x"))
    mids = cl.groupBy("c").agg(F.avg("x").alias("m"))  # a row a cluster
    intra = cl.join(F.broadcast(mids), "c").groupBy("c").agg(F.max(F.abs(F.col("x") - F.col("m"))).alias("intra"))
    gap = F.abs(F.col("m") - F.col("m2"))
    inter = mids.crossJoin(F.broadcast(mids.select(F.col("c").alias("c2"), F.col("m").alias("m2")))).where((F.col("c") != F.col("c2")) & (gap >= 1e-8)).groupBy("c").agg(F.min(gap).alias("d"))
    return intra.join(inter, "c").crossJoin(F.broadcast(inter.agg(F.max("d").alias("top")))).withColumn("deviation", F.col("d") / F.col("top"))


@query("agg_9_bagging_vote", "id i, prob d, pred i", f"{POINTS}, votes AS (SELECT id, CASE WHEN features[1 + b % 8] > 0 THEN 1 ELSE 0 END AS v FROM pts, range(7) t(b)), m AS (SELECT id, avg(v) AS p FROM votes GROUP BY 1), s AS (SELECT id, {minmax_sql('p')} AS prob FROM m) SELECT id, prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM s")
def _(spark, d):
    b = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("b")
    votes = points(spark, d).select("id", "features", b).select("id", (F.element_at("features", F.col("b") % 8 + 1) > 0).cast("int").alias("pred"))
    return scores.vote(votes, ["id"])


@query("agg_10_forest_score", "id i, score d", f"{POINTS}, paths AS (SELECT id, 3 + (id * (t + 1)) % 11 AS path FROM pts, range(20) x(t)) SELECT id, pow(2, -avg(path) / (2 * (ln(255) + 0.5772156649) - 2 * 255 / 256.0::DOUBLE)) AS score FROM paths GROUP BY 1")
def _(spark, d):
    from ..functions.numeric import c_factor

    t = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("t")
    paths = points(spark, d).select("id", t).select("id", (3 + F.col("id") * (F.col("t") + 1) % 11).alias("path"))
    return paths.groupBy("id").agg(F.pow(F.lit(2.0), -F.avg("path") / c_factor(256)).alias("score"))


# whole pipelines


_FOUND = f"""{_DTW.replace('WITH', 'WITH RECURSIVE', 1)}, limits AS (SELECT series_id, max(d) AS lim FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d, i, j) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM matrix) WHERE r <= floor(n * 0.9) GROUP BY 1),
  segs AS (SELECT series_id, idx, list(value) {frame(3)} AS seg FROM series QUALIFY count(*) {frame(3)} = 3),
  zsegs AS (SELECT series_id, idx, CASE WHEN list_stddev_pop(seg) > 1e-12 THEN {z_sql('seg')} ELSE list_transform(seg, lambda v: 0.0::DOUBLE) END AS zg FROM segs),
  near AS (SELECT g.series_id, g.idx, min({dtw_sql('g.zg', 't.z')}) AS d FROM zsegs g JOIN zs t ON t.series_id = g.series_id GROUP BY 1, 2),
  hits AS (SELECT n.series_id, n.idx FROM near n JOIN limits l ON l.series_id = n.series_id AND n.d < l.lim), runs AS {islands('hits', 'true')},
  odd AS (SELECT series_id, max(e - b + 1) AS top, sum(e - b + 1) AS hits FROM runs GROUP BY 1), fine AS (SELECT o.series_id FROM odd o WHERE o.top <= 10 * (SELECT avg(e - b + 1) FROM ranges r WHERE r.series_id = o.series_id) AND o.hits < (SELECT count(*) FROM near n WHERE n.series_id = o.series_id) - 3),
  found AS (SELECT series_id, (b + e) // 2 AS idx FROM runs WHERE series_id IN (SELECT series_id FROM fine)), {apart_sql('found', 3, 'kept')},
  placed AS (SELECT series_id, idx FROM kept UNION SELECT r.series_id, (r.b + r.e) // 2 FROM ranges r WHERE (SELECT count(*) FROM kept k WHERE k.series_id = r.series_id) < (SELECT count(*) FROM ranges q WHERE q.series_id = r.series_id))"""  # fmt: skip
_LOCS = "SELECT s.*, CASE WHEN k.idx IS NULL THEN 0 ELSE 1 END AS loc FROM series s LEFT JOIN placed k ON k.series_id = s.series_id AND k.idx = s.idx"


@query("pip_2_fingerprint_detector", "series_id s, idx i, loc i", f"{_FOUND} {_LOCS}")
def _(spark, d):
    return FingerprintDetector(w=3).fit_predict_fingerprints(hourly(spark, d))


@query("pip_2_fingerprint_features", "series_id s, idx i, loc i")
def _(spark, d):
    return FingerprintDetector(detector_type="feature").fit_predict_fingerprints(hourly(spark, d))


@query("pip_2_fingerprint_of_later_rows", "series_id s, idx i, loc i")
def _(spark, d):
    df = hourly(spark, d)
    return FingerprintDetector().fit_fingerprints(df).predict_fingerprints(df.drop("y"))


@query("pip_1_pattern_detector", "series_id s, idx i, loc i")
def _(spark, d):
    return PatternDetector(features="stat_time", rounds=20).fit_predict_occurrences(hourly(spark, d))


@query("pip_3_absence_detector", A)
def _(spark, d):
    return AbsenceDetector().fit_predict(hourly(spark, d))


@query("pip_4_average_missing_detector", A, f"{_FOUND}, located AS ({_LOCS}), {_MEAN}, {_LAST} SELECT s.series_id, s.idx, s.ts, s.loc, CASE WHEN s.gap > m.mean THEN 1 ELSE 0 END AS prob, CASE WHEN s.gap > m.mean THEN 1 ELSE 0 END AS pred FROM since s LEFT JOIN mean_gap m ON m.series_id = s.series_id")
def _(spark, d):
    return AverageMissing(detector=FingerprintDetector(w=3)).fit_predict(hourly(spark, d))


def _one(spark, d):
    """All event types as one series of hourly sums: one table, one series."""
    df = hourly(spark, d)
    return df.groupBy("idx", "ts").agg(F.round(F.sum("value"), 3).alias("value"), F.max("y").alias("y")).withColumn("series_id", F.lit("all"))


_ALL = f"{SERIES}, one AS (SELECT 'all' AS series_id, idx, ts, round(sum(value), 3) AS value FROM series GROUP BY idx, ts)"
_F = f"avg(value) {frame(24)}, stddev_pop(value) {frame(24)}, var_pop(value) {frame(24)}, max(value) {frame(24)}, min(value) {frame(24)}, median(value) {frame(24)}, sum(value) {frame(24)}, skewness(value) {frame(24)}, kurtosis(value) {frame(24)}, sin(2 * pi() * hour(ts) / 24), cos(2 * pi() * hour(ts) / 24)"


def _adbase(score: str) -> str:
    cols = [f"f[{k}]" for k in range(1, 12)]
    return f"""{_ALL}, raw AS (SELECT idx AS id, [{_F}] AS f FROM one QUALIFY count(*) {frame(24)} = 24),
  pts AS (SELECT id, [{', '.join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)" for c in cols)}] AS features FROM raw), {score}
  SELECT o.idx, coalesce(g.score, 0) AS score, coalesce(g.pred, -1) AS pred FROM one o LEFT JOIN ({contamination_sql('scored', 0.1)}) g ON g.id = o.idx"""


@query("pip_5_adbase_knno", "idx i, score d, pred i", _adbase(f"{_KNN[len(POINTS) + 2 :]}, scored AS (SELECT id, {minmax_sql('d')} AS score FROM knn WHERE rank = 10)"))
def _(spark, d):
    return ADBase().fit_predict(_one(spark, d))


_EACH = ", ".join(f"coalesce((f[{k}] - avg(f[{k}]) OVER w) / nullif(stddev_pop(f[{k}]) OVER w, 0), 0)" for k in range(1, 12))


@query("pip_5_adbase_many_series", "series_id s, idx i, score d, pred i", f"""{SERIES}, raw AS (SELECT series_id, idx AS id, [{_F}] AS f FROM series QUALIFY count(*) {frame(24)} = 24),
  pts AS (SELECT series_id, id, [{_EACH}] AS features FROM raw WINDOW w AS (PARTITION BY series_id)),
  pairs AS (SELECT a.series_id, a.id, b.id AS other, list_distance(a.features, b.features) AS d FROM pts a JOIN pts b ON a.series_id = b.series_id AND a.id <> b.id),
  kth AS (SELECT series_id, id, d FROM pairs QUALIFY row_number() OVER (PARTITION BY series_id, id ORDER BY d, other) = 10),
  scored AS (SELECT series_id, id, {minmax_sql('d', 'PARTITION BY series_id')} AS score FROM kth)
  SELECT o.series_id, o.idx, coalesce(g.score, 0) AS score, coalesce(g.pred, -1) AS pred FROM series o LEFT JOIN ({contamination_sql('scored', 0.1, 'score', 'series_id')}) g ON g.series_id = o.series_id AND g.id = o.idx""")  # fmt: skip
def _(spark, d):
    return ADBase().fit_predict(hourly(spark, d))


@query("pip_5_adbase_lof", "idx i, score d, pred i", _adbase(_LOF[len(POINTS) + 2 :]))
def _(spark, d):
    return ADBase(missing_classifier="LOF").fit_predict(_one(spark, d))


@query("pip_5_adbase_if", "idx i, score d, pred i")
def _(spark, d):
    return ADBase(missing_classifier="IF").fit_predict(_one(spark, d))


@query("pip_5_adbase_ssad", "idx i, score d, pred i")
def _(spark, d):
    return ADBase(missing_classifier="SSAD").fit_predict(_one(spark, d))


@query("pip_5_adbase_semi_supervised", "idx i, score d, pred i")
def _(spark, d):
    return ADBase(missing_classifier="semi_supervised").fit_predict(_one(spark, d))


@query("pip_6_discord_detector", "series_id s, idx i, score d, pred i", f"""{SERIES}, {mp_sql(24)}, scaled AS (SELECT series_id, idx, {minmax_sql('mp', 'PARTITION BY series_id')} AS mp FROM mp), filled AS (SELECT s.series_id, s.idx, round(coalesce(m.mp, 0), 9) AS score FROM series s LEFT JOIN scaled m USING (series_id, idx)),
  judged AS ({contamination_sql('filled', 0.1, 'score', 'series_id')}) SELECT series_id, idx - 400 AS idx, score, pred FROM judged WHERE idx >= 400""")  # fmt: skip
def _(spark, d):
    df = hourly(spark, d)
    return DiscordDetector().fit(df.where("idx < 400")).predict_suspicion(df.where("idx >= 400").withColumn("idx", F.col("idx") - 400))

