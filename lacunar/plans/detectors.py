"""Detectors of absent patterns and their parts, as fit and predict over tables.

A table may hold many series; every step is partitioned by series_id. Iterative
fits see one series at a time (its labelled runs and a bounded sample of its
segments); everything else is built-in expressions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import numeric
from ..operators import scores, series


class Params:
    """Hyper-parameters as attributes; nested ones by name__inner."""

    def __init__(self, **values):
        for k, v in {**self.defaults, **values}.items():
            if k not in self.defaults:
                raise ValueError(f"unknown parameter: {k}")
            setattr(self, k, v)

    defaults: dict = {}

    def get_params(self, deep: bool = True) -> dict:
        out = {k: getattr(self, k) for k in self.defaults}
        for k, v in list(out.items()) if deep else []:
            if isinstance(v, Params):
                out |= {f"{k}__{i}": x for i, x in v.get_params().items()}
        return out

    def set_params(self, **values):
        for k, v in values.items():
            name, _, inner = k.partition("__")
            if name not in self.defaults:
                raise ValueError(f"unknown parameter: {k}")
            getattr(self, name).set_params(**{inner: v}) if inner else setattr(self, name, v)
        return self


# segment features

STATS = ("avg", "std", "vari", "maxi", "mini", "med", "tsum", "skew", "kurt")


def stat_features(df: DataFrame, w: int) -> DataFrame:
    """(series_id, idx, ts, and STATS) of all full windows of w values.

    Skewness and excess kurtosis are bias-corrected; those of flat windows, and
    of windows too short for the correction, are 0.
    """
    o = series.ahead(w)
    v = F.col("value")
    cols = {"avg": F.avg(v), "std": F.stddev_pop(v), "vari": F.var_pop(v), "maxi": F.max(v), "mini": F.min(v), "med": F.percentile(v, 0.5), "tsum": F.sum(v), "_g1": F.skewness(v), "_g2": F.kurtosis(v), "_n": F.count(F.lit(1))}
    out = df.withColumns({k: c.over(o) for k, c in cols.items()}).where(F.col("_n") == w)
    flat = F.col("vari") < 1e-20
    g1 = F.col("_g1") * (np.sqrt(w * (w - 1.0)) / (w - 2.0)) if w > 2 else F.lit(0.0)
    g2 = (w - 1.0) / ((w - 2.0) * (w - 3.0)) * ((w + 1.0) * F.col("_g2") + 6.0) if w > 3 else F.lit(0.0)
    return out.withColumns({"skew": F.when(flat, 0.0).otherwise(g1), "kurt": F.when(flat, 0.0).otherwise(g2)}).select("series_id", "idx", "ts", *STATS)


def shape_distances(seg: DataFrame, templates: DataFrame, band: int | None) -> DataFrame:
    """(series_id, idx, shapes array): warped distances of each z-normed segment to its series' templates."""

    @F.pandas_udf("array<double>")
    def warp(z: pd.Series, shapes: pd.Series) -> pd.Series:
        out = []
        for a, s in zip(z, shapes, strict=True):
            out.append([numeric.dtw(np.asarray(a), np.asarray(t), None if band is None else max(band, abs(len(a) - len(t)))) for t in s])
        return pd.Series(out)

    lists = templates.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("template_id", "shape"))), lambda x: x["shape"]).alias("shapes"))
    z = seg.withColumn("z", series.znorm(F.col("seg"), flat_zero=True)).join(F.broadcast(lists), "series_id")
    return z.select("series_id", "idx", warp("z", "shapes").alias("shapes"))


def shape_templates(df: DataFrame, ranges: DataFrame, clusters: int = 10, alpha: float = 0.5, band: float | None = None) -> DataFrame:
    """(series_id, template_id, shape): medoids of clusters of the z-normed labelled patterns.

    Clusters of one or two take their first pattern. Up to ``clusters`` patterns
    are all templates.
    """
    pats = series.extract_patterns(df, ranges).withColumn("z", series.znorm(F.col("pattern")))

    def pick(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range_id")
        z = [np.asarray(x) for x in pdf.z]
        if len(z) <= clusters:
            chosen = list(range(len(z)))
        else:
            n = len(z)
            d = np.zeros((n, n))
            for i in range(n):
                for j in range(i + 1, n):
                    d[i, j] = d[j, i] = numeric.dtw(z[i], z[j], None if band is None else max(int(band * len(z[i])), abs(len(z[i]) - len(z[j]))))
            d[~np.isfinite(d)] = 0
            labels = numeric.spectral(np.exp(-alpha * d), clusters)
            groups = [np.flatnonzero(labels == c) for c in np.unique(labels)]
            chosen = [int(g[0]) if len(g) < 3 else int(g[d[np.ix_(g, g)].sum(1).argmin()]) for g in groups]
        return pd.DataFrame({"series_id": key[0], "template_id": range(len(chosen)), "shape": [z[i] for i in chosen]})

    return pats.select("series_id", "range_id", "z").groupBy("series_id").applyInPandas(pick, "series_id string, template_id int, shape array<double>")


BLOCKS = {"all": "stat time shape", "stat_time": "stat time", "stat_shape": "stat shape", "time_shape": "time shape", "stat": "stat", "time": "time", "shape": "shape"}


def features(df: DataFrame, w: int, which: str = "all", templates: DataFrame | None = None, warping: float = 0.1) -> DataFrame:
    """(series_id, idx, features array<double>) of all segments; only the blocks asked for are computed."""
    blocks = BLOCKS[which].split()
    rows = stat_features(df, w) if "stat" in blocks else series.segments(df, w).select("series_id", "idx", "ts")
    parts = [F.array(*STATS)] if "stat" in blocks else []
    if "time" in blocks:
        parts.append(F.array(*X.hour_code(F.col("ts"))))
    if "shape" in blocks:
        if templates is None:
            raise ValueError("shape features need templates")
        rows = rows.join(shape_distances(series.segments(df, w), templates, int(warping * w) or None), ["series_id", "idx"])
        parts.append(F.col("shapes"))
    return rows.select("series_id", "idx", F.concat(*parts).alias("features"))


def scale_features(rows: DataFrame, how: str = "standard") -> DataFrame:
    """Scales each component within its series; how: standard, minmax or robust."""
    long = rows.select("series_id", "idx", F.posexplode("features").alias("k", "v"))
    f = {"standard": scores.standard, "minmax": scores.minmax, "robust": scores.robust}[how]
    got = f(long, ["v"], ["series_id", "k"])
    return got.groupBy("series_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("features"))


# localisation


def find_locations(labels: DataFrame, ranges: DataFrame, w: int, compat: bool = False, smooth: str = "convolve", **low) -> DataFrame:
    """(series_id, idx, loc) from 0/1 segment labels y over the series.

    Labels are summed over w segments, thresholded at the least of the labelled
    runs' largest sums, and the centres of what is above, at least w apart, are
    the occurrences. If fewer are found than labelled, the labelled centres join.
    """
    support = series.shifted_support(labels, w) if smooth == "convolve" else low_pass(labels, ranges, w, **low)
    t = scores.run_threshold(support, ranges)
    above = support.join(F.broadcast(t), "series_id", "left").withColumn("above", F.coalesce((F.col("support") >= F.col("threshold")).cast("int"), F.lit(0)))
    runs = series.centres(series.pattern_ranges(above, "above", compat)).select("series_id", F.col("centre").alias("idx"))
    found = series.keep_apart(series.repair(runs, series.centres(ranges)), w, compat=compat)
    return series.on_spine(labels.select("series_id", "idx"), found, "loc")


def find_locations_old(labels: DataFrame, ranges: DataFrame, w: int, compat: bool = False) -> DataFrame:
    """The older rule: running support that resets at 0, run starts instead of centres."""
    support = series.support_with_reset(labels).withColumn("support", F.col("support").cast("double"))
    t = scores.run_threshold(support, ranges)
    above = support.join(F.broadcast(t), "series_id", "left").withColumn("above", F.coalesce((F.col("support") >= F.col("threshold")).cast("int"), F.lit(0)))
    runs = series.pattern_ranges(above, "above", compat).select("series_id", F.col("b").alias("idx"))
    found = series.keep_apart(series.repair(runs, series.centres(ranges)), w, compat=compat)
    return series.on_spine(labels.select("series_id", "idx"), found, "loc")


def low_pass(labels: DataFrame, ranges: DataFrame, w: int, orders=range(1, 20), cutoffs=tuple(k / 100 for k in range(1, 71))) -> DataFrame:
    """Adds support: labels through the zero-phase low-pass filter whose run maxima spread least.

    Filters are judged on the signal as it is; the chosen one's output moves by
    half a window. Non-finite candidates never win; later ones win ties.
    """
    lists = ranges.groupBy("series_id").agg(F.sort_array(F.collect_list(F.array("b", "e"))).alias("runs"))
    rows = labels.select("series_id", "idx", "y").join(lists, "series_id", "left")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, runs, best = pdf.y.to_numpy().astype(float), pdf.runs.iloc[0], (np.inf, None)
        for order in orders:
            with np.errstate(all="ignore"):
                every = numeric.filtfilt(numeric.butter(order, np.array(cutoffs)), x)
            for got in every.T:
                if runs is None or not np.isfinite(got).all():
                    continue
                top = np.array([got[b : e + 1].max() for b, e in runs])
                top = top[top > 0]
                if len(top) and top.min() > 1e-8 and top.std() <= best[0]:
                    best = (top.std(), got)
        out = np.zeros(len(x)) if best[1] is None else np.concatenate([np.zeros(int(w / 2)), best[1]])[: len(x)]
        return pd.DataFrame({"series_id": key[0], "idx": pdf.idx, "y": pdf.y, "support": out})

    return rows.groupBy("series_id").applyInPandas(run, "series_id string, idx long, y int, support double")


class PatternDetector(Params):
    """Occurrences by classifying every segment from positive and unlabelled ones."""

    defaults = {"features": "all", "n_clusters": 10, "warping_width": 0.1, "alpha": 0.5, "k": 200, "rounds": 100, "kernel": "linear", "scaling": "standard", "smoothing": "convolve", "compat": False}

    def fit_predict_occurrences(self, df: DataFrame) -> DataFrame:
        """(series_id, idx, loc); y marks the labelled occurrences."""
        ranges = series.pattern_ranges(df, compat=self.compat)
        return by_window(df, learnt_sizes(df, ranges), lambda rows, w: self._occurrences(rows, ranges.join(rows.select("series_id").distinct(), "series_id", "left_semi"), w))

    def _occurrences(self, df: DataFrame, ranges: DataFrame, w: int) -> DataFrame:
        """The same of series with one window length."""
        templates = shape_templates(df, ranges, self.n_clusters, self.alpha, self.warping_width) if "shape" in BLOCKS[self.features] else None
        rows = scale_features(features(df, w, self.features, templates, self.warping_width), self.scaling)
        rows = rows.join(series.label_segments(rows, ranges, w), ["series_id", "idx"])
        k, rounds, kern = self.k, self.rounds, self.kernel

        def vote(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx")
            x, y = np.stack(pdf.features).astype(float), pdf.label.to_numpy()
            pos, unl, g, votes = np.flatnonzero(y == 1), np.flatnonzero(y == 0), 1.0 / x.shape[1], np.zeros(len(x))
            if not len(pos) or not len(unl):
                return pd.DataFrame({"series_id": key[0], "idx": pdf.idx, "y": (y == 1).astype(int)})
            for t in range(rounds):
                rng = numeric.generator("pattern", key[0], t)
                at = np.concatenate([rng.choice(unl, min(k, len(unl)), replace=False), rng.choice(pos, min(20, len(pos)), replace=False)])
                s = np.where(y[at] == 1, 1.0, -1.0)
                cap = len(s) / 2 / np.where(s > 0, (s > 0).sum(), (s < 0).sum())
                wv, b = numeric.svc(numeric.kernel(x[at], x[at], kern, g), s, cap)
                votes += numeric.kernel(x, x[at], kern, g) @ wv + b > 0
            votes = (votes - votes.min()) / max(votes.max() - votes.min(), 1e-12)
            return pd.DataFrame({"series_id": key[0], "idx": pdf.idx, "y": (votes > 0.5).astype(int)})

        labels = rows.groupBy("series_id").applyInPandas(vote, "series_id string, idx long, y int")
        spine = df.select("series_id", "idx").join(labels, ["series_id", "idx"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
        return find_locations(spine, ranges, w, self.compat, self.smoothing)


def by_window(df: DataFrame, sizes: DataFrame, run) -> DataFrame:
    """run(rows, w) for the series of each window length, together. sizes: (series_id, w).

    One plan for each length, not for each series; w is a literal in all of them.
    """
    lengths = sorted(r["w"] for r in sizes.select("w").distinct().collect()) or [2]
    if len(lengths) == 1:
        return run(df, lengths[0])
    each = [run(df.join(sizes.where(F.col("w") == w).select("series_id"), "series_id", "left_semi"), w) for w in lengths]
    return reduce(DataFrame.unionByName, each)


def learnt_sizes(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """(series_id, w) of every series: the mean labelled length, 2 at least."""
    return df.select("series_id").distinct().join(series.window_size(ranges), "series_id", "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(2)), F.lit(2)))


def shape_distance(a: Column, b: Column, band: int | None = None) -> Column:
    """Warped distance; a band is never less than the difference in length."""
    return X.dtw(a, b, None if band is None else F.greatest(F.lit(band), F.abs(F.size(a) - F.size(b))))


def fingerprint_threshold(pats: DataFrame, distance=shape_distance) -> DataFrame:
    """(series_id, limit): greatest of the least int(0.9 N) distances between different patterns z, both ways."""
    a, b = pats.select("series_id", F.col("range_id").alias("i"), F.col("z").alias("zi")), pats.select("series_id", F.col("range_id").alias("j"), F.col("z").alias("zj"))
    d = a.join(b, "series_id").where("i <> j").withColumn("d", distance(F.col("zi"), F.col("zj")))
    by = Window.partitionBy("series_id")
    d = d.withColumn("r", F.row_number().over(by.orderBy("d", "i", "j"))).withColumn("n", F.count(F.lit(1)).over(by))
    return d.where(F.col("r") <= F.floor(F.col("n") * 0.9)).groupBy("series_id").agg(F.max("d").alias("limit"))


class FingerprintDetector(Params):
    """Occurrences by matching every segment to every labelled pattern.

    detector_type: dtw compares z-normed values, feature the scaled features of
    the segments that start where the labelled patterns do. w: a length for all
    series, or None to learn each series' own from its labels.
    """

    defaults = {"w": None, "detector_type": "dtw", "features": "stat_time", "n_clusters": 10, "warping_width": 0.1, "alpha": 0.5, "compat": False}

    def _each(self, df: DataFrame, run) -> DataFrame:
        return run(df, self.w) if self.w else by_window(df, self.sizes, run)

    def _distance(self, w: int):
        if self.detector_type == "feature":
            return lambda a, b: F.sqrt(X.euclidean2(a, b))
        return lambda a, b: shape_distance(a, b, int(self.warping_width * w) or None)

    def _raw(self, df: DataFrame, w: int) -> DataFrame:
        return features(df, w, self.features, self.templates, self.warping_width).select("series_id", "idx", F.posexplode("features").alias("k", "v"))

    def _segments(self, df: DataFrame, w: int) -> DataFrame:
        """(series_id, idx, z) of all full segments."""
        if self.detector_type == "dtw":
            return series.segments(df, w).select("series_id", "idx", series.znorm(F.col("seg"), flat_zero=True).alias("z"))
        scaled = self._raw(df, w).join(self.scale, ["series_id", "k"]).withColumn("v", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0))
        return scaled.groupBy("series_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("z"))

    def fit_fingerprints(self, df: DataFrame):
        """Learns window, shapes and limit of each series from the occurrences that y marks."""
        if self.detector_type not in ("dtw", "feature"):
            raise ValueError("detector_type is dtw or feature")
        self.ranges = ranges = series.pattern_ranges(df, compat=self.compat)
        self.sizes = None if self.w else learnt_sizes(df, ranges)
        self.mean = ranges.groupBy("series_id").agg(F.avg(F.col("e") - F.col("b") + 1).alias("mean"))
        if self.detector_type == "dtw":
            self.shapes = series.extract_patterns(df, ranges).select("series_id", "range_id", series.znorm(F.col("pattern")).alias("z"))
        else:
            self.templates = shape_templates(df, ranges, self.n_clusters, self.alpha, self.warping_width) if "shape" in BLOCKS[self.features] else None
            self.scale = self._each(df, self._raw).groupBy("series_id", "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
            starts = ranges.select("series_id", "range_id", F.col("b").alias("idx"))
            self.shapes = self._each(df, self._segments).join(starts, ["series_id", "idx"]).select("series_id", "range_id", "z")
        self.limit = self._each(self.shapes, lambda pats, w: fingerprint_threshold(pats, self._distance(w)))
        return self

    def _found(self, df: DataFrame, w: int) -> DataFrame:
        """(series_id, idx): shifted centres of the runs of matching segments.

        A series with a run over ten times its mean labelled length, or where
        nearly all segments match, has none. Only full segments are matched.
        """
        shapes = self.shapes.select("series_id", F.col("z").alias("shape"))
        near = self._segments(df, w).join(F.broadcast(shapes) if shapes.count() <= 10_000 else shapes, "series_id").withColumn("d", self._distance(w)(F.col("z"), F.col("shape")))
        hit = near.groupBy("series_id", "idx").agg(F.min("d").alias("d")).join(self.limit, "series_id").withColumn("hit", (F.col("d") < F.col("limit")).cast("int"))
        runs = series.pattern_ranges(hit, "hit", self.compat)
        odd = runs.groupBy("series_id").agg(F.max(F.col("e") - F.col("b") + 1).alias("top"), F.sum(F.col("e") - F.col("b") + 1).alias("hits"))
        all_ = hit.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
        fine = odd.join(self.mean, "series_id").join(all_, "series_id").where((F.col("top") <= 10 * F.col("mean")) & (F.col("hits") < F.col("n") - w)).select("series_id")
        found = series.centres(runs).join(fine, "series_id", "left_semi").select("series_id", F.col("centre").alias("idx"))
        shift = int(w / 2) - 1 if w > 1 else 0
        return series.keep_apart(found, w, compat=self.compat).select("series_id", (F.col("idx") + shift).alias("idx"))

    def predict_fingerprints(self, df: DataFrame) -> DataFrame:
        """(series_id, idx, loc) of other rows of the series seen by fit_fingerprints; other series have no occurrences."""
        return series.on_spine(df.select("series_id", "idx"), self._each(df, self._found), "loc")

    def fit_predict_fingerprints(self, df: DataFrame) -> DataFrame:
        """(series_id, idx, loc) of the rows fitted on; the labelled centres join where fewer are found than labelled."""
        found = self.fit_fingerprints(df)._each(df, self._found)
        return series.on_spine(df.select("series_id", "idx"), series.repair(found, series.centres(self.ranges)), "loc")


# suspicion


def suspicion(df: DataFrame, params: dict | DataFrame, by: str = "time", alpha: float = 0.95) -> DataFrame:
    """Absence rows (series_id, idx, ts, loc, prob, pred) from known occurrences loc.

    prob is the exponentiated Weibull probability that the next occurrence
    should have come by now, by time or usage since the last one; pred marks the
    first row of each stretch above alpha. params: a, c, loc, scale, or a table
    of them by series with the descriptor in ``kind``.
    """
    rows = series.last_event(df)
    if isinstance(params, dict):
        x = F.col("gap") if by == "time" else F.col("usage")
        prob = X.exponweib_cdf(x.cast("double"), **params)
    else:
        rows = rows.join(F.broadcast(params), "series_id", "left")
        x = F.when(F.col("kind") == "usage", F.col("usage")).otherwise(F.col("gap").cast("double"))
        prob = F.when(F.col("kind") == "average", (F.col("gap") > F.col("scale")).cast("double")).otherwise(X.exponweib_cdf(x, F.col("a"), F.col("c"), F.col("shift"), F.col("scale")))
    rows = rows.withColumn("prob", F.coalesce(prob, F.lit(0.0))).withColumn("flag", (F.col("prob") > alpha).cast("int"))
    return series.first_of_run(rows, "flag").select("series_id", "idx", "ts", "loc", "prob", "pred")


def average_suspicion(df: DataFrame, mean: DataFrame) -> DataFrame:
    """Absence rows with prob = pred = 1 where the gap exceeds the series' mean interarrival time."""
    rows = series.last_event(df).join(F.broadcast(mean), "series_id", "left")
    late = F.coalesce((F.col("gap") > F.col("mean")).cast("int"), F.lit(0))
    return rows.select("series_id", "idx", "ts", "loc", late.cast("double").alias("prob"), late.alias("pred"))


def mean_interarrival(df: DataFrame) -> DataFrame:
    events = df.where("loc = 1").select("series_id", "idx")
    return series.interarrival(events).groupBy("series_id").agg(F.avg("step").alias("mean"))


def descriptors(df: DataFrame) -> DataFrame:
    """(series_id, kind, v): interarrival times and usages between occurrences."""
    time = series.interarrival(df.where("loc = 1").select("series_id", "idx")).where("step is not null")
    time = time.select("series_id", F.lit("time").alias("kind"), F.col("step").cast("double").alias("v"))
    return time.unionByName(series.usage_between(df).select("series_id", F.lit("usage").alias("kind"), F.col("usage").alias("v")))


WEIBULL = "series_id string, kind string, a double, c double, shift double, scale double, nll double"


def fit_weibull(values: DataFrame, which: str = "all") -> DataFrame:
    """(series_id, kind, a, c, shift, scale, nll): the descriptor of least nll, time first on a tie.

    Fewer than three values fall back to their mean: kind 'average'.
    """

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        best = None
        for kind in ("time", "usage"):
            x = np.sort(pdf.v[pdf.kind == kind].to_numpy())
            x = x[np.isfinite(x)]
            if which in ("all", kind) and len(x) >= 3 and x.max() > x.min():
                a, c, loc, scale, nll = numeric.exponweib_fit(np.maximum(x, 1e-9))
                if np.isfinite(nll) and (best is None or nll < best[-1]):
                    best = (key[0], kind, a, c, loc, scale, nll)
        if best is None:
            t = pdf.v[pdf.kind == "time"]
            best = (key[0], "average", 1.0, 1.0, 0.0, float(t.mean()) if len(t) else float("inf"), float("nan"))
        return pd.DataFrame([best], columns=[c.split()[0] for c in WEIBULL.split(", ")])

    return values.groupBy("series_id").applyInPandas(fit, WEIBULL)


class AbsenceDetector(Params):
    """Absence of a pattern by time or usage since it last occurred."""

    defaults = {"missing_features": "all", "missing_alpha": 0.95, "occurrence_detection": "fingerprint", "detector": None}

    def _locate(self, df: DataFrame) -> DataFrame:
        if self.occurrence_detection == "pattern":
            got = (self.detector or PatternDetector()).fit_predict_occurrences(df)
        elif self.occurrence_detection == "fingerprint":
            self.matcher = self.detector or FingerprintDetector()
            got = self.matcher.fit_predict_fingerprints(df)
        else:
            raise ValueError("occurrence_detection is pattern or fingerprint")
        return df.join(got, ["series_id", "idx"])

    def _model(self, located: DataFrame) -> DataFrame:
        return fit_weibull(descriptors(located), self.missing_features)

    def fit(self, df: DataFrame):
        """Learns occurrences and the model of absence from labelled series."""
        self.model = self._model(self._locate(df))
        return self

    def fit_predict(self, df: DataFrame) -> DataFrame:
        located = self._locate(df)
        self.model = self._model(located)
        return self.predict_suspicion(located)

    def predict(self, df: DataFrame) -> DataFrame:
        """Absences in other rows of the series fitted on, found by their fingerprints; idx begins at 0 there too."""
        if self.occurrence_detection != "fingerprint":
            raise NotImplementedError("occurrences of other rows are found by fingerprint; give known ones to predict_suspicion")
        return self.predict_suspicion(df.join(self.matcher.predict_fingerprints(df), ["series_id", "idx"]))

    def predict_suspicion(self, df: DataFrame) -> DataFrame:
        return suspicion(df, self.model, alpha=self.missing_alpha)


class AverageMissing(AbsenceDetector):
    """The same with the mean interarrival time as the limit."""

    def _model(self, located: DataFrame) -> DataFrame:
        return mean_interarrival(located)

    def predict_suspicion(self, df: DataFrame) -> DataFrame:
        return average_suspicion(df, self.model)


class ADBase(Params):
    """A point detector on segment features; each series is judged on its own."""

    defaults = {"features": "stat_time", "k": 10, "ws": 24, "missing_classifier": "kNNo", "missing_alpha": 0.9, "warping_width": 0.1, "n_clusters": 10}

    def fit_predict(self, df: DataFrame) -> DataFrame:
        """(series_id, idx, score, pred); the last ws - 1 rows, which start no full segment, have score 0 and pred -1.

        kNNo and LOF take any number of series; the others fit one model, and so
        want one series.
        """
        from ..operators import ensemble, neighbors

        share = 1 - self.missing_alpha
        ranges = series.pattern_ranges(df)
        templates = shape_templates(df, ranges, self.n_clusters) if "shape" in BLOCKS[self.features] else None
        rows = scale_features(features(df, self.ws, self.features, templates, self.warping_width)).select("series_id", F.col("idx").alias("id"), "features")
        by = {
            "kNNo": lambda: neighbors.knno(rows, self.k, share, by="series_id"),
            "LOF": lambda: neighbors.lof(rows, self.k, share, by="series_id"),
        }
        alone = {
            "IF": lambda pts: ensemble.isolation_forest(pts, share=share),
            "semi_supervised": lambda pts: ensemble.semi_supervised(pts, share=share, base="IF"),
            "SSAD": lambda pts: ensemble.ssad(pts, share=share),
        }
        if self.missing_classifier in by:
            got = by[self.missing_classifier]()
        elif self.missing_classifier in alone:
            names = [r[0] for r in df.select("series_id").distinct().limit(2).collect()]
            if len(names) > 1:
                raise ValueError(f"{self.missing_classifier} takes one series")
            lab = series.label_segments(df.select("series_id", "idx"), ranges, self.ws).select(F.col("idx").alias("id"), F.when(F.col("label") == 1, -1).otherwise(0).alias("label"))
            pts = rows.join(lab, "id") if self.missing_classifier != "IF" else rows.withColumn("label", F.lit(0))
            got = alone[self.missing_classifier](pts).withColumn("series_id", F.lit(names[0] if names else None).cast("string"))
        else:
            raise ValueError(f"unknown classifier: {self.missing_classifier}")
        got = got.select("series_id", F.col("id").alias("idx"), "score", "pred")
        out = df.select("series_id", "idx").join(got, ["series_id", "idx"], "left")
        return out.select("series_id", "idx", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("pred", F.lit(-1)).alias("pred"))


class DiscordDetector(Params):
    """Discords by the matrix profile of train and test together."""

    defaults = {"ws": 24, "missing_classifier": "MatrixProfile", "missing_alpha": 0.9, "ddof": 1}

    def fit(self, train: DataFrame):
        if self.missing_classifier == "WCAD":
            raise NotImplementedError("compression-based detection is not specified")
        self.train = train
        return self

    def fit_predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return self.fit(train).predict_suspicion(test)

    def predict_suspicion(self, test: DataFrame) -> DataFrame:
        """(series_id, idx, score, pred) of the rows of test, idx as in test."""
        from ..operators import profile

        both = profile.concatenate(self.train, test)
        n = self.train.groupBy("series_id").agg((F.max("idx") + 1).alias("n"))
        got = profile.discords(both, self.ws, 1 - self.missing_alpha, self.ddof)
        return got.join(F.broadcast(n), "series_id").where("idx >= n").select("series_id", (F.col("idx") - F.col("n")).alias("idx"), "score", "pred")
