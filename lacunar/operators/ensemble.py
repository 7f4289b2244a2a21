"""Samples per ensemble member, isolation forests and kernel machines.

A member trains on a bounded sample drawn by hash; forests and machines are
tables or blobs of bounded size that a narrow pass scores all points with.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric
from .scores import contamination, minmax
from .store import stored

NODES = "tree_id int, node_id int, left int, right int, normal array<double>, point array<double>, size int, depth int, is_leaf boolean"


def hashed(seed: str, *cols: str) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *cols).cast("binary"))


def sample(points: DataFrame, members: int, n: int, seed: str, name: str = "member") -> DataFrame:
    """n points of each of some members: those of least md5(seed, member, id)."""
    drawn = points.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).withColumn("_h", hashed(seed, name, "id"))
    return drawn.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy("_h", "id"))).where(F.col("_r") <= n).drop("_h", "_r")


def bags(points: DataFrame, bags: int, unlabelled: int = 200, positive: int = 20, seed: str = "bag") -> DataFrame:
    """Each bag's rows: so many points of label 0 and of label 1, without replacement."""
    a = sample(points.where("label = 0"), bags, unlabelled, seed, "bag")
    return a.unionByName(sample(points.where("label = 1"), bags, positive, seed, "bag"))


def forest(points: DataFrame, trees: int = 100, size: int = 256, level: int = 0, limit: int | None = None, seed: str = "forest") -> DataFrame:
    """The node table of isolation trees; level 0 splits along one axis, level d - 1 along any hyperplane."""
    if size < 2 or trees < 1:
        raise ValueError("a forest has a tree or more, each of two points or more")
    depth = math.ceil(math.log2(size)) if limit is None else limit

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf.features).astype(float)
        if not 0 <= level < x.shape[1]:
            raise ValueError(f"the extension level lies in 0..{x.shape[1] - 1}")
        nodes = numeric.isolation_tree(x, depth, level, numeric.generator(seed, key[0]))
        out = pd.DataFrame(nodes, columns=["node_id", "left", "right", "normal", "point", "size", "depth"]).astype({"left": "Int32", "right": "Int32"})
        return out.assign(tree_id=key[0], is_leaf=out.left.isna())[[c.split()[0] for c in NODES.split(", ")]]

    return sample(points.select("id", "features"), trees, size, seed, "tree_id").groupBy("tree_id").applyInPandas(grow, NODES)


def branches(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, path): the L and R steps to every leaf."""
    return nodes.sparkSession.sql(
        """
        WITH RECURSIVE walk(tree_id, node_id, path) AS (
            SELECT tree_id, node_id, CAST('' AS STRING) FROM {nodes} WHERE node_id = 0
            UNION ALL
            SELECT n.tree_id, c.child, concat(w.path, c.step) FROM walk w JOIN {nodes} n ON n.tree_id = w.tree_id AND n.node_id = w.node_id
            LATERAL VIEW stack(2, n.left, 'L', n.right, 'R') c AS child, step WHERE NOT n.is_leaf)
        SELECT w.tree_id, w.node_id, w.path FROM walk w JOIN {nodes} n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE n.is_leaf
        """,
        nodes=nodes,
    )


def forest_scores(points: DataFrame, nodes: DataFrame, size: int, share: float = 0.1) -> DataFrame:
    """(id, raw, score, pred): 2^(-mean path / c(size)), scaled, labelled by contamination."""
    grown: dict[int, list[tuple]] = {}
    for r in nodes.orderBy("tree_id", "node_id").collect():  # at most 2 * size nodes a tree
        grown.setdefault(r["tree_id"], []).append((r["node_id"], r["left"], r["right"], r["normal"], r["point"], r["size"], r["depth"]))
    trees = list(grown.values())
    shared = points.sparkSession.sparkContext.broadcast(trees)
    c = numeric.c_factor(size)

    def score(batches):
        for b in batches:
            if len(b):
                x = np.stack(b.features).astype(float)
                mean = np.mean([numeric.path_lengths(x, t) for t in shared.value], axis=0)
                yield pd.DataFrame({"id": b.id, "raw": 2.0 ** (-mean / c)})

    out = points.select("id", "features").mapInPandas(score, "id long, raw double")
    return contamination(minmax(out.withColumn("score", F.col("raw")), ["score"], []), share, [])


def isolation_forest(points: DataFrame, trees: int = 100, size: int | None = None, level: int = 0, share: float = 0.1, seed: str = "forest") -> DataFrame:
    size = min(size or 256, points.count())
    return forest_scores(points, forest(points, trees, size, level, seed=seed), size, share)


def _bounded(points: DataFrame, most: int | None, seed: str) -> pd.DataFrame:
    """At most so many rows (None: all), those of least hash, on the driver, in order of the hash."""
    rows = points.withColumn("_h", hashed(seed, "id"))
    rows = rows.orderBy("_h", "id").limit(most) if most is not None else rows
    return rows.toArrow().to_pandas().sort_values(["_h", "id"]).drop(columns="_h")  # packed arrays, not lists of numbers


def one_class_svm(points: DataFrame, nu: float = 0.5, share: float = 0.1, kind: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 0.0, most: int | None = 1500, seed: str = "osvm") -> DataFrame:
    """(id, raw, score, pred) of a one-class machine fitted on a sample of ``most`` points; None: exactly, on all of them."""
    x = np.stack(_bounded(points, most, seed).features).astype(float)
    g = gamma or 1.0 / x.shape[1]
    a, rho = numeric.one_class(numeric.kernel(x, x, kind, g, degree, coef0), nu)
    model = points.sparkSession.sparkContext.broadcast((x[a > 1e-9], a[a > 1e-9], rho))

    def score(batches):
        for b in batches:
            if len(b):
                sv, w, r = model.value
                yield pd.DataFrame({"id": b.id, "raw": r - numeric.kernel(np.stack(b.features).astype(float), sv, kind, g, degree, coef0) @ w})

    out = points.select("id", "features").mapInPandas(score, "id long, raw double")
    return contamination(minmax(out.withColumn("score", F.col("raw")), ["score"], []), share, [])


KERNELS = ("linear", "rbf", "poly", "sigmoid")


def bagging_svm(points: DataFrame, train: DataFrame | None = None, k: int = 200, rounds: int = 100, kind: str = "linear", class_weights: bool = False, feature_share: float = 1.0, seed: str = "bag") -> DataFrame:
    """(id, prob, pred): votes of machines on bags of positive and unlabelled points.

    kind 'mixed' takes the kernels in turn. class_weights weighs the positive
    ones round(K / number of them), otherwise classes balance.
    """
    train = points if train is None else train
    drawn = bags(train.select("id", "features", "label"), rounds, k, 20, seed)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y = np.stack(pdf.features).astype(float), np.where(pdf.label == 1, 1.0, -1.0)
        kern = KERNELS[key[0] % 4] if kind == "mixed" else kind
        cols = np.sort(numeric.generator(seed, key[0]).choice(x.shape[1], max(1, round(feature_share * x.shape[1])), replace=False))
        x = x[:, cols]
        pos, neg = max(1, (y > 0).sum()), max(1, (y < 0).sum())
        cap = np.where(y > 0, max(1, round(k / pos)), 1.0) if class_weights else len(y) / 2 / np.where(y > 0, pos, neg)
        g = 1.0 / x.shape[1]
        w, b = numeric.svc(numeric.kernel(x, x, kern, g), y, cap)
        keep = abs(w) > 1e-9
        return pd.DataFrame({"bag": [key[0]], "model": [pickle.dumps((kern, g, cols, x[keep], w[keep], b))]})

    models = [pickle.loads(r.model) for r in drawn.groupBy("bag").applyInPandas(fit, "bag int, model binary").orderBy("bag").collect()]  # rounds models of at most k + 20 vectors
    shared = points.sparkSession.sparkContext.broadcast(models)

    def vote(batches):
        for p in batches:
            if len(p):
                x = np.stack(p.features).astype(float)
                votes = [numeric.kernel(x[:, c], sv, kern, g) @ w + b > 0 if len(w) else np.full(len(x), b > 0) for kern, g, c, sv, w, b in shared.value]
                yield pd.DataFrame({"id": p.id, "prob": np.mean(votes, axis=0) if votes else 0.0})

    out = minmax(points.select("id", "features").mapInPandas(vote, "id long, prob double"), ["prob"], [])
    return out.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def bagging_forest(points: DataFrame, k: int = 200, rounds: int = 10, trees: int = 10, seed: str = "bag") -> DataFrame:
    """The same vote with a random forest of pyspark.ml for each bag."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    drawn = bags(points.select("id", "features", "label"), rounds, k, 20, seed).withColumn("x", array_to_vector("features"))
    rows, out = points.select("id", array_to_vector("features").alias("x")), None
    for b in range(rounds):
        model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, seed=b).fit(drawn.where(F.col("bag") == b))
        got = model.transform(rows).select("id", F.col("prediction").alias("pred"))
        out = got if out is None else out.unionByName(got)
    v = minmax(out.groupBy("id").agg(F.avg("pred").alias("prob")), ["prob"], [])
    return v.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


#: Points of which a kernel matrix is held whole, on the driver: 128 MB.
WHOLE = 4096


def _products(spark: SparkSession, x: np.ndarray, kind: str, gamma: float) -> Callable[[np.ndarray], np.ndarray]:
    """kernel(x, x) @ z as a function of z, worked out by tasks that hold all of x and a few rows of the matrix."""
    sc = spark.sparkContext
    shared = sc.broadcast(x)
    cuts = np.linspace(0, len(x), 2 * max(2, sc.defaultParallelism) + 1).astype(int).tolist()
    rows = sc.parallelize(list(zip(cuts[:-1], cuts[1:], strict=True)), len(cuts) - 1)

    def times(z: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(z)
        out = rows.map(lambda r: numeric.kernel_times(shared.value[r[0] : r[1]], shared.value, sent.value, kind, gamma)).collect()  # a number for each point
        sent.destroy()
        return np.concatenate(out)

    return times


def ssad(points: DataFrame, share: float = 0.1, kappa: float = 1.0, cu: float = 1.0, cl: float = 1.0, kind: str = "rbf", width: float = 1.0) -> DataFrame:
    """(id, raw, score, pred) of convex semi-supervised detection.

    Fitted on all points (label 1 anomaly, -1 normal, else unlabelled); labels are
    turned round, since the machine encloses the normal ones. Over ``WHOLE``
    points the kernel is nowhere whole: tasks make their rows of it, part by
    part, and return products. A product costs the square of the points; an rbf
    kernel that is wide against them needs a few, since its moments find the
    steps. The driver holds all points.
    """
    own = points.select("id", F.col("features").cast("array<double>").alias("features"), "label").toArrow().sort_by("id")
    n = own.num_rows
    x = own.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if not n or own.column("features").null_count or len(set(pc.unique(pc.list_value_length(own.column("features"))).to_pylist())) > 1:
        raise ValueError("the machine needs points, all of one size")
    x, label = x.reshape(n, -1), own.column("label").to_numpy()
    ids, y, gamma = own.column("id"), np.where(label == 1, -1.0, np.where(label == -1, 1.0, 0.0)), 1.0 / width
    del own
    k = numeric.kernel(x, x, kind, gamma) if n <= WHOLE else _products(points.sparkSession, x, kind, gamma)
    wide = kind == "rbf" and 2 * gamma * (x * x).sum(1).max() <= 0.5
    _, rho, product = numeric.ssad_fit(k, y, kappa, cl, cu, cl, near=numeric.moments(x, gamma) if wide else None)
    out = points.sparkSession.createDataFrame(pa.table({"id": ids.cast(pa.int64()), "raw": rho - product}))
    return minmax(contamination(out.withColumn("score", F.col("raw")), share, []), ["score"], [])


# clustering priors and label propagation


def harmonic_eta(points: DataFrame, k: int = 30, tol: float = 1e-8) -> DataFrame:
    """One row eta: harmonic mean of the k-distances, zeros as the least positive one."""
    from .neighbors import knn

    d = knn(points, points, k).where(F.col("rank") == k).select("d")
    least = d.agg(F.min(F.when(F.col("d") > 0, F.col("d"))).alias("fill"))
    filled = d.crossJoin(F.broadcast(least)).withColumn("d", F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("fill")))
    return filled.agg(F.greatest(F.lit(tol), F.count(F.lit(1)) / F.sum(1 / F.col("d"))).alias("eta"))


def posterior(scored: DataFrame, labelled: DataFrame, eta: float, alpha: float = 2.3) -> DataFrame:
    """(id, score) from (id, features, prior) and labelled points (1 anomaly, -1 normal).

    Blocks of both meet as tiles; a tile sums its squashed distances per point.
    """
    from .neighbors import BLOCK, _blocks, distances

    labels = labelled.where("label <> 0")
    a = _blocks(scored.select("id", "features"), "q", BLOCK)
    n = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-labels.count() // BLOCK))))
    b = labels.groupBy(n.alias("bp")).agg(F.collect_list("features").alias("xp"), F.collect_list("label").alias("yp"))

    def tile(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                s = 0.5 ** ((distances(np.stack(r.xq).astype(float), np.stack(r.xp).astype(float)) / eta) ** 2)
                y = np.asarray(r.yp)
                yield pd.DataFrame({"id": np.asarray(r.idsq), "da": s[:, y == 1].sum(1), "dn": s[:, y == -1].sum(1)})

    sums = a.crossJoin(b).mapInPandas(tile, "id long, da double, dn double").groupBy("id").agg(F.sum("da").alias("da"), F.sum("dn").alias("dn"))
    out = scored.join(sums, "id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("da", "dn")})
    return out.select("id", ((F.col("prior") + alpha * F.col("da")) / (1 + alpha * (F.col("da") + F.col("dn")))).alias("score"))


#: Points that clusters hold on the driver, where a round needs no job: 64 MB of 64 numbers each.
HELD = 1 << 17


def _centres(points: DataFrame, k: int, seed: str, rounds: int = 100) -> np.ndarray:
    """The centres of numeric.kmeans with sides over all points in order of their hash.

    Points of label 0 are summed block by block in every round, over ``HELD``
    points by tasks; the driver holds and deals the labelled points.
    """
    rows = points.where("label is not null").select("id", "features", "label", hashed(seed, "id").alias("_h"))
    bins = rows.groupBy(F.substring("_h", 1, 3).alias("bin")).count().orderBy("bin").collect()  # 4096 rows at most
    n = sum(r["count"] for r in bins)
    if not n:
        raise ValueError("clusters need points")
    at, k = int(numeric.generator("kmeans", 0).integers(n)), min(k, n)
    for r in bins:
        if at < r["count"]:
            break
        at -= r["count"]
    first = rows.where(F.substring("_h", 1, 3) == r["bin"]).orderBy("_h", "id").select("features").take(at + 1)[at]  # a 4096th of the points
    centres = np.array([first[0]], float)
    pdf = _bounded(points.where("label <> 0"), None, seed)
    own = np.stack(pdf.features).astype(float) if len(pdf) else np.zeros((0, centres.shape[1]))
    names, sides = [hashlib.md5(f"{seed}:{i}".encode()).hexdigest().encode() for i in pdf.id], np.sign(pdf.label.to_numpy())

    def pack(batches):
        for b in batches:
            if len(b):
                b = b.sort_values(["_h", "id"])
                yield pd.DataFrame({"x": [np.stack(b.features).astype(float).tobytes()], "h": ["".join(b._h)]})

    blocks = rows.where("label = 0").drop("label").mapInPandas(pack, "x binary, h string")
    blocks = blocks.collect() if n <= HELD else stored(blocks).rdd

    def each(f: Callable) -> list:
        return [f(r) for r in blocks] if isinstance(blocks, list) else blocks.map(f).collect()  # clusters rows a block at most

    def far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(c)))
        for i in range(0, len(x), 512):
            for j, v in enumerate(c):
                out[i : i + 512, j] = ((x[i : i + 512] - v) ** 2).sum(1)
        return out

    def farthest(x: np.ndarray, name: Callable[[int], bytes], c: np.ndarray) -> tuple:
        least = far(x, c).min(1)
        i = int(least.argmax())
        return -least[i], name(i), x[i]

    def block(r) -> np.ndarray:
        return np.frombuffer(r.x).reshape(len(r.h) // 32, -1)

    while len(centres) < k:
        ends = each(lambda r, c=centres: farthest(block(r), lambda i: r.h[32 * i : 32 * i + 32].encode(), c))
        ends += [farthest(own, names.__getitem__, centres)] if len(own) else []
        centres = np.vstack([centres, min(ends, key=lambda e: e[:2])[2]])

    def total(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array([x[label == c].sum(0) for c in range(k)]), np.bincount(label, minlength=k)

    for _ in range(rounds):
        parts = each(lambda r, c=centres: total(x := block(r), far(x, c).argmin(1)))
        parts += [total(own, numeric._sided(far(own, centres), sides))] if len(own) else []
        size = sum(p[1] for p in parts)[:, None]
        was, centres = centres, np.where(size > 0, sum(p[0] for p in parts) / np.maximum(size, 1), centres)
        if (was == centres).all():
            break
    return centres


def cluster_prior(points: DataFrame, clusters: int = 10, tol: float = 1e-8, seed: str = "cop") -> DataFrame:
    """(id, prior) from constrained clusters: how far out, of how small and remote a cluster.

    Centres, sizes and radii are those of all points; anomalies and normals may
    not share a cluster.
    """
    c = _centres(points, clusters, seed)
    between = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    between[between < tol] = np.inf
    deviation = between.min(1)
    deviation = np.ones(len(c)) if not np.isfinite(deviation).any() else deviation / deviation[np.isfinite(deviation)].max()
    shared = points.sparkSession.sparkContext.broadcast((c, deviation))

    def assign(batches):
        for b in batches:
            if len(b):
                centres, dev = shared.value
                d = np.sqrt(((np.stack(b.features).astype(float)[:, None] - centres[None]) ** 2).sum(2))
                k = d.argmin(1)
                yield pd.DataFrame({"id": b.id, "cluster": k.astype("int32"), "d": d[np.arange(len(d)), k], "dev": dev[k]})

    near = points.select("id", "features").mapInPandas(assign, "id long, cluster int, d double, dev double")
    sizes = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("top"))))
    out = near.join(F.broadcast(sizes), "cluster")  # clusters rows
    return out.select("id", (F.when(F.col("radius") < tol, 1.0).otherwise(F.col("d") / F.col("radius")) * F.col("dev") / (F.col("n") / F.col("top"))).alias("prior"))


def semi_supervised(points: DataFrame, clusters: int = 10, alpha: float = 2.3, k: int = 30, share: float = 0.1, base: str = "clusters", prior: DataFrame | None = None, tol: float = 1e-8) -> DataFrame:
    """(id, score, pred): a prior from clusters, a forest or the caller, updated by labels."""
    if base == "clusters":
        first = cluster_prior(points, clusters)
    elif base == "IF":
        first = isolation_forest(points, 500).select("id", F.col("score").alias("prior"))
    elif base == "other":
        if prior is None:
            raise ValueError("base 'other' needs a prior (id, score)")
        first = minmax(prior.select("id", F.col("score").alias("prior")), ["prior"], [])
    else:
        raise ValueError("base is clusters, IF or other")
    first = stored(first)  # (id, prior), read three times
    ranked = contamination(first, share, [], "prior")
    gamma = ranked.where("pred = 1").agg(F.min("prior").alias("g"))  # the value at the contamination's position
    prior_ = first.crossJoin(F.broadcast(gamma)).select("id", (1 - F.pow(F.lit(2.0), -F.pow(F.col("prior") / (F.col("g") + tol), F.lit(2.0)))).alias("prior"))
    scored = points.select("id", "features").join(prior_, "id")
    labelled = points.where("label <> 0").select("id", "features", "label")
    if labelled.isEmpty():
        out = scored.select("id", F.col("prior").alias("score"))
    else:
        eta = harmonic_eta(points, k).first()["eta"]
        out = posterior(scored, labelled, eta, alpha)
    return contamination(out, share, [])
