"""Geometry of vectors (id, x array of double) in families."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import distribution as ds
from tessella.operators.joins import nearest
from tessella.operators.products import BLOCK_ROWS, block_pairs, matrix, squared_distances
from tessella.operators.ranking import hash_draw, ranked
from tessella.operators.resample import correlations

#: References are this many times the dimensions at least, and the condition of their covariance is at most this.
LEAST_PER_DIMENSION, MOST_CONDITION = 5, 1e12


def distance(x: Column | str, y: Column | str) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def centroids(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """The mean vector of each group, from partial sums by group and dimension."""
    dims = rows.select(*keys, F.posexplode(x).alias("dim", "v")).groupBy(*keys, "dim").agg(F.avg("v").alias("v"))
    return dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda p: p["v"]).alias("centroid"))


def centroid_distance(rows: DataFrame, references: DataFrame) -> DataFrame:
    """(id, distance) of each row to the references' centroid."""
    return rows.join(F.broadcast(centroids(references, [])), F.lit(True)).select("id", distance("x", "centroid").alias("distance"))


def mean_nearest(rows: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(id, distance): the mean distance to the k nearest references; k must be less than their number."""
    if references.limit(k + 1).count() <= k:
        raise ValueError(f"k = {k} needs more references")
    return nearest(rows, references, k).groupBy("id").agg(F.avg("distance").alias("distance"))


def _moments(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        n, fourth, outer = 0, 0.0, np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist()) - centre
                n, fourth, outer = n + len(x), fourth + float(((x * x).sum(axis=1) ** 2).sum()), outer + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([fourth]), pa.array([outer.ravel().tolist()], pa.list_(pa.float64()))], ["n", "fourth", "outer"])

    return run


def ledoit_wolf(references: DataFrame) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(mean, covariance, shrinkage, n) of the references; each task hands on one matrix of squared dimensions."""
    centre = np.array(centroids(references, []).first()["centroid"])
    parts = references.select("x").mapInArrow(_moments(centre), "n long, fourth double, outer array<double>")
    dims = parts.select(F.posexplode("outer").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    total = parts.agg(F.sum("n").alias("n"), F.sum("fourth").alias("fourth")).first()
    d, n = len(centre), int(total.n)
    flat = np.zeros(d * d)
    for r in dims.toLocalIterator():
        flat[r["at"]] = r.v
    s = flat.reshape(d, d) / n
    mu = np.trace(s) / d
    spread = ((s - mu * np.eye(d)) ** 2).sum() / d
    noise = min(spread, (total.fourth / n - (s * s).sum()) / n / d)
    shrinkage = noise / spread if spread else 0.0
    return centre, (1 - shrinkage) * s + shrinkage * mu * np.eye(d), shrinkage, n


def mahalanobis(rows: DataFrame, references: DataFrame, strict: bool = False) -> tuple[str, DataFrame | None]:
    """(status, (id, distance)) with the shrunk covariance of the references; too few, or an ill-conditioned matrix, are skipped, or an error if strict."""
    first = references.select(F.size("x").alias("d")).first()
    status = "ok"
    if first is None or references.count() < LEAST_PER_DIMENSION * first.d:
        status = f"skipped_reference_count_lt_{LEAST_PER_DIMENSION}x_dim"
    else:
        centre, covariance, _, _ = ledoit_wolf(references)
        if not np.isfinite(covariance).all() or np.linalg.cond(covariance) > MOST_CONDITION:
            status = "skipped_condition"
    if status != "ok":
        if strict:
            raise ValueError(status)
        return status, None
    # x' P x is the squared length of L'x, for P = L L'
    root = np.linalg.cholesky(np.linalg.inv(covariance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, len(centre)) - centre
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(((x @ root) ** 2).sum(axis=1)))], ["id", "distance"])

    return status, rows.select("id", "x").mapInArrow(run, "id long, distance double")


def silhouette(rows: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """(id, family, silhouette) by Euclidean distance. Every block of at most limit rows meets every other and leaves the sums by family of each of its rows."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "family")]

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = matrix(a), matrix(b)
        families = np.array(b.column("family").to_pylist())
        own, other = np.array(a.column("id").to_pylist()), np.array(b.column("id").to_pylist())
        out: dict[str, list] = {"id": [], "family": [], "family2": [], "s": [], "n": []}
        for family in np.unique(families).tolist() if len(x) else []:
            at = np.flatnonzero(families == family)
            apart = own[:, None] != other[at][None]
            far = np.sqrt(squared_distances(x, y[at])) * apart
            out["id"] += a.column("id").to_pylist()
            out["family"] += a.column("family").to_pylist()
            out["family2"] += [family] * len(x)
            out["s"] += far.sum(axis=1).tolist()
            out["n"] += apart.sum(axis=1).tolist()
        types = {"id": a.schema.field("id").type, "family": a.schema.field("family").type, "family2": a.schema.field("family").type, "s": pa.float64(), "n": pa.int64()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    def added(found: pa.Table) -> pa.Table:
        return found.group_by(["id", "family", "family2"]).aggregate([("s", "sum"), ("n", "sum")]).rename_columns(["id", "family", "family2", "s", "n"])

    part = rows.select("id", "family", "x")
    sums = block_pairs(part, part, work, f"id {kinds[0]}, family {kinds[1]}, family2 {kinds[1]}, s double, n long", added, limit)
    mean = sums.groupBy("id", "family", "family2").agg((F.sum("s") / F.sum("n")).alias("m"))
    ab = mean.groupBy("id", "family").agg(F.max(F.when(F.col("family2") == F.col("family"), F.col("m"))).alias("a"), F.min(F.when(F.col("family2") != F.col("family"), F.col("m"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.select("id", "family", value.alias("silhouette"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """One row: the mean over families of the worst ratio of spreads to the distance of centroids."""
    c = centroids(rows, ["family"])
    spread = rows.join(c, "family").groupBy("family").agg(F.avg(distance("x", "centroid")).alias("s"))
    c = c.join(spread, "family")
    other = c.select(F.col("family").alias("f2"), F.col("centroid").alias("c2"), F.col("s").alias("s2"))
    ratios = c.join(other, F.col("family") != F.col("f2")).select("family", ((F.col("s") + F.col("s2")) / distance("centroid", "c2")).alias("r"))
    return ratios.groupBy("family").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def neighbour_purity(rows: DataFrame, k: int) -> DataFrame:
    """(family, purity): the mean share of a row's k nearest others that are of its family."""
    families = rows.select(F.col("id").alias("ref_id"), F.col("family").alias("ref_family"))
    met = nearest(rows, rows, k).join(families, "ref_id").join(rows.select("id", "family"), "id")
    return met.groupBy("id", "family").agg(F.avg((F.col("family") == F.col("ref_family")).cast("int")).alias("p")).groupBy("family").agg(F.avg("p").alias("purity"))


def roc_auc(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """The area under the curve from the counts of both classes at each score; null where a class is missing. Null scores stay out."""
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("value")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    found = ds.cumulated(counts, keys, ["pos", "neg"])
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / (F.max("pos_all") * F.max("neg_all"))
    return found.groupBy(*keys).agg(F.when((F.max("pos_all") > 0) & (F.max("neg_all") > 0), area).alias("auc"))


def folded(rows: DataFrame, label: str, item: str, folds: int) -> DataFrame:
    """Adds fold: the rows of each label dealt in turn, in the order of a draw; ranged, not sorted in one task."""
    return ranked(rows, [label], hash_draw("fold", F.col(item).cast("string")), [item]).withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank", "_n")


def cross_validated_scores(rows: DataFrame, folds: int = 5) -> DataFrame:
    """(id, family, score) out of fold: scaling and a logistic model with balanced weights, fitted on the other folds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = folded(rows, "family", "id", folds).select("id", "family", "fold", F.col("family").cast("double").alias("label"), array_to_vector("x").alias("raw"))
    scored = None
    for f in range(folds):
        train = ready.filter(F.col("fold") != f)
        sizes = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        weight = F.when(F.col("label") == 1, sum(sizes.values()) / (2 * sizes.get(1.0, 1))).otherwise(sum(sizes.values()) / (2 * sizes.get(0.0, 1)))
        stages = [StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(weightCol="weight", maxIter=100, regParam=1e-4)]
        out = Pipeline(stages=stages).fit(train.withColumn("weight", weight)).transform(ready.filter(F.col("fold") == f).withColumn("weight", F.lit(1.0)))
        part = out.select("id", "family", vector_to_array("probability")[1].alias("score"))
        scored = part if scored is None else scored.unionByName(part)
    return scored


def standardised(rows: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """Rows with x scaled by the mean and population deviation of other rows; dimensions without spread are only centred."""
    dims = fitted_on.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = dims.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("_scale"))
    scaled = F.zip_with("x", "_scale", lambda v, p: (v - p["m"]) / F.when(p["s"] > 0, p["s"]).otherwise(1.0))
    return rows.join(F.broadcast(scale), F.lit(True)).withColumn("x", scaled).drop("_scale")


def principal_components(rows: DataFrame, fitted_on: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(rows with scores, shares of variance) of the components of the standardised rows; signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = PCA(k=k, inputCol="v", outputCol="s").fit(standardised(fitted_on, fitted_on).select(array_to_vector("x").alias("v")))
    out = model.transform(standardised(rows, fitted_on).withColumn("v", array_to_vector("x")))
    return out.withColumn("scores", vector_to_array("s")).drop("v", "s"), model.explainedVariance.toArray().tolist()


def same_vectors(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many ids both have, and the greatest difference of any component."""
    other = right.select("id", F.col("x").alias("y"))
    gap = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b)))
    return left.join(other, "id").agg(F.count("*").alias("n"), F.max(gap).alias("largest_gap"))


def direction_changes(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Metrics (metric, value, higher_is_better, scenario) of two scenarios with their difference and what it means."""
    a = metrics.filter(F.col("scenario") == base).select("metric", "higher_is_better", F.col("value").alias("before"))
    b = metrics.filter(F.col("scenario") == other).select("metric", F.col("value").alias("after"))
    delta = F.col("after") - F.col("before")
    verdict = F.when(delta == 0, "same").when((delta > 0) == F.col("higher_is_better"), "improved").otherwise("weakened")
    return a.join(b, "metric").select("metric", delta.alias("delta"), verdict.alias("verdict"))


def majority_share(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("majority_share"), F.count("*").alias("n_labels"), F.min("_n").alias("least"))


def dimension_correlations(rows: DataFrame, value: str) -> DataFrame:
    """(dim, pearson, spearman): each dimension against a property; null and NaN values are left out."""
    fine = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return correlations(fine.select(F.posexplode("x").alias("dim", "v"), F.col(value).cast("double").alias("p")), ["dim"], "v", "p")


def expanded(rows: DataFrame, keys: list[str], sources: list[str]) -> DataFrame:
    """One row for each of the listed sources, with its place in the list."""
    return rows.select(*keys, F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("embedding_index", "embedding_source"))


def rolled_up(long: DataFrame, item: str) -> DataFrame:
    """Per item its sources, their number, and whether its index is one in all of them."""
    return long.groupBy(item).agg(
        F.array_join(F.array_sort(F.collect_set("embedding_source")), ";").alias("sources"), F.count("*").alias("n"), (F.min("embedding_index") == F.max("embedding_index")).alias("one_index")
    )
