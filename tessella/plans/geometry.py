"""Vector queries (VE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import vectors as ve
from tessella.plans.aggregates import rounded
from tessella.plans.base import VECTORS, documents, query, table, vectors

DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
FLAT = f"{VECTORS}, flat AS (SELECT id, label, family, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM vecs)"
CENTRES = f"{FLAT}, dimc AS (SELECT family, dim, avg(v) AS v FROM flat GROUP BY 1, 2), cent AS (SELECT family, list(v ORDER BY dim) AS c FROM dimc GROUP BY 1)"
REF = f"{FLAT}, refc AS (SELECT list(v ORDER BY dim) AS c FROM (SELECT dim, avg(v) AS v FROM flat WHERE label <= 7 GROUP BY 1))"


def split(spark, d):
    rows = vectors(spark, d)
    return rows.filter("label > 7"), rows.filter("label <= 7")


@query("VE1", f"WITH {CENTRES} SELECT family, list_transform(c, lambda v: round(v, 8) + 0.0) AS centroid FROM cent")
def centroids(spark, d):
    return ve.centroids(vectors(spark, d), ["family"]).select("family", F.transform("centroid", lambda v: F.round(v, 8) + F.lit(0.0)).alias("centroid"))


@query("VE2", f"WITH {REF} SELECT id, round({DIST.format('x', 'c')}, 8) AS distance FROM vecs, refc WHERE label > 7")
def centroid_distance(spark, d):
    return rounded(ve.centroid_distance(*split(spark, d)), 8, "distance")


@query("VE3", f"""WITH {VECTORS}, p AS (SELECT q.id, {DIST.format('q.x', 'r.x')} AS distance FROM vecs q JOIN vecs r ON q.label > 7 AND r.label <= 7)
SELECT id, round(avg(distance), 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance) AS k FROM p) WHERE k <= 5 GROUP BY 1""")
def mean_nearest(spark, d):
    return rounded(ve.mean_nearest(*split(spark, d), 5), 8, "distance")


@query("VE4")
def mahalanobis(spark, d):
    """Distances under a shrunk covariance; its matrices are beyond SQL, so a test holds it against numpy."""
    _, found = ve.mahalanobis(*split(spark, d))
    return found


PAIRS = f"""{VECTORS}, pr AS (SELECT a.id, a.family, b.family AS f2, avg({DIST.format('a.x', 'b.x')}) AS m FROM vecs a JOIN vecs b ON a.id <> b.id GROUP BY 1, 2, 3),
ab AS (SELECT id, family, max(m) FILTER (f2 = family) AS a, min(m) FILTER (f2 <> family) AS b FROM pr GROUP BY 1, 2)"""


@query("VE5", f"WITH {PAIRS} SELECT id, family, round((b - a) / greatest(a, b), 8) AS silhouette FROM ab")
def silhouette(spark, d):
    return rounded(ve.silhouette(vectors(spark, d).select("id", "family", "x")), 8, "silhouette")


@query("VE6", f"""WITH {CENTRES}, s AS (SELECT family, c, avg({DIST.format('x', 'c')}) AS s FROM vecs JOIN cent USING (family) GROUP BY 1, 2),
r AS (SELECT a.family, max((a.s + b.s) / {DIST.format('a.c', 'b.c')}) AS r FROM s a JOIN s b ON a.family <> b.family GROUP BY 1) SELECT round(avg(r), 8) AS davies_bouldin FROM r""")
def davies_bouldin(spark, d):
    return rounded(ve.davies_bouldin(vectors(spark, d)), 8, "davies_bouldin")


@query("VE7", f"""WITH {VECTORS}, p AS (SELECT a.id, a.family, b.family AS f2, row_number() OVER (PARTITION BY a.id ORDER BY {DIST.format('a.x', 'b.x')}, b.id) AS k FROM vecs a JOIN vecs b ON a.id <> b.id)
SELECT family, round(avg(p), 8) AS purity FROM (SELECT id, family, avg((family = f2)::INT) AS p FROM p WHERE k <= 15 GROUP BY 1, 2) GROUP BY 1""")
def neighbour_purity(spark, d):
    return rounded(ve.neighbour_purity(vectors(spark, d).select("id", "family", "x"), 15), 8, "purity")


@query("VE8", """WITH r AS (SELECT label % 2 AS y, label // 5 AS grp, rank() OVER (PARTITION BY label // 5 ORDER BY embedding[1]) + (count(*) OVER (PARTITION BY label // 5, embedding[1]) - 1) / 2.0 AS r FROM embeddings)
SELECT grp::INTEGER AS grp, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 8)::DOUBLE AS auc FROM r GROUP BY 1""")
def roc_auc(spark, d):
    rows = vectors(spark, d).select(F.floor(F.col("label") / 5).cast("int").alias("grp"), "family", F.col("x")[0].alias("score"))
    return rounded(ve.roc_auc(rows, ["grp"], "score", "family"), 8, "auc")


@query("VE9")
def cross_validated_auc(spark, d):
    """The area under the curve of out-of-fold logistic scores; fitting is beyond SQL."""
    scores = ve.cross_validated_scores(vectors(spark, d).select("id", "family", "x")).withColumn("source", F.lit("embeddings"))
    return ve.roc_auc(scores, ["source"], "score", "family")


@query("VE10", f"""WITH {FLAT}, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM flat WHERE label <= 7 GROUP BY 1) SELECT dim::INTEGER AS dim, round(avg((v - m) / s), 6) + 0.0 AS mean, round(stddev_pop((v - m) / s), 6) AS sd FROM flat JOIN s USING (dim) WHERE label > 7 GROUP BY 1""")
def standardised(spark, d):
    rows, refs = split(spark, d)
    flat = ve.standardised(rows, refs).select(F.posexplode("x").alias("dim", "v"))
    return rounded(flat.groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")), 6, "mean", "sd")


@query("VE11")
def principal_components(spark, d):
    """Shares of variance and the mean size of the scores; a test holds them against numpy."""
    rows, refs = split(spark, d)
    scored, shares = ve.principal_components(rows, refs)
    found = scored.select(F.posexplode("scores").alias("component", "score")).groupBy("component").agg(F.round(F.avg(F.abs("score")), 6).alias("mean_size"))
    return found.withColumn("share", F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("component") + 1))


@query("VE13", f"WITH {VECTORS} SELECT count(*) AS n, round(max(list_max(list_transform(x, lambda v: abs(v - v * 1.25)))), 8) AS largest_gap FROM vecs")
def same_vectors(spark, d):
    """All vectors beside ones that are a quarter longer."""
    rows = vectors(spark, d)
    return ve.same_vectors(rows, rows.withColumn("x", F.transform("x", lambda v: v * 1.25))).select("n", F.round("largest_gap", 8).alias("largest_gap"))


@query("VE14", """WITH m AS (SELECT event_type AS metric, event_type < 'd' AS better, avg(value) AS before, avg(value) FILTER (event_id % 3 = 0) AS after FROM events GROUP BY 1, 2)
SELECT metric, round(after - before, 8) AS delta, CASE WHEN after = before THEN 'same' WHEN (after > before) = better THEN 'improved' ELSE 'weakened' END AS verdict FROM m""")
def direction_changes(spark, d):
    def scenario(rows, name):
        return rows.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")).withColumn("higher_is_better", F.col("metric") < "d").withColumn("scenario", F.lit(name))

    events = table(spark, d, "events")
    return rounded(ve.direction_changes(scenario(events, "all").unionByName(scenario(events.filter("event_id % 3 = 0"), "kept")), "all", "kept"), 8, "delta")


@query("VE15", "SELECT source, round(max(n)::DOUBLE / sum(n), 8) AS majority_share, count(*) AS n_labels, min(n) AS least FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def majority_share(spark, d):
    return rounded(ve.majority_share(documents(spark, d), ["source"], "lang"), 8, "majority_share")


RANK = "(rank() OVER (PARTITION BY dim ORDER BY {0}) + (count(*) OVER (PARTITION BY dim, {0}) - 1) / 2.0)::DOUBLE"


@query("VE16", f"WITH {FLAT}, r AS (SELECT dim, v, label::DOUBLE AS p, {RANK.format('v')} AS a, {RANK.format('label')} AS b FROM flat WHERE id % 9 <> 0) SELECT dim::INTEGER AS dim, round(corr(v, p), 8) AS pearson, round(corr(a, b), 8) AS spearman FROM r GROUP BY 1")
def dimension_correlations(spark, d):
    rows = vectors(spark, d).withColumn("p", F.when(F.col("id") % 9 != 0, F.col("label").cast("double")))
    return rounded(ve.dimension_correlations(rows, "p"), 8, "pearson", "spearman")


@query("VE17", f"WITH {FLAT} SELECT label, dim::INTEGER AS dim, round(avg(v), 8) + 0.0 AS v FROM flat GROUP BY 1, 2")
def mean_pooling(spark, d):
    pooled = ve.centroids(vectors(spark, d), ["label"])
    return rounded(pooled.select("label", F.posexplode("centroid").alias("dim", "v")), 8, "v")


@query("VE18", "SELECT vec_id AS id, i::INTEGER AS embedding_index, s AS embedding_source FROM embeddings, (VALUES (0, 'pre_head'), (1, 'last_pool'), (2, 'first_pool')) t(i, s)")
def expanded(spark, d):
    return ve.expanded(vectors(spark, d), ["id"], ["pre_head", "last_pool", "first_pool"])


@query("VE19", "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS sources, count(*) AS n, min(event_id % 5) = max(event_id % 5) AS one_index FROM events GROUP BY 1")
def rolled_up(spark, d):
    long = table(spark, d, "events").select("user_id", F.col("event_type").alias("embedding_source"), (F.col("event_id") % 5).alias("embedding_index"))
    return ve.rolled_up(long, "user_id")
