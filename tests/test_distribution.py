import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.operators import aggregates as ag
from tessella.operators import distribution as ds
from tessella.operators import ranking, resample, vectors
from tessella.registry import QUERIES

#: Nine tenths of the rows of a group have one value; another group has no key, one a single row, one only nulls.
ROWS = [("a", i, 0.0 if i % 10 else float(i % 97)) for i in range(3000)] + [(None, i, float(i * 7 % 300)) for i in range(800)] + [("b", 1, -2.5), ("c", 1, None), ("a", 9000, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, i long, v double").repartition(6)


def groups(null=False):
    return {g: [(v, i) for k, i, v in ROWS if k == g and (null or v is not None)] for g in ("a", "b", None)}


def test_a_common_value_is_one_row_of_a_range(spark, rows):
    found = ds.cumulated(ds.counted(rows, ["g"], "v"), ["g"], ["n"])
    assert found.groupBy("g", "range").count().agg(F.max("count")).first()[0] <= 12  # of 300 distinct values
    for r in found.collect():
        values = [v for k, _, v in ROWS if k == r.g]
        less = lambda v: (r.value is not None) and (v is None or v < r.value)  # noqa: E731, B023
        assert (r.n, r.n_below, r.n_all) == (sum(v == r.value for v in values), sum(map(less, values)), len(values))


def test_quantiles_and_shares(rows):
    got = {r.g: tuple(r)[1:] for r in ag.quantiles(rows, ["g"], "v", [0.0, 0.37, 0.95, 1.0]).collect()}
    shares = {r.g: (r.n_top, r.share) for r in ag.top_share(rows, ["g"], "v", 0.03).collect()}
    assert got.keys() == shares.keys() == {"a", "b", None}
    for g, values in groups().items():
        v = np.array([x for x, _ in values])
        assert got[g] == pytest.approx(tuple(np.percentile(v, [0, 37, 95, 100])))
        top = -(-3 * len(v) // 100)
        assert shares[g] == (top, pytest.approx(np.sort(v)[::-1][:top].sum() / v.sum()))


def test_average_ranks(rows):
    got = {(r.g, r.i): r.r for r in ds.average_ranks(rows, ["g"], "v", "r").collect()}
    assert len(got) == len(ROWS) and got["c", 1] is None
    for g, values in groups().items():
        v = np.array([x for x, _ in values])
        for x, i in values[::37]:
            assert got[g, i] == (v < x).sum() + ((v == x).sum() + 1) / 2


@pytest.mark.parametrize("fraction", [0.05, 0.2, 0.5, 1.0])
def test_bands_cut_a_common_value_by_ties(rows, fraction):
    got = {(r.g, r.i): r.band for r in ranking.bands(rows, ["g"], "v", "i", fraction).collect()}
    for g, values in groups(null=True).items():
        order = sorted(values, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        size = int(np.ceil(fraction * len(order)))
        for k, (_, i) in enumerate(order, 1):
            assert got[g, i] == ("easy" if k <= size else "hard" if k > len(order) - size else "middle")


def test_null_keys_stay(rows):
    buckets = ranking.quantile_buckets(rows.filter("v is not null"), ["g"], "v", [0.5]).groupBy("g").count()
    assert {r.g: r["count"] for r in buckets.collect()} == {g: len(v) for g, v in groups().items()}
    found = ag.residual_decomposition(rows.select("g", F.col("v").alias("target"), (F.col("v") + F.col("i") % 5).alias("prediction")), ["g"])
    got = {r.g: r for r in found.collect()}
    for g, values in groups().items():
        v, e = np.array([x for x, _ in values]), np.array([i % 5 for _, i in values])
        assert got[g].median_ae == np.median(e) and got[g].p90 == pytest.approx(np.percentile(e, 90))
        assert got[g].mae_q1 == pytest.approx(e[v <= np.percentile(v, 25)].mean())
    assert got["c"].n == 1 and got["c"].median_ae is None and got["c"].mae_q1 is None


def test_adjusted_p_values(rows):
    tests = rows.withColumn("p", F.when(F.col("v") >= 0, (F.col("v") % 50 + 1) / 60)).select("g", "i", "p")
    got = {(r.g, r.i): r.q for r in ranking.benjamini_hochberg(tests, ["g"], "p").collect()}
    assert len(got) == len(ROWS) and got["b", 1] is None and got["c", 1] is None
    for g in ("a", None):
        p = np.array(sorted((v % 50 + 1) / 60 for k, _, v in ROWS if k == g and v is not None))
        steps = np.minimum(1, np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
        for k, i, v in ROWS[::53]:
            if k == g and v is not None:
                x = (v % 50 + 1) / 60
                assert got[g, i] == pytest.approx(steps[np.flatnonzero(np.isclose(p, x))[0]])


def test_area_and_correlations(rows):
    marked = rows.withColumn("y", (F.col("i") % 3 == 0).cast("int"))
    got = {r.g: r.auc for r in vectors.roc_auc(marked, ["g"], "v", "y").collect()}
    for g in ("a", None):
        pos, neg = ([v for v, i in groups()[g] if (i % 3 == 0) == want] for want in (True, False))
        neg = np.array(neg)
        assert got[g] == pytest.approx(np.mean([(neg < p).mean() + (neg == p).mean() / 2 for p in pos]))
    assert got["b"] is None
    both = {r.g: (r.pearson, r.spearman) for r in resample.correlations(rows, ["g"], "v", "i").collect()}
    for g in ("a", None):
        v, i = (np.array(x, float) for x in zip(*groups()[g], strict=True))
        rank = lambda x: np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x])
        assert both[g] == pytest.approx((np.corrcoef(v, i)[0, 1], np.corrcoef(rank(v), rank(i))[0, 1]))


def test_empty(rows):
    none = rows.limit(0)
    assert ag.quantiles(none, ["g"], "v", [0.5]).count() == ranking.bands(none, ["g"], "v", "i").count() == 0
    assert ranking.benjamini_hochberg(none, ["g"], "v").count() == ag.residual_decomposition(none.select("g", F.col("v").alias("target"), F.col("v").alias("prediction")), ["g"]).count() == 0


def test_cross_validated_areas(spark):
    rng = np.random.default_rng(2)
    data = [(i, i % 2, (rng.normal(size=3) + [3.0 * (i % 2), 0, 0]).tolist(), rng.normal(size=3).tolist()) for i in range(240)]
    rows = spark.createDataFrame(data, "id long, family int, near array<double>, noise array<double>")
    areas = {}
    for name in ("near", "noise"):
        scores = vectors.cross_validated_scores(rows.select("id", "family", F.col(name).alias("x"))).withColumn("g", F.lit(1))
        areas[name] = vectors.roc_auc(scores, ["g"], "score", "family").first().auc
        assert scores.count() == 240 == scores.select("id").distinct().count()
    x = np.array([r[2][0] for r in data])
    y = np.array([r[1] for r in data])
    best = np.mean(x[y == 1][:, None] > x[y == 0])  # of the one dimension that tells
    assert areas["near"] == pytest.approx(best, abs=0.02) and abs(areas["noise"] - 0.5) < 0.12
    folds = vectors.folded(rows, "family", "id", 5).groupBy("family", "fold").count().collect()
    assert {r["count"] for r in folds} == {24} and len(folds) == 10


def test_means_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    big = 2.0**54
    ways = [[big, 1.0, -big, -1.0], [-1.0, 1.0, big, -big], [0.1, 0.7, 0.2, 1e-9], [3.0, None, float("inf")], [None], [0.0, 0.0]]
    rows = [(str(i), v) for i, way in enumerate(ways) for v in way]
    got = {r.g: (r.n, r["mean"]) for r in ds.means(spark.createDataFrame(rows, "g string, v double").coalesce(1), ["g"], "v").collect()}
    assert got == {"0": (4, 0.0), "1": (4, 0.0), "2": (4, math.fsum(ways[2]) / 4), "3": (3, math.inf), "4": (1, None), "5": (2, 0.0)}
    table = pa.table({"user_id": [0] * 4 + [1] * 4, "event_type": ["a"] * 8, "value": ways[0] + ways[1]})
    pq.write_table(table, tmp_path / "events.parquet")  # both users' means are zero, as their medians
    assert [tuple(r) for r in QUERIES["JN10"](spark, str(tmp_path)).collect()] == [("a", 2, 0)]
