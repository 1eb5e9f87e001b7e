import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import permutations as pm
from tessella.operators import replicates as rp
from tessella.operators import resample as rs

#: One value fills most of an arm, one arm has no name, one a single row; some values are missing.
ROWS = [("a", i, 0.0 if i % 5 else float(i * 37 % 211), float(i % 7)) for i in range(900)] + [(None, i, float(i % 83), float(i % 83) + i % 3) for i in range(400)] + [("b", 1, 4.0, 1.0), ("c", 1, None, None)]
REPS = 60


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, i long, v double, w double").repartition(5)


def drawn(blocks, order):
    """The rows of each (arm, rep), repeated as often as they are drawn."""
    held = defaultdict(list)
    for r in blocks.rows.orderBy("arm", "block", order).collect():
        held[r.arm, r.block].append(r)
    out = defaultdict(list)
    for r in rp.multiplicities(blocks, order, REPS, "s").collect():
        out[r.arm, r.rep] += [held[r.arm, r.block][r.place]] * r.times
    return out


def test_values_are_drawn_as_often_as_there_are_rows(rows):
    blocks = rp.value_blocks(rows, "g", "v", 16)
    assert blocks.levels >= 3 and blocks.rows.select("block").distinct().count() > 4
    every = drawn(blocks, "value")
    sizes = {"a": 900, "": 400, "b": 1}
    assert {k for k, _ in every} == set(sizes) and all(len(v) == sizes[k] for (k, _), v in every.items())
    zeros = np.array([sum(r.value == 0 for r in every["a", rep]) for rep in range(REPS)])
    share = sum(v == 0 for g, _, v, _ in ROWS if g == "a") / 900
    assert abs(zeros.mean() - 900 * share) < 5 * np.sqrt(900 * share * (1 - share) / REPS) and 0.4 < zeros.var() / (900 * share * (1 - share)) < 2.2
    means = {(r.arm, r.rep): (r.n, r.stat) for r in rp.replicate_means(rows, "g", "v", REPS, "s", 16).collect()}
    medians = {(r.arm, r.rep): r.stat for r in rp.replicate_medians(rows, "g", "v", REPS, "s", 16).collect()}
    assert means.keys() == medians.keys() == every.keys()
    for k, v in every.items():
        values = [r.value for r in v]
        assert means[k] == (len(values), pytest.approx(np.mean(values))) and medians[k] == np.median(values)


def test_blocks_and_partitions_change_no_distribution(rows):
    spread = [np.array([r.stat for r in rp.replicate_means(rows, "g", "v", 2000, "s", size).filter("arm = ''").collect()]) for size in (8, 4096)]
    v = np.array([x for g, _, x, _ in ROWS if g is None])
    for s in spread:
        assert s.mean() == pytest.approx(v.mean(), abs=0.2) and s.std() == pytest.approx(v.std() / 20, rel=0.08)
    again = [sorted((r.arm, r.rep, r.stat) for r in rp.replicate_means(rows.repartition(n), "g", "v", 9, "s", 16).collect()) for n in (1, 7)]
    assert [x[:2] for x in again[0]] == [x[:2] for x in again[1]] and [x[2] for x in again[0]] == pytest.approx([x[2] for x in again[1]])


def test_correlations(rows):
    pairs = rows.filter("v is not null and w is not null")
    blocks = rp.row_blocks(pairs.withColumn("g", F.coalesce("g", F.lit(""))), "g", "i", ["v", "w"], 32)
    every = drawn(blocks, "item")
    got = {(r.arm, r.rep): r.stat for r in rp.replicate_correlations(rows, "g", "i", "v", "w", REPS, "s", 32).collect()}
    assert got.keys() == every.keys() and got["b", 0] is None
    for (arm, rep), v in every.items():
        if arm != "b":
            assert got[arm, rep] == pytest.approx(np.corrcoef([r.v for r in v], [r.w for r in v])[0, 1])


def test_areas(spark, rows):
    marked = rows.filter("g = 'a' or g is null").withColumn("y", (F.col("i") % 4 == 0).cast("int"))
    for size in (16, 4096):
        stats = np.array([r.stat for r in rp.replicate_areas(marked, "v", "y", 400, "s", size).collect()])
        kept = [(v, i % 4 == 0) for g, i, v, _ in ROWS if g in ("a", None)]
        pos, neg = (np.array([v for v, y in kept if y == want]) for want in (True, False))
        area = lambda p, n: ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2)
        rng = np.random.default_rng(0)
        plain = np.array([area(rng.choice(pos, len(pos)), rng.choice(neg, len(neg))) for _ in range(400)])
        assert len(stats) == 400 and stats.mean() == pytest.approx(area(pos, neg), abs=0.004) and stats.std() == pytest.approx(plain.std(), rel=0.2)
    assert rp.replicate_areas(marked.filter("y = 1"), "v", "y", 5, "s").count() == 0
    apart = spark.createDataFrame([(float(i), int(i >= 50)) for i in range(90)], "v double, y int")
    assert all(r.stat == pytest.approx(1.0) for r in rp.replicate_areas(apart, "v", "y", 20, "s", 8).collect())


def index(x, f):
    names = sorted(set(f))
    centres = {k: x[f == k].mean(0) for k in names}
    spread = {k: np.linalg.norm(x[f == k] - centres[k], axis=1).mean() for k in names}
    return np.mean([max((spread[a] + spread[b]) / np.linalg.norm(centres[a] - centres[b]) for b in names if b != a) for a in names])


def test_davies_bouldin(spark):
    rng = np.random.default_rng(1)
    data = [(i, f"f{i % 3}", (rng.normal(size=5) + 2 * (i % 3)).tolist()) for i in range(300)]
    rows = spark.createDataFrame(data, "id long, family string, x array<double>")
    blocks = rp.row_blocks(rows, "family", "id", ["x"], 16)
    every = drawn(blocks, "item")
    got = {r.rep: r.stat for r in rp.replicate_davies_bouldin(rows, REPS, "s", 16).collect()}
    assert len(got) == REPS
    for rep in range(0, REPS, 7):
        own = [(r.x, k) for (k, p), v in every.items() if p == rep for r in v]
        assert got[rep] == pytest.approx(index(np.array([x for x, _ in own]), np.array([k for _, k in own])))
    assert rp.replicate_davies_bouldin(rows.filter("family = 'f1'"), 3, "s").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1009])
def test_every_replicate_is_a_permutation(spark, n):
    rows = spark.range(n).select(F.lit("a").alias("arm"), F.col("id").alias("k"), F.lit(n).cast("long").alias("n"))
    got = defaultdict(dict)
    for r in pm.placed(rows, 25, "s").collect():
        got[r.rep][r.k] = r.place
    assert len(got) == 25 and all(sorted(p.values()) == list(range(n)) == sorted(p) for p in got.values())
    if n > 100:
        fixed = [sum(k == v for k, v in p.items()) for p in got.values()]
        assert len({tuple(p[k] for k in range(n)) for p in got.values()}) == 25 and np.mean(fixed) < 3  # one is to be expected


def test_permuted_correlations_spread_as_they_should(spark):
    rows = pm.numbered(spark.range(500).select(F.lit(None).cast("string").alias("g"), "id", F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("y")), "g", "id")
    stats = np.array([r.stat for r in pm.permuted(rows.select("arm", "k", "n", "x", "y"), 600, "s").groupBy("rep").agg(F.corr("x", "y").alias("stat")).collect()])
    assert abs(stats.mean()) < 0.008 and stats.std() == pytest.approx(1 / np.sqrt(499), rel=0.12)


def test_plans_hold_no_window_by_replicate(spark, rows):
    numbered = pm.numbered(rows, "g", "i").select("arm", "k", "n", F.col("v").alias("x"), F.col("w").alias("y"))
    plan = pm.permuted(numbered, 5, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "rep#" in plan and not any("Window" in line and "rep#" in line for line in plan.splitlines())
    assert rs.interval(rp.replicate_means(rows.limit(0), "g", "v", 5, "s"), ["arm"], "stat").count() == 0


def test_blocks_of_distinct_rows_look_their_multiplicities_up():
    items, reps = 2048, 4000
    draws = rp.Draws("s", "a", 0, [{"whole": 2 * items, "left": items}], np.ones(items, np.int64), reps)
    total, square, beside, seen, spent = np.zeros(items), np.zeros(items), 0.0, 0, []
    steps = draws.chunks()
    while True:
        start = time.process_time()
        at, times = next(steps, (None, None))
        if at is None:
            break
        spent.append((time.process_time() - start) / times.size)
        assert at.start == seen and (times.sum(axis=1) == draws.own[at]).all()
        seen, total, square, beside = at.stop, total + times.sum(axis=0), square + (times**2).sum(axis=0), beside + (times[:, 1:] * times[:, :-1]).sum()
    n, p = draws.own.astype(float), 1 / items
    assert seen == reps and n.std() > 20
    assert abs(total - n.sum() * p).max() < 6 * np.sqrt(n.sum() * p)
    assert square.sum() / (n + n * (n - 1) * p).sum() == pytest.approx(1, abs=0.002)
    assert beside / (n * (n - 1) * p * p).sum() / (items - 1) == pytest.approx(1, abs=0.002)
    plain, rng = [], np.random.default_rng(0)
    for _ in range(20):
        start = time.process_time()
        np.bincount(rng.integers(0, items, 1 << 18) + np.repeat(np.arange(128) * items, items), minlength=1 << 18)
        plain.append((time.process_time() - start) / (1 << 18))
    assert np.median(spent) < 0.75 * np.median(plain)  # draw by draw
