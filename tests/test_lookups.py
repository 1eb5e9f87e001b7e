"""Draws and places looked up in blocks, beside the same draws and places as rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.operators import lookups
from tessella.operators import permutations as pm
from tessella.operators import resample as rs


@pytest.fixture(scope="module")
def rows(spark):
    """Two arms, one with nulls on either side; 7 rows a block make several blocks of each."""
    x = F.when(F.col("id") % 6 != 1, (F.col("id") * 37 % 101).cast("double"))
    y = F.when(F.col("id") % 10 != 7, (F.col("id") * 53 % 97).cast("double"))
    arm = F.when(F.col("id") % 3 == 0, "full").otherwise("gaps")
    made = spark.range(60).select(arm.alias("g"), "id", F.when(arm == "full", (F.col("id") * 37 % 101).cast("double")).otherwise(x).alias("x"), F.when(arm == "full", (F.col("id") * 53 % 97).cast("double")).otherwise(y).alias("y"))
    return pm.numbered(made, "g", "id").select("arm", "k", "n", "x", "y").localCheckpoint()


def same(mine, theirs, column="stat"):
    a, b = ({(r.arm, r.rep): r[column] for r in f.collect()} for f in (mine, theirs))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_hashes_of_numbers():
    for prefix in ("42:view:7:", "x" * 54, "é" * 70):
        want = [int(hashlib.md5(f"{prefix}{j}".encode()).hexdigest()[:8], 16) for j in range(95, 1020)]
        assert lookups.hashed(prefix.encode(), 95, 1020).tolist() == want


@pytest.mark.parametrize("block_rows", [7, 1 << 22])
def test_drawn_rows_are_those_of_draws(spark, rows, block_rows):
    values = rows.select("arm", "k", "n", F.col("x").alias("value"))
    drawn = rs.draws(spark, values, 9, "42").groupBy("arm", "rep")
    same(lookups.drawn_sums(values, "value", 9, "42", block_rows), drawn.agg(F.sum("value").alias("s")), "s")
    same(lookups.drawn_sums(values, "value", 9, "42", block_rows), drawn.agg(F.count("value").alias("n")), "n")
    same(lookups.drawn_medians(values, "value", 9, "42", block_rows), drawn.agg(F.median("value").alias("stat")))
    pairs = rows.select("arm", "k", "n", F.struct("x", "y").alias("value"))
    same(lookups.drawn_correlations(rows, 9, "42", block_rows), rs.draws(spark, pairs, 9, "42").groupBy("arm", "rep").agg(F.corr("value.x", "value.y").alias("stat")))


def test_medians_of_arms_that_are_counted_near_their_middle_only(spark):
    values = spark.range(6000).select(F.lit("a").alias("arm"), F.col("id").alias("k"), F.lit(6000).cast("long").alias("n"), (F.col("id") * 7919 % 6000).cast("double").alias("value"))
    same(lookups.drawn_medians(values, "value", 5, "1", 2500), rs.draws(spark, values, 5, "1").groupBy("arm", "rep").agg(F.median("value").alias("stat")))


@pytest.mark.parametrize("block_rows", [7, 1 << 22])
def test_places_are_those_of_permuted_rows(rows, block_rows):
    same(lookups.permuted_correlations(rows, 9, "42", block_rows), pm.permuted(rows, 9, "42").groupBy("arm", "rep").agg(F.corr("x", "y").alias("stat")))


def test_no_draw_or_place_is_a_row(spark, rows):
    """Before, replicates were rows of a join: their number times that of the arm's."""
    values = rows.select("arm", "k", "n", F.col("x").alias("value"))
    for made in (lookups.drawn_sums(values, "value", 50, "42"), lookups.permuted_correlations(rows, 50, "42"), rs.replicate_means(values, 50, "42")):
        assert "_hash" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "InArrow" in plan and made.count() == 100


@pytest.mark.parametrize("block_rows", [7, 1 << 22])
def test_replicates_that_are_drawn_together_are_those_of_draws(spark, rows, block_rows, monkeypatch):
    """Numbers of replicates and rows that change their length, in pieces that part both."""
    monkeypatch.setattr(lookups, "DRAWS", 16)
    values = rows.select("arm", "k", "n", F.col("x").alias("value"))
    same(lookups.drawn_sums(values, "value", 104, "42", block_rows), rs.draws(spark, values, 104, "42").groupBy("arm", "rep").agg(F.sum("value").alias("s")), "s")
