"""Permutations without sorting: where a row goes is computed from its number.

The numbers from 0 to n - 1 stand in a grid of a times b cells, hardly more than n, and go through Feistel rounds: by
turns each of the two coordinates is moved by a keyed hash of the other. That is a bijection of the grid; a number that
lands beyond n goes on until it lands below, which makes it one of 0 to n - 1. Every replicate has its own keys, so a
permutation costs no window and no sort, and any engine with whole numbers repeats it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.products import matrix
from tessella.operators.ranking import hash_draw, ranked

#: Half-rounds; with fewer, or a hash that is nearly linear, small arms keep some of their order.
ROUNDS = 8
MASK = (1 << 31) - 1
#: Widths that are tried for the grid, from the root of n up to twice that, so that few cells are left over.
WIDTHS = 256
#: Keys of replicates, or rows, that are broadcast at most, some 100 bytes each.
BROADCAST_ROWS = 1_000_000
#: Permuted rows of a partition, about, and most partitions.
PART_ROWS = 500_000
MOST_PARTS = 10_000
#: Rows of a block of vectors.
BLOCK_ROWS = 512


def _mixed(x: Column, key: Column) -> Column:
    """31 bits of a number below 2 to the power of 31 and an odd key: the middle of a square; no product passes 62 bits."""
    spread = ((x + 1) * key).bitwiseAND(MASK)
    return F.shiftright(spread * spread, 15).bitwiseAND(MASK)


def _again(v: Column, a: Column, b: Column, keys: Column) -> Column:
    """All rounds in one expression, for the few numbers that go on."""

    def two(s: Column, k: Column) -> Column:
        left = F.pmod(s["left"] + _mixed(s["right"], k["even"]), a)
        return F.struct(left.alias("left"), F.pmod(s["right"] + _mixed(left, k["odd"]), b).alias("right"))

    start = F.struct(F.floor(v / b).alias("left"), F.pmod(v, b).alias("right"))
    return F.aggregate(keys, start, two, lambda s: s["left"] * b + s["right"])


def grid(n: int) -> tuple[int, int]:
    """Width and height of the grid that placed() takes for n rows."""
    first = math.isqrt(n - 1) + 1
    _, a = min(((n + a - 1) // a * a - n, a) for a in range(first, first + min(WIDTHS - 1, first) + 1))
    return a, (n + a - 1) // a


def moved(k: np.ndarray, n: int, a: int, b: int, keys: list[np.uint64]) -> np.ndarray:
    """The places that placed() has for unsigned numbers k below n, in a grid of a times b."""
    mask, sizes, b_ = np.uint64(MASK), (np.uint64(a), np.uint64(b)), np.uint64(b)
    left = k // b_
    right = k - left * b_
    for i, key in enumerate(keys):
        own, other = (left, right) if i % 2 == 0 else (right, left)
        mixed = other + np.uint64(1)
        mixed *= key
        mixed &= mask
        mixed *= mixed
        mixed >>= np.uint64(15)
        mixed &= mask
        mixed += own
        mixed -= mixed // sizes[i % 2] * sizes[i % 2]
        left, right = (mixed, right) if i % 2 == 0 else (left, mixed)
    place = left * b_ + right
    beyond = np.flatnonzero(place >= n)
    if len(beyond):
        place[beyond] = moved(place[beyond], n, a, b, keys)
    return place


def placed(rows: DataFrame, reps: int, seed: str) -> DataFrame:
    """rows (arm, k from 0, n, ...), each once for every replicate, with rep and place: where number k goes."""
    arms = rows.groupBy("arm").agg(F.max("n").alias("n"))
    first = F.ceil(F.sqrt("n")).cast("long")
    code = F.array_min(F.transform(F.sequence(first, first + F.least(F.lit(WIDTHS - 1), first)), lambda a: (F.floor((F.col("n") + a - 1) / a) * a - F.col("n")) * (MASK + 1) + a))
    grid = arms.withColumn("_code", code).withColumn("_a", F.pmod("_code", F.lit(MASK + 1))).withColumn("_b", F.floor((F.col("n") + F.col("_a") - 1) / F.col("_a")))
    grid = grid.select("arm", "_a", "_b", F.floor(F.col("_code") / (MASK + 1)).alias("_over"))
    every = grid.join(F.broadcast(rows.sparkSession.range(reps).select(F.col("id").alias("rep"))), F.lit(True))
    draw = [hash_draw(seed, F.col("arm").cast("string"), F.col("rep").cast("string"), F.lit(str(i))).bitwiseAND(MASK).bitwiseOR(1).alias(f"_key{i}") for i in range(ROUNDS)]
    keyed = every.select("*", *draw)
    total, n_arms = arms.agg(F.sum("n"), F.count("*")).first()
    few = n_arms * reps <= BROADCAST_ROWS
    dealt = rows.repartition(max(1, min(MOST_PARTS, (total or 0) * reps // PART_ROWS)), "arm", "k")  # before they are multiplied
    out = dealt.join(F.broadcast(keyed) if few else keyed, "arm").withColumns({"_left": F.floor(F.col("k") / F.col("_b")), "_right": F.pmod("k", "_b")})
    for i in range(ROUNDS):
        own, other, size = ("_left", "_right", "_a") if i % 2 == 0 else ("_right", "_left", "_b")
        out = out.withColumn(own, F.pmod(F.col(own) + _mixed(F.col(other), F.col(f"_key{i}")), F.col(size)))
    out = out.withColumn("_v", F.col("_left") * F.col("_b") + F.col("_right"))
    keys = F.array(*[F.struct(F.col(f"_key{i}").alias("even"), F.col(f"_key{i + 1}").alias("odd")) for i in range(0, ROUNDS, 2)])
    goes_on = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_over")), F.col("_v"), lambda v, _: F.when(v < F.col("n"), v).otherwise(_again(v, F.col("_a"), F.col("_b"), keys)))
    out = out.withColumn("place", F.when(F.col("_v") < F.col("n"), F.col("_v")).otherwise(goes_on))  # each cell left over is met once at most
    return out.select(*rows.columns, "rep", "place")


def numbered(rows: DataFrame, arm: str, order: str) -> DataFrame:
    """rows with arm, k (from 0, in the order of a number that is no tie) and n, the rows of the arm; ranged, not sorted in one task."""
    named = rows.withColumn("arm", F.coalesce(F.col(arm).cast("string"), F.lit("")))
    return ranked(named, ["arm"], order, []).withColumn("k", F.col("_rank") - 1).withColumnRenamed("_n", "n").drop("_rank")


def permuted(rows: DataFrame, reps: int, seed: str) -> DataFrame:
    """(arm, rep, x, y) of rows (arm, k, n, x, y): in each replicate the ys of an arm change places; one lookup join."""
    moved = placed(rows.select("arm", "k", "n", "y"), reps, seed).select("arm", "rep", "y", F.col("place").alias("k"))
    values = rows.select("arm", "k", "x")
    return moved.join(F.broadcast(values) if values.count() <= BROADCAST_ROWS else values.hint("shuffle_hash"), ["arm", "k"]).select("arm", "rep", "x", "y")


def p_values(observed: DataFrame, stats: DataFrame, keys: list[str], alternative: str = "greater") -> DataFrame:
    """observed (keys, stat) with p: one more than the replicates (keys, stat) at least as extreme, over one more than all that have a value."""
    extreme = {"greater": F.col("r") >= F.col("stat"), "less": F.col("r") <= F.col("stat"), "two_sided": F.abs("r") >= F.abs("stat")}[alternative]
    joined = observed.join(stats.select(*keys, F.col("stat").alias("r")), keys or F.lit(True))
    return joined.groupBy(*keys, "stat").agg(((F.count_if(extreme) + 1) / (F.count("r") + 1)).alias("p"))


def dimension_permutations(vectors: DataFrame, reps: int, seed: str) -> DataFrame:
    """(rep, dim, r): the correlation of each dimension of x with the permuted y, of rows (arm, k, n, x, y) of one arm; rep -1 is not permuted.

    Permuted ys meet the vectors in blocks of places, as a product of matrices; of a block only the sums go on. Vectors
    and ys are taken less the first moments of all, so that the sums keep their places.
    """
    dims = vectors.select("y", F.posexplode("x").alias("dim", "v"))
    of_dims = dims.groupBy("dim").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    means = F.broadcast(of_dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda m: m["mean"]).alias("_means")))  # one row
    of_y = F.broadcast(vectors.agg(F.avg("y").alias("_mean_y"), F.var_pop("y").alias("_var_y")))
    centred = vectors.join(means, F.lit(True)).join(of_y, F.lit(True))
    centred = centred.select("arm", "k", "n", F.zip_with("x", "_means", lambda v, m: v - m).alias("x"), (F.col("y") - F.col("_mean_y")).alias("y"))
    ys = centred.select("arm", "k", "n", "y")
    moved = placed(ys, reps, seed).select("rep", "place", "y").unionByName(ys.select(F.lit(-1).cast("long").alias("rep"), F.col("k").alias("place"), "y"))
    blocks = moved.withColumn("block", F.floor(F.col("place") / BLOCK_ROWS))
    own = centred.select("k", "x", F.floor(F.col("k") / BLOCK_ROWS).alias("block")).toDF("k", "x", "block")

    def products(x: pa.Table, y: pa.Table) -> pa.Table:
        first = x["block"][0].as_py() * BLOCK_ROWS
        values = np.zeros((BLOCK_ROWS, len(x["x"][0])))
        values[np.asarray(x["k"]) - first] = matrix(x)
        laid = np.zeros((reps + 1, BLOCK_ROWS))
        laid[np.asarray(y["rep"]) + 1, np.asarray(y["place"]) - first] = np.asarray(y["y"])
        sums = laid @ values
        return pa.table({"rep": np.repeat(np.arange(-1, reps), sums.shape[1]), "dim": np.tile(np.arange(sums.shape[1]), reps + 1), "s": sums.ravel()})

    sums = own.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(products, "rep long, dim long, s double").groupBy("rep", "dim").agg(F.sum("s").alias("s"))
    spread = F.sqrt(F.col("var") * F.col("_var_y")) * F.col("n")
    n = F.broadcast(vectors.agg(F.count("*").alias("n")))
    scaled = sums.join(F.broadcast(of_dims), "dim").join(of_y, F.lit(True)).join(n, F.lit(True))
    return scaled.select("rep", "dim", F.when(spread > 0, F.col("s") / spread).alias("r"))


def largest(found: DataFrame) -> DataFrame:
    """(dim, stat, p) of dimension_permutations(): p against the largest absolute correlation over all dimensions of each replicate."""
    most = found.filter("rep >= 0").groupBy("rep").agg(F.max(F.abs("r")).alias("m"))
    seen = found.filter("rep = -1 and r is not null").select("dim", F.col("r").alias("stat"))
    return seen.join(most, F.lit(True)).groupBy("dim", "stat").agg(((F.count_if(F.col("m") >= F.abs("stat")) + 1) / (F.count("m") + 1)).alias("p"))


def bijection_sql(reps: int, seed: str) -> str:
    """Parts of a WITH RECURSIVE over numbered(arm, k, n): moved(arm, rep, k, place) has the rows of placed()."""
    names = ", ".join(f"key{i}" for i in range(ROUNDS))

    def all_rounds(source: str, v: str) -> str:
        found = f"(SELECT arm, rep, k, a, b, {names}, {v} // b AS l, {v} % b AS r FROM {source})"
        for i in range(ROUNDS):
            own, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
            found = f"(SELECT *, (({other} + 1) * key{i}) & {MASK} AS t FROM {found})"
            found = f"(SELECT * EXCLUDE (t) REPLACE (({own} + ((t * t >> 15) & {MASK})) % {size} AS {own}) FROM {found})"
        return f"SELECT arm, rep, k, l * b + r AS v FROM {found}"

    draws = ", ".join(f"('0x' || substr(md5('{seed}:' || arm || ':' || rep || ':{i}'), 1, 8))::BIGINT & {MASK} | 1 AS key{i}" for i in range(ROUNDS))
    return f"""firsts AS (SELECT arm, max(n)::BIGINT AS n, ceil(sqrt(max(n)))::BIGINT AS s FROM numbered GROUP BY 1),
codes AS (SELECT arm, n, list_min(list_transform(range(s, s + least({WIDTHS}, s + 1)), lambda a: ((n + a - 1) // a * a - n) * {MASK + 1} + a)) % {MASK + 1} AS a FROM firsts),
keyed AS (SELECT arm, rep, n AS size, a, (n + a - 1) // a AS b, {draws} FROM codes, range({reps}) t(rep)),
walk(arm, rep, k, v) AS (
  {all_rounds('numbered JOIN keyed USING (arm)', 'k')}
  UNION ALL {all_rounds('walk JOIN keyed USING (arm, rep) WHERE v >= size', 'v')}
), moved AS (SELECT arm, rep, k, v AS place FROM walk JOIN (SELECT arm, max(n) AS n FROM numbered GROUP BY 1) USING (arm) WHERE v < n)"""
