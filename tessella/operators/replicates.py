"""Bootstrap by multiplicities: how often each replicate draws a row, instead of the drawn rows.

The rows of an arm lie in two to some power of blocks. How many of a replicate's draws fall into a block follows from
the blocks' sizes alone: from the root of a binary tree over the blocks the draws are parted by binomial variates, and
every node's variates come from a hash of its place, so each block finds its own draws, and those before it, without
hearing from the others. Within a block the draws are dealt to the rows, replicates are products of the matrix of
multiplicities with the rows' values, and blocks' sums are added up. No row is repeated, and no arm stands in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import distribution as ds
from tessella.operators.products import matrix, squared_distances

#: Rows of a block, about, and cells of a matrix of multiplicities that is held at once.
BLOCK_ROWS = 4096
CELLS = 1 << 18
#: From so many rows a block that repeats none looks its multiplicities up, so many cells at once: what stays in a core's caches.
TABLED_ROWS = 1024
TABLED_CELLS = 1 << 16
#: Most halvings of an arm, and most partitions that the blocks are dealt to.
MOST_LEVELS = 12
MOST_PARTS = 10_000


class Blocks(NamedTuple):
    """Rows (arm, block, n, ...), how often an arm is halved into blocks, and the partitions that the blocks are dealt to: few bytes make much work here."""

    rows: DataFrame
    levels: int
    parts: int


def _generator(*place) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, place)).encode()).digest()[:16], "big"))


class Draws:
    """The draws that replicates make from one block of an arm."""

    def __init__(self, seed: str, arm: str, block: int, path: list[dict], weights: np.ndarray, reps: int):
        """path: from the root down, the weight of each node on the way and of its left child."""
        self.place, self.weights, self.reps = (seed, arm, block), weights, reps
        self.total = sum(p["whole"] for p in path[:1]) or int(weights.sum())  # of the arm
        self.own, self.below = np.full(reps, self.total), np.zeros(reps, np.int64)
        for level, node in enumerate(path):
            down = len(path) - level
            left = _generator(seed, arm, level, block >> down).binomial(self.own, node["left"] / max(1, node["whole"]))
            if block >> (down - 1) & 1:
                self.below, self.own = self.below + left, self.own - left
            else:
                self.own = left

    def chunks(self, wanted: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray]]:
        """(replicates, multiplicities of the rows in each); only the chunks that hold a wanted replicate. A matrix holds until the next is asked for."""
        items = len(self.weights)
        step, upto = max(1, CELLS // items), np.cumsum(self.weights)
        tabled = _Tabled(items) if items == upto[-1] and items >= TABLED_ROWS else None
        for low in range(0, self.reps, step):
            own = self.own[low : low + step]
            if wanted is not None and not wanted[low : low + step].any():
                continue
            rng = _generator(*self.place, "rows", low)
            if tabled:
                for at, times in tabled.drawn(rng, own):
                    at = slice(low + at.start, low + at.stop)
                    if wanted is None or wanted[at].any():
                        yield at, times
            elif upto[-1] > 2 * items:  # a common value stands for many rows
                yield slice(low, low + len(own)), rng.multinomial(own, self.weights / upto[-1])
            else:
                row = rng.integers(0, upto[-1], int(own.sum()))
                row = row if upto[-1] == items else np.searchsorted(upto, row, "right")
                yield slice(low, low + len(own)), np.bincount(np.repeat(np.arange(len(own)) * items, own) + row, minlength=len(own) * items).reshape(len(own), items)


class _Tabled:
    """Multiplicities of rows of equal chance, most of them from a table.

    Poisson variates of one mean are, given their sum, the multiplicities of as many draws. So every row takes a variate
    of a mean that leaves the sum a little short of the draws, and the rest is drawn row by row; where the sum is above
    the draws, all of them are. A variate is what a table says of 16 random bits, and where these do not decide, more bits do.
    """

    def __init__(self, items: int):
        mean = 1 - 2.5 * np.sqrt(2 / items)  # the draws of a block vary as the sum does
        k = np.arange(1, 64)
        self.items, self.steps = items, np.cumsum(np.exp(-mean) * np.r_[1.0, np.cumprod(mean / k)])
        self.table = np.searchsorted(self.steps, np.arange(1 << 16) / (1 << 16), "right").astype(np.int8)
        self.table[np.minimum((self.steps * (1 << 16)).astype(np.int64), (1 << 16) - 1)] = -1
        self.rows = max(1, TABLED_CELLS // items)
        self.counts, self.times = np.empty(self.rows * items, np.int8), np.empty((self.rows, items))

    def drawn(self, rng: np.random.Generator, own: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(replicates, multiplicities) for replicates of own draws each; a matrix is overwritten by the next."""
        for low in range(0, len(own), self.rows):
            draws = own[low : low + self.rows]
            times = self.times[: len(draws)]
            words = rng.integers(0, 1 << 64, -(-times.size // 4), np.uint64).view(np.uint16)[: times.size]
            counts = self.table.take(words, out=self.counts[: times.size], mode="clip")
            open_ = np.flatnonzero(counts < 0)
            counts[open_] = np.searchsorted(self.steps, (words[open_] + rng.random(len(open_))) / (1 << 16), "right")
            np.copyto(times, counts.reshape(times.shape))
            rest = draws - times.sum(axis=1).astype(np.int64)
            times[rest < 0] = 0
            rest = np.where(rest < 0, draws, rest)
            np.add.at(times.ravel(), np.repeat(np.arange(len(draws)) * self.items, rest) + rng.integers(0, self.items, int(rest.sum())), 1.0)
            yield slice(low, low + len(draws)), times


def _shape(counts: DataFrame, block_rows: int) -> tuple[int, int]:
    """Halvings and partitions for arms of so many rows each (column count): three numbers reach the driver."""
    largest, total, arms = counts.agg(F.max("count"), F.sum("count"), F.count("*")).first()
    levels = min(MOST_LEVELS, max(0, ((largest or 0) - 1).bit_length() - (block_rows - 1).bit_length()))
    return levels, max(1, min(MOST_PARTS, 2 * (-(-(total or 0) // block_rows) + arms)))


def _paths(found: DataFrame, levels: int) -> DataFrame:
    """(arm, block, path) of the blocks that have rows, of rows (arm, block, n)."""
    sizes = found.groupBy("arm", "block").agg(F.sum("n").alias("n"))
    if not levels:
        return sizes.select("arm", "block", F.expr("cast(array() as array<struct<whole:bigint,left:bigint>>)").alias("path")).toDF("arm", "block", "path")
    each = sizes.select("arm", "block", "n", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    child = F.call_function("shiftright", F.col("block"), F.lit(levels - 1) - F.col("level"))
    placed = each.withColumn("right", child % 2).withColumn("node", F.floor(child / 2))
    node = Window.partitionBy("arm", "level", "node")  # a row for each block
    whole = placed.select("arm", "block", "level", F.sum("n").over(node).alias("whole"), F.coalesce(F.sum(F.when(F.col("right") == 0, F.col("n"))).over(node), F.lit(0)).alias("left"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("level", "whole", "left"))), lambda p: F.struct(p["whole"].alias("whole"), p["left"].alias("left")))
    return whole.groupBy("arm", "block").agg(path.alias("path")).toDF("arm", "block", "path")  # apart from the rows that they meet again


def _arm(keys: Column | str) -> Column:
    return F.coalesce((F.col(keys) if isinstance(keys, str) else keys).cast("string"), F.lit(""))


def value_blocks(rows: DataFrame, arm: str, value: str, block_rows: int = BLOCK_ROWS) -> Blocks:
    """Rows (arm, value, n, block) of the distinct values that are not null, blocks rising with the value."""
    counts = rows.select(_arm(arm).alias("arm"), F.col(value).cast("double").alias("value")).filter("value is not null").groupBy("arm", "value").agg(F.count("*").alias("n"))
    levels, parts = _shape(counts.groupBy("arm").count(), block_rows)
    return Blocks(ds.cumulated(counts, ["arm"], ["n"], levels).select("arm", "value", "n", F.col("range").alias("block")), levels, parts)


def row_blocks(rows: DataFrame, arm: str, item: str, columns: list[str], block_rows: int = BLOCK_ROWS) -> Blocks:
    """Rows (arm, item, columns, n = 1, block), dealt to blocks by a hash of the item."""
    known = rows.select(_arm(arm).alias("arm"), F.col(item).alias("item"), *columns, F.lit(1).cast("long").alias("n"))
    levels, parts = _shape(known.groupBy("arm").count(), block_rows)
    return Blocks(known.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(1 << levels)).cast("int")), levels, parts)


def _met(blocks: Blocks, others: DataFrame):
    """The blocks' rows beside the rows (arm, block, ...) of others."""
    keys = ["arm", "block"]
    return blocks.rows.repartition(blocks.parts, *keys).groupBy(*keys).cogroup(others.repartition(blocks.parts, *keys).groupBy(*keys))


def _worked(blocks: Blocks, order: str, reps: int, seed: str, work: Callable[[Draws, pa.Table], Iterator[pa.Table]], schema: str) -> DataFrame:
    """work(draws, rows in order) for every block."""

    def run(rows: pa.Table, paths: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        draws = Draws(seed, rows["arm"][0].as_py(), rows["block"][0].as_py(), paths["path"][0].as_py(), np.asarray(rows["n"]), reps)
        made = list(work(draws, rows))
        return pa.concat_tables(made) if made else pa.table({c.split()[0]: pa.array([], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")})

    return _met(blocks, _paths(blocks.rows, blocks.levels)).applyInArrow(run, schema)


def multiplicities(blocks: Blocks, order: str, reps: int, seed: str) -> DataFrame:
    """(arm, rep, block, place, times): how often a replicate draws the row in a place of a block, if it does. For looking at; one row for each draw, about."""

    def work(draws: Draws, rows: pa.Table) -> Iterator[pa.Table]:
        for reps_, times in draws.chunks():
            rep, place = np.nonzero(times)
            yield pa.table({"arm": [draws.place[1]] * len(rep), "rep": rep + reps_.start, "block": np.full(len(rep), draws.place[2]), "place": place, "times": times[rep, place].astype(np.int64)})

    return _worked(blocks, order, reps, seed, work, "arm string, rep long, block long, place long, times long")


def replicate_sums(blocks: Blocks, order: str, columns: list[str], reps: int, seed: str) -> DataFrame:
    """(arm, rep, n, columns): the sums of columns over the draws of each replicate."""
    names = ["n", *columns]

    def work(draws: Draws, rows: pa.Table) -> Iterator[pa.Table]:
        values = np.column_stack([np.asarray(rows[c], np.float64) for c in columns])
        sums = np.empty((draws.reps, len(columns)))
        for reps_, times in draws.chunks():
            sums[reps_] = times.astype(np.float64, copy=False) @ values
        yield pa.table({"arm": [draws.place[1]] * draws.reps, "rep": np.arange(draws.reps), "n": draws.own} | {c: sums[:, i] for i, c in enumerate(columns)})

    made = _worked(blocks, order, reps, seed, work, ", ".join(["arm string, rep long, n long", *[f"{c} double" for c in columns]]))
    return made.groupBy("arm", "rep").agg(*[F.sum(c).alias(c) for c in names])  # within a task before the shuffle


def replicate_means(rows: DataFrame, arm: str, value: str, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(arm, rep, n, stat): means of bootstrap replicates of each arm. Nulls stay out; a null arm is the empty one."""
    return replicate_sums(value_blocks(rows, arm, value, block_rows), "value", ["value"], reps, seed).select("arm", "rep", "n", (F.col("value") / F.col("n")).alias("stat"))


def replicate_medians(rows: DataFrame, arm: str, value: str, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(arm, rep, stat): medians of bootstrap replicates. Blocks rise with the value, so a replicate's middle draws lie in one or two, and only there rows are counted."""
    blocks = value_blocks(rows, arm, value, block_rows)

    def work(draws: Draws, rows: pa.Table) -> Iterator[pa.Table]:
        value = np.asarray(rows["value"])
        for at in ((draws.total - 1) // 2, draws.total // 2):
            wanted = (draws.below <= at) & (at < draws.below + draws.own)
            for reps_, times in draws.chunks(wanted):
                rep = np.flatnonzero(wanted[reps_])
                place = (np.cumsum(times[rep], axis=1) <= (at - draws.below[reps_][rep])[:, None]).sum(axis=1)
                yield pa.table({"arm": [draws.place[1]] * len(rep), "rep": rep + reps_.start, "value": value[place]})

    return _worked(blocks, "value", reps, seed, work, "arm string, rep long, value double").groupBy("arm", "rep").agg(F.avg("value").alias("stat"))


def replicate_correlations(rows: DataFrame, arm: str, item: str, x: str, y: str, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(arm, rep, stat): Pearson's correlation of bootstrap replicates of the rows that have both values; null where one does not vary.

    Values are taken less the arm's means, so that sums of squares keep their places. For Spearman's, give ranks.
    """
    both = rows.select(_arm(arm).alias("_arm"), F.col(item).alias("_item"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    means = both.groupBy("_arm").agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    a, b = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    moved = both.join(means, "_arm").select("_arm", "_item", a.alias("a"), b.alias("b"), (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab"))
    names = ["a", "b", "aa", "bb", "ab"]
    sums = replicate_sums(row_blocks(moved, "_arm", "_item", names, block_rows), "item", names, reps, seed)
    spread = (F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b"))
    return sums.select("arm", "rep", F.when(spread > 0, (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(spread)).alias("stat"))


def replicate_areas(rows: DataFrame, score: str, label: str, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(rep, stat): the area under the curve of replicates drawn within each class (label 1 and others); no rows where a class is missing.

    Blocks rise with the score and hold both classes; a block knows how many draws of the other class lie below it.
    """
    both = rows.select(F.when(F.col(label) == 1, "1").otherwise("0").alias("side"), F.col(score).cast("double").alias("value")).filter("value is not null")
    counts = both.groupBy("value").agg(F.count("*").alias("all"), F.count_if(F.col("side") == "1").alias("pos"), F.count_if(F.col("side") == "0").alias("neg"))
    levels, parts = _shape(counts.agg(F.count("*").alias("count")), block_rows)
    placed = ds.cumulated(counts.withColumn("one", F.lit(0)), ["one"], ["all"], levels).select("value", "pos", "neg", F.col("range").alias("block"))
    sides = placed.select(F.lit("pos").alias("arm"), "block", F.col("pos").alias("n")).unionByName(placed.select(F.lit("neg"), "block", F.col("neg").alias("n")).toDF("arm", "block", "n"))
    paths = _paths(sides.groupBy("arm", "block").agg(F.sum("n").alias("n")), levels)

    def run(rows: pa.Table, paths: pa.Table) -> pa.Table:
        rows = rows.sort_by("value")
        path = dict(zip(paths["arm"].to_pylist(), paths["path"].to_pylist(), strict=True))
        one = {a: (path[a] or [{"whole": int(np.sum(np.asarray(rows[a])))}]) for a in path}
        if any(p[0]["whole"] == 0 for p in one.values()):
            return pa.table({"rep": pa.array([], pa.int64()), "stat": pa.array([], pa.float64())})
        pos, neg = (_Side(seed, a, rows["block"][0].as_py(), path[a], np.asarray(rows[a]), reps) for a in ("pos", "neg"))
        stat = np.zeros(reps)
        for low in range(0, reps, step := max(1, CELLS // rows.num_rows)):
            at = slice(low, min(reps, low + step))
            p, n = pos.times(at), neg.times(at)
            stat[at] = (p * (neg.below[at, None] + np.cumsum(n, axis=1) - n / 2)).sum(axis=1)
        return pa.table({"rep": np.arange(reps), "stat": stat / (float(pos.total) * neg.total)})

    made = placed.repartition(parts, "block").groupBy("block").cogroup(paths.repartition(parts, "block").groupBy("block")).applyInArrow(run, "rep long, stat double")
    return made.groupBy("rep").agg(F.sum("stat").alias("stat"))


class _Side(Draws):
    """One class of a block, whose rows may also be none."""

    def times(self, at: slice) -> np.ndarray:
        own, items = self.own[at], len(self.weights)
        if not self.weights.sum():
            return np.zeros((len(own), items), np.int64)
        return _generator(*self.place, "rows", at.start).multinomial(own, self.weights / self.weights.sum())


def replicate_davies_bouldin(rows: DataFrame, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(rep, stat): the Davies-Bouldin index of replicates drawn within each family, of rows (id, family, x).

    Two passes with the same multiplicities: sums by family and replicate give its centroids, and the mean distances to
    them its spreads. The centroids of all replicates go to every block of the family: a vector for each replicate. A
    replicate two of whose centroids meet is left out, as is a single family.
    """
    blocks = row_blocks(rows, "family", "id", ["x"], block_rows)
    paths = _paths(blocks.rows, blocks.levels)

    def draws_of(own: pa.Table, paths: pa.Table) -> tuple[Draws, pa.Table]:
        own = own.sort_by("item")
        return Draws(seed, own["arm"][0].as_py(), own["block"][0].as_py(), paths["path"][0].as_py(), np.asarray(own["n"]), reps), own

    def first(own: pa.Table, paths: pa.Table) -> pa.Table:
        draws, own = draws_of(own, paths)
        x = matrix(own)
        sums = np.empty((reps, x.shape[1]))
        for at, times in draws.chunks():
            sums[at] = times.astype(np.float64, copy=False) @ x
        dims = np.tile(np.arange(x.shape[1]), reps)
        return pa.table({"arm": [draws.place[1]] * len(dims), "rep": np.repeat(np.arange(reps), x.shape[1]), "dim": dims, "v": sums.ravel(), "n": np.repeat(draws.own, x.shape[1])})

    sums = _met(blocks, paths).applyInArrow(first, "arm string, rep long, dim long, v double, n long").groupBy("arm", "rep", "dim").agg((F.sum("v") / F.sum("n")).alias("v"))
    centres = sums.groupBy("arm", "rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda p: p["v"]).alias("x"))
    listed = centres.groupBy("arm").agg(F.array_sort(F.collect_list(F.struct("rep", "x"))).alias("centres"))  # a vector for each replicate
    known = paths.join(listed, "arm")

    def second(own: pa.Table, paths: pa.Table) -> pa.Table:
        draws, own = draws_of(own, paths)
        x, centre = matrix(own), np.array([c["x"] for c in paths["centres"][0].as_py()])
        spread = np.empty(reps)
        for at, times in draws.chunks():
            spread[at] = (times * np.sqrt(squared_distances(centre[at], x))).sum(axis=1)
        return pa.table({"arm": [draws.place[1]] * reps, "rep": np.arange(reps), "s": spread, "n": draws.own})

    spreads = _met(blocks, known).applyInArrow(second, "arm string, rep long, s double, n long").groupBy("arm", "rep").agg((F.sum("s") / F.sum("n")).alias("s"))
    one = centres.join(spreads, ["arm", "rep"])
    other = one.select("rep", F.col("arm").alias("arm2"), F.col("x").alias("x2"), F.col("s").alias("s2"))
    apart = F.sqrt(F.aggregate(F.zip_with("x", "x2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    ratios = one.join(other, "rep").filter(F.col("arm") != F.col("arm2")).select("rep", "arm", F.when(apart > 0, (F.col("s") + F.col("s2")) / apart).alias("r"))
    worst = ratios.groupBy("rep", "arm").agg(F.max("r").alias("r"), F.count_if(F.col("r").isNull()).alias("met"))
    return worst.groupBy("rep").agg(F.avg("r").alias("stat"), F.sum("met").alias("met")).filter("met = 0").select("rep", "stat")
