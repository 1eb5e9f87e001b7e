"""Joins with checked keys, provenance and tolerance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.distribution import beside
from tessella.operators.products import BLOCK_ROWS, blocks_of, matrix, met
from tessella.operators.ranking import ranked

#: Pairs whose distances are taken at once; rows that are seen before the first bound, and rows of a product.
STEP = 1 << 18
FIRST, TILE = 512, 2048
#: Blocks of references, until a block has MOST_REFERENCES, some 200 MB with what is made of it: each leaves rows for every query.
FEW_BLOCKS, MOST_REFERENCES = 4, 131_072
#: Rows of a partition where compressed sizes say little of the memory that rows take.
PART_ROWS = 1 << 18


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness: those that stand more than once, or hold a null."""
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter((F.col("n_rows") > 1) | bad)


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], kind: str, how: str = "inner") -> DataFrame:
    """A join after a check of its cardinality: kind is one_to_one, many_to_one or one_to_many."""
    for side, wanted in ((left, kind.startswith("one_to")), (right, kind.endswith("to_one"))):
        if wanted and (bad := repeated_keys(side, keys).first()):
            raise ValueError(f"{kind} join on {keys}: {bad.asDict()}")
    return left.join(right, keys, how)


def with_support(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a column `supported`, true where the right side has the key."""
    return left.join(right.withColumn("_there", F.lit(True)), keys, "left").withColumn("supported", F.coalesce("_there", F.lit(False))).drop("_there")


def with_provenance(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with a column `provenance`: both, left_only or right_only."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    mark = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full_outer").withColumn("provenance", mark).drop("_l", "_r")


def seed_tables(rows: DataFrame, keys: list[str], seed: str, value: str) -> DataFrame:
    """Mean and sample deviation over the seeds of each item, of the items that every seed has."""
    seeds = rows.select(F.countDistinct(seed).alias("_seeds"))
    each = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(seed).alias("_own"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return each.join(F.broadcast(seeds), F.col("_own") == F.col("_seeds")).select(*keys, "n", "mean", "sd")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys both sides have, and their share of the right side's."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    joined = b.join(a.withColumn("_in", F.lit(1)), key, "left")
    return joined.agg(F.count("_in").alias("n_overlap"), F.count("*").alias("n_right"), (100.0 * F.count("_in") / F.count("*")).alias("percent"))


def paired(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Rows (key, target, error) of two tables with one key and targets within the tolerance, and whether the left error is less."""
    other = right.select(key, F.col("target").alias("target_right"), F.col("error").alias("error_right"))
    joined = left.join(other, key).filter(F.abs(F.col("target") - F.col("target_right")) <= tolerance)
    return joined.withColumn("better", F.col("error") < F.col("error_right"))


def _distances(x: np.ndarray, y: np.ndarray, line: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.concatenate([np.sqrt(((x[line[i : i + STEP]] - y[found[i : i + STEP]]) ** 2).sum(axis=1)) for i in range(0, len(line), STEP)] or [np.zeros(0)])


def _first_copies(y: np.ndarray, code: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows, ordered by code, without those of a vector that has smaller codes, so many and different ones."""
    order = np.argsort(code, kind="stable")
    bits = np.ascontiguousarray(y[order]).view(np.uint64)
    mixed = (bits * np.random.default_rng(0).integers(1, 1 << 63, bits.shape[1], np.uint64)).sum(axis=1, dtype=np.uint64)
    _, first, group, times = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    if times.max() <= most or (bits != bits[first[group]]).any():  # rare, or one sum of different vectors
        return order
    by = np.argsort(group, kind="stable")  # a group's rows, by code
    new = np.r_[True, (group[by][1:] != group[by][:-1]) | (code[order][by][1:] != code[order][by][:-1])]
    number = np.cumsum(new)
    start = np.searchsorted(group[by], group[by])
    return order[np.sort(by[number - number[start] < most])]


def nearest_rows(x: np.ndarray, own: np.ndarray, y: np.ndarray, code: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k rows of y with the least (distance, code) for each row of x, in that order, but for those whose code is its own.

    Vectors that are not finite have no neighbours and are none. Products in single precision, with room for their
    rounding, tell which rows may be nearer than the k found so far, which are looked at again whenever the rows seen
    have doubled; the distances themselves decide.
    """
    fine = np.flatnonzero(np.isfinite((x * x).sum(axis=1)))
    other = np.flatnonzero(np.isfinite((y * y).sum(axis=1)))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(fine) or not len(other):
        return none
    other = other[_first_copies(y[other], code[other], k + 1)]
    x, own, y, code = x[fine], own[fine], y[other], code[other]
    centre = y.mean(axis=0)
    u, v = x - centre, y - centre
    square, length = (u * u).sum(axis=1), (v * v).sum(axis=1)
    kind = np.float32 if 1e-20 < max(square.max(), length.max()) < 1e30 else np.float64
    widest = np.sqrt(max((x * x).sum(axis=1).max(), (y * y).sum(axis=1).max()))
    rounding = np.finfo(kind).eps * (np.sqrt(square * length.max()) + length.max())  # of the products
    slack = (x.shape[1] + 8) * (rounding + np.finfo(float).eps * (square + length.max() + widest * np.sqrt(square + length.max())))  # of distances, and of moving the vectors
    left, right = np.column_stack([u, np.ones(len(u))]).astype(kind), np.column_stack([v, -length / 2]).astype(kind)
    made = []
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        rows, mine, a = left[part], own[part], x[part]
        line, found, far = none
        bound, last = np.full(len(rows), np.inf), np.full(len(rows), len(y))
        space, done = np.empty((len(rows), TILE), kind), 0
        while done < len(y):
            upto = min(len(y), max(FIRST, 2 * done))
            if done:
                least = (square[part] - bound * bound * (1 + 1e-9)) / 2 - slack[part]
            else:
                near = rows @ right[:upto].T
                near[mine[:, None] == code[None, :upto]] = -np.inf
                least = np.partition(near, upto - k, axis=1)[:, upto - k] - 2.0 * slack[part] if upto >= k else np.full(len(rows), -np.inf)
            least = np.nextafter(least.astype(kind), kind(-np.inf))[:, None]
            lines, founds, fars, more = [line], [found], [far], 0
            for low in range(done, upto, TILE):
                high = min(upto, low + TILE)
                near = np.matmul(rows, right[low:high].T, out=space[:, : high - low]) if high - low == TILE else rows @ right[low:high].T
                hit, met_ = np.divmod(np.flatnonzero(near >= least), high - low)
                met_ += low
                there = mine[hit] != code[met_]
                hit, met_ = hit[there], met_[there]
                distance = _distances(a, y, hit, met_)
                closer = (distance < bound[hit]) | ((distance == bound[hit]) & (met_ < last[hit]))
                lines, founds, fars, more = [*lines, hit[closer]], [*founds, met_[closer]], [*fars, distance[closer]], more + int(closer.sum())
                if more > STEP or high == upto:
                    line, found, far = (np.concatenate(c) for c in (lines, founds, fars))
                    order = np.lexsort((found, far, line))  # rows of y stand by code
                    line, found, far = line[order], found[order], far[order]
                    place = np.arange(len(line)) - np.searchsorted(line, line)
                    last_one = place == k - 1
                    bound[line[last_one]], last[line[last_one]] = far[last_one], found[last_one]
                    line, found, far = line[place < k], found[place < k], far[place < k]
                    lines, founds, fars, more = [line], [found], [far], 0
            done = upto
        made.append((fine[line + at], other[found], far))
    return tuple(np.concatenate(c) for c in zip(*made, strict=True))


def nearest(queries: DataFrame, references: DataFrame, k: int, own: bool = False, limit: int = BLOCK_ROWS) -> DataFrame:
    """The k references nearest to each query by Euclidean distance: (id, rank, ref_id, distance), ties to the smaller id.

    Exhaustive: every block of queries meets every block of references, and leaves k rows for each query. A block of
    references is as large as a task may hold, so that few rows are left. own: a row may be its own neighbour.
    """
    kinds = [queries.schema["id"].dataType.simpleString(), references.schema["id"].dataType.simpleString()]

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        line, found, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if q.num_rows and r.num_rows:
            _, code = np.unique(np.array(q.column("id").to_pylist() + r.column("id").to_pylist()), return_inverse=True)
            mine = np.full(q.num_rows, -1) if own else code[: q.num_rows]
            line, found, far = nearest_rows(matrix(q), mine, matrix(r), code[q.num_rows :], k, min(limit, 1000))
        return pa.table({"id": q.column("id").take(pa.array(line)), "ref_id": r.column("id").take(pa.array(found)), "distance": pa.array(far)})

    n_left, n_right = blocks_of(queries.count(), limit), blocks_of(references.count(), limit, FEW_BLOCKS, MOST_REFERENCES)
    best = met(queries.select("id", "x"), references.select("id", "x"), run, f"id {kinds[0]}, ref_id {kinds[1]}, distance double", n_left, n_right, 2 * n_left * n_right)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "ref_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "ref_id", "distance")


def compared_groups(rows: DataFrame, group: list[str], side: str, left: str, right: str, item: str, order: list[str]) -> DataFrame:
    """For each group that has both sides: equal, in another order, or of other members.

    Members are compared by their counts, and where these agree the items by their places, which come from ranges of
    the first column of the order, a number; no group is gathered. Rows that tie in the order are ordered by the item.
    Partitions are as many as the rows need.
    """
    two = rows.filter(F.col(side).isin(left, right)).select(*group, side, item, *order)
    first = F.col(side) == left
    parts = -(-two.count() // PART_ROWS) or 1
    counts = two.repartition(parts, *group, item).groupBy(*group, item).agg(F.count_if(first).alias("_l"), F.count_if(~first).alias("_r"))
    members = counts.groupBy(*group).agg(F.sum("_l").alias("_left"), F.sum("_r").alias("_right"), F.bool_and(F.col("_l") == F.col("_r")).alias("_same"))
    placed = ranked(two, [*group, side], order[0], [*order[1:], item], parts=parts)
    at = placed.select(*group, side, item, "_rank").repartition(parts, *group, "_rank").groupBy(*group, "_rank").agg(F.max(F.when(first, F.col(item))).alias("_a"), F.max(F.when(~first, F.col(item))).alias("_b"))
    ordered = at.groupBy(*group).agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("_ordered"))
    verdict = F.when(~F.col("_same"), "members_differ").when(F.col("_ordered"), "equal").otherwise("order_differs")
    return beside(members.filter("_left > 0 and _right > 0"), ordered, group).select(*group, verdict.alias("verdict"))
