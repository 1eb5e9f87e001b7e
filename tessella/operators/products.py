"""Every row of one table against every row of another, in blocks of a bounded size.

Rows are dealt to blocks by hash. Each pair of blocks meets in one task, which works on whole matrices and hands on a
few rows for each of its own, so no pair of rows is ever shuffled. The work is quadratic by definition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at least: a task holds two blocks, and the matrix of the products of so many rows of each, some tens of MB.
BLOCK_ROWS = 2000
#: Blocks of a table, until a block has MOST_BLOCK_ROWS: every row is sent to every block of the other table, so a fixed number of blocks sends no more than in proportion.
BLOCKS = 16
MOST_BLOCK_ROWS = 32_000


def matrix(rows: pa.Table) -> np.ndarray:
    """The column x, whose arrays have one length."""
    return np.concatenate([c.flatten().to_numpy() for c in rows.column("x").chunks] or [np.zeros(0)]).reshape(rows.num_rows, -1)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Up to rounding, never below 0."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)


def block_pairs(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, combine: Callable[[pa.Table], pa.Table], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """work(left rows, right rows) for all pairs of blocks, by at most block_rows of each side at once; both tables have a column id.

    combine puts together what the same left rows leave with several pieces of a right block, before anything is sent on.

    Blocks that are sent grow with the tables up to a bound; what a task works on at once does not.
    """

    def pieces(rows: pa.Table) -> list[pa.Table]:
        return [rows.slice(at, block_rows) for at in range(0, rows.num_rows, block_rows)] or [rows]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        made = []
        for x in pieces(a):
            found = None
            for y in pieces(b):
                found = work(x, y) if found is None else combine(pa.concat_tables([found, work(x, y)]))
            made.append(found)
        return pa.concat_tables(made)

    return met(left, right, run, schema, *[blocks_of(rows.count(), block_rows) for rows in (left, right)])


def blocks_of(rows: int, least: int, blocks: int = BLOCKS, most: int = MOST_BLOCK_ROWS) -> int:
    """Into how many blocks a table goes: so many, but of at least and at most so many rows."""
    return max(1, -(-rows // max(least, min(most, -(-rows // blocks)))))


def met(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, n_left: int, n_right: int, parts: int | None = None) -> DataFrame:
    """run(left block, right block) for all pairs of blocks of two tables with a column id, in so many partitions if that is given."""

    def dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        home = F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")
        sent = rows.withColumn(own, home).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        return sent.repartition(parts, "_a", "_b") if parts else sent

    a, b = dealt(left, "_a", n_left, "_b", n_right), dealt(right, "_b", n_right, "_a", n_left)
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(run, schema)
