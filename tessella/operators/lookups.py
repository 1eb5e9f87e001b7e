"""Draws and places that look rows up by their number, worked out where the rows are.

Which row a replicate draws, or where a row goes, is a hash of numbers alone, so neither is sent anywhere: a task holds
a block of an arm's rows, makes the draws (or the places) itself, looks those up that fall into its block and hands on
sums. What is shuffled is the rows, once for each share of the work, whatever the number of replicates. An arm beyond
BLOCK_ROWS has several blocks, and each of them makes the arm's draws anew.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import distribution as ds
from tessella.operators.permutations import MASK, ROUNDS, grid, moved

#: Rows of a block: a task holds one, some 40 bytes a row. Most shares of the work on a block, and numbers that are worked on at once.
BLOCK_ROWS = 1 << 22
MOST_SHARES = 64
STEP = 1 << 13
#: Draws that are made at once, within a core's cache.
DRAWS = 1 << 15

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_UNSIGNED = {n: np.uint32(n) for n in [*_SINES, *range(32)]}
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476


def _sum(*parts: np.ndarray | int) -> np.ndarray | int:
    """Sum modulo 2 ** 32; whole numbers are added up first."""
    out = sum(p for p in parts if isinstance(p, int)) % (1 << 32)
    for p in parts:
        if not isinstance(p, int):
            out = out + p
    return out


def _digest(words: list[np.ndarray | int], state: list[np.ndarray | int], last: bool) -> list[np.ndarray | int]:
    """md5's state after one more block of 16 words, for all lines at once; only its first word after the last block.

    What all lines share are whole numbers. Once four words of the state are arrays of the lines, no new ones are made.
    """
    a, b, c, d = state
    shape = np.broadcast_shapes(*[np.shape(w) for w in [*words, *state]])
    t, u, xor, add = None, None, np.bitwise_xor, np.add
    for i in range(61 if last else 64):  # the first word is what the 61st step makes
        word, turn = words[_WORDS[i]], _TURNS[i // 16][i % 4]
        if t is None:
            if i < 16:
                f = d ^ (b & (c ^ d))
            elif i < 32:
                f = c ^ (d & (b ^ c))
            elif i < 48:
                f = b ^ c ^ d
            else:
                f = c ^ (b | (d ^ 0xFFFFFFFF))
            f = _sum(f, a, word, _SINES[i])
            f = _sum((f << turn) % (1 << 32) | f >> (32 - turn) if isinstance(f, int) else f << turn | f >> (32 - turn), b)
            a, b, c, d = d, f, b, c
            if shape and all(np.shape(x) == shape for x in (a, b, c, d)):
                a, b, c, d = (x.copy() for x in (a, b, c, d))  # overwritten from here on
                t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
            continue
        if i < 32:
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            xor(y, z, t)
            np.bitwise_and(t, x, t)
            xor(t, z, t)
        elif i < 48:
            xor(xor(b, c, t), d, t)
        else:
            np.invert(d, t)
            np.bitwise_or(t, b, t)
            xor(t, c, t)
        add(t, a, t)
        if isinstance(word, int):
            add(t, np.uint32((word + _SINES[i]) % (1 << 32)), t)
        else:
            add(add(t, word, t), _UNSIGNED[_SINES[i]], t)
        np.left_shift(t, _UNSIGNED[turn], u)
        np.right_shift(t, _UNSIGNED[32 - turn], t)
        np.bitwise_or(t, u, t)
        add(t, b, a)
        a, b, c, d = d, a, b, c
    return [_sum(state[0], b)] if last else [_sum(x, y) for x, y in zip(state, (a, b, c, d), strict=True)]


def _hashed(*parts: bytes | tuple[np.ndarray, int]) -> np.ndarray:
    """ranking.hash_draw() of texts of one length, as 32 bits: parts that all share, and numbers with as many digits; shapes are broadcast."""
    whole = b"".join(p if isinstance(p, bytes) else b"0" * p[1] for p in parts)
    size, whole = len(whole), whole + b"\x80"
    whole += b"\0" * (-(len(whole) + 8) % 64) + (8 * size).to_bytes(8, "little")
    words: list = np.frombuffer(whole, "<u4").tolist()
    at = 0
    for part in parts:
        at += len(part) if isinstance(part, bytes) else part[1]
        if isinstance(part, bytes):
            continue
        left = part[0]
        for place in range(at - 1, at - 1 - part[1], -1):
            rest = left // 10
            words[place // 4] = words[place // 4] + ((left - 10 * rest).astype(np.uint32) << np.uint32(8 * (place % 4)))
            left = rest
    state: list = list(_START)
    for block in range(0, len(words), 16):
        state = _digest(words[block : block + 16], state, block + 16 == len(words))
    return state[0].byteswap()


def _by_digits(first: int, upto: int) -> Iterator[tuple[np.ndarray, int]]:
    """(numbers, their digits) from first below upto: as 32 bits where that is enough."""
    while first < upto:
        digits = len(str(first))
        last = min(upto, 10**digits)
        yield np.arange(first, last, dtype=np.uint32 if last <= 1 << 32 else np.int64), digits
        first = last


def hashed(prefix: bytes, first: int, upto: int) -> np.ndarray:
    """ranking.hash_draw() of the prefix followed by each number from first below upto, as 32 bits."""
    return np.concatenate([_hashed(prefix, numbers) for numbers in _by_digits(first, upto)])


def _places(draw: np.ndarray, n: int) -> np.ndarray:
    """draw % n, as places in an array."""
    if n < 1 << 32:
        return (draw - draw // np.uint32(n) * np.uint32(n)).astype(np.intp)
    return draw.astype(np.intp) % n


def _shares(rows: DataFrame, most: int, block_rows: int) -> tuple[int, int]:
    """Into how many shares the work on a block goes, and how many tasks there are; two numbers reach the driver."""
    arms = rows.groupBy("arm").agg(F.max("n").alias("n"))
    blocks = arms.agg(F.sum(F.ceil(F.col("n") / block_rows))).first()[0] or 1
    shares = max(1, min(most, MOST_SHARES, -(-4 * rows.sparkSession.sparkContext.defaultParallelism // blocks)))
    return shares, blocks * shares


def _by_place(rows: pa.Table, column: str, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(values by place in the block, whether there is one): nulls are 0."""
    found = rows[column].combine_chunks()
    value, there = np.zeros(size), np.zeros(size, bool)
    place = np.asarray(rows["k"]) - first
    value[place], there[place] = np.asarray(found.fill_null(0.0)), np.asarray(found.is_valid())
    return value, there


Work = Callable[[str, Iterator[tuple[int, Iterator[np.ndarray]]], pa.Table, int, int], pa.Table]


def drawn(values: DataFrame, columns: list[str], reps: int, seed: str, work: Work, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """work(arm, its replicates with their draws, rows, first number, size) for each block of rows (arm, k from 0, n, columns) and share of the replicates.

    A replicate draws as many rows as the arm has, with replacement. Draws are numbers of rows within the block, and come
    in pieces; a block sees every draw that falls into it.
    """
    shares, tasks = _shares(values, reps, block_rows)

    def run(rows: pa.Table) -> pa.Table:
        arm, n, first, share = rows["arm"][0].as_py(), rows["n"][0].as_py(), rows["_block"][0].as_py() * block_rows, rows["_share"][0].as_py()
        size = min(n, first + block_rows) - first

        def inside(at: np.ndarray) -> np.ndarray:
            return at if size == n else at[(at >= first) & (at < first + size)] - first

        def pieces(rep: int) -> Iterator[np.ndarray]:
            for j in range(0, n, DRAWS):
                yield inside(_places(hashed(f"{seed}:{arm}:{rep}:".encode(), j, min(n, j + DRAWS)), n))

        def replicates() -> Iterator[tuple[int, Iterator[np.ndarray]]]:
            if n > 8 * DRAWS:
                yield from ((rep, pieces(rep)) for rep in range(share, reps, shares))
                return
            for numbers, digits in _by_digits(0, reps):  # several replicates of a smaller arm at once, since few numbers have few digits
                own = numbers[(share - int(numbers[0])) % shares :: shares]
                for low in range(0, len(own), step := max(1, 16 * DRAWS // n)):
                    some = own[low : low + step]
                    at = np.empty((len(some), n), np.intp)
                    for js, size_ in _by_digits(0, n):
                        for i in range(0, len(some), lines := max(1, DRAWS // len(js))):
                            for j in range(0, len(js), DRAWS):
                                made = _hashed(f"{seed}:{arm}:".encode(), (some[i : i + lines, None], digits), b":", (js[None, j : j + DRAWS], size_))
                                at[i : i + lines, int(js[j]) : int(js[j]) + made.shape[1]] = _places(made, n)
                    yield from ((rep, iter((inside(line),))) for rep, line in zip(some.tolist(), at, strict=True))

        return work(arm, replicates(), rows, first, size)

    named = values.filter("arm is not null").select(F.col("arm").cast("string").alias("arm"), "k", "n", *columns)
    dealt = named.withColumn("_block", F.floor(F.col("k") / block_rows)).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.repartition(2 * tasks, "arm", "_block", "_share").groupBy("arm", "_block", "_share").applyInArrow(run, schema)


def drawn_sums(values: DataFrame, column: str, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(arm, rep, n, s): how many values that are not null a replicate draws, and their sum."""

    def work(arm, draws, rows, first, size):
        value, there = _by_place(rows, column, first, size)
        full, out = there.all(), []
        for rep, pieces in draws:
            n, s = 0, 0.0
            for at in pieces:
                n += len(at) if full else int(there[at].sum())
                s += float(value[at].sum())
            out.append((rep, n, s))
        rep, n, s = zip(*out, strict=True)
        return pa.table({"arm": [arm] * len(rep), "rep": rep, "n": n, "s": s})

    return drawn(values, [column], reps, seed, work, "arm string, rep long, n long, s double", block_rows).groupBy("arm", "rep").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def drawn_correlations(values: DataFrame, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(arm, rep, stat): Pearson's correlation over the drawn rows (arm, k, n, x, y) that have both; null where one does not vary."""
    means = F.broadcast(values.groupBy(F.col("arm").alias("_of")).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my")))  # a row for each arm
    moved = values.join(means, F.col("arm").eqNullSafe(F.col("_of"))).select("arm", "k", "n", (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))

    def work(arm, draws, rows, first, size):
        (x, has_x), (y, has_y) = (_by_place(rows, c, first, size) for c in "xy")
        there = (has_x & has_y).astype(float)
        full, out = bool(there.all()), []
        x, y = x * there, y * there
        for rep, pieces in draws:
            sums = np.zeros(6)
            for at in pieces:
                a, b = x[at], y[at]
                sums += (len(at) if full else there[at].sum(), a.sum(), b.sum(), a @ a, b @ b, a @ b)
            out.append((rep, sums))
        return pa.table({"arm": [arm] * len(out), "rep": [rep for rep, _ in out]} | dict(zip(NAMES, np.array([sums for _, sums in out]).T, strict=True)))

    sums = drawn(moved, ["x", "y"], reps, seed, work, "arm string, rep long, " + ", ".join(f"{c} double" for c in NAMES), block_rows)
    return sums.groupBy("arm", "rep").agg(*[F.sum(c).alias(c) for c in NAMES]).select("arm", "rep", correlation().alias("stat"))


#: Sums over the pairs that have both values: their number, and the sums of x, y, xx, yy and xy.
NAMES = ["m", "sx", "sy", "sxx", "syy", "sxy"]


def correlation():
    """Pearson's of the sums NAMES."""
    spread = (F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("m") * F.col("syy") - F.col("sy") * F.col("sy"))
    return F.when(spread > 0, (F.col("m") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread))


def drawn_medians(values: DataFrame, column: str, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(arm, rep, stat): the median of the values that are not null among those a replicate draws.

    It lies near the arm's own median: within sixteen deviations of how many draws lie below a rank, values are counted
    one by one, and below that only how many there are. A replicate whose middle lay elsewhere would be an error, not a
    wrong number.
    """
    known = values.filter(F.col(column).isNotNull())
    found = ds.cumulated(ds.counted(known, ["arm"], column), ["arm"], ["n"])
    half, reach = (F.col("n_all") - 1) / 2, 8 * F.sqrt("n_all") + 8
    near = (F.col("n_below") <= half + reach) & (F.col("n_below") + F.col("n") > half - reach)
    bounds = found.filter(near).groupBy(F.col("arm").alias("_of")).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))  # a row for each arm
    bounded = values.join(F.broadcast(bounds), F.col("arm") == F.col("_of")).select("arm", "k", "n", F.col(column).alias("value"), "_low", "_high")

    def work(arm, draws, rows, first, size):
        value, there = _by_place(rows, "value", first, size)
        low, high = rows["_low"][0].as_py(), rows["_high"][0].as_py()
        codes, code = np.unique(np.where(there & (value >= low) & (value <= high), value, low), return_inverse=True)
        code = np.where(there, np.where(value < low, 0, np.where(value > high, len(codes) + 1, code + 1)), len(codes) + 2)
        out = []
        for rep, pieces in draws:
            times = np.zeros(len(codes) + 3, np.int64)
            for at in pieces:
                times += np.bincount(code[at], minlength=len(times))
            inside = np.flatnonzero(times[1:-2])
            values_ = [None, *codes[inside].tolist(), None]
            out.append(pa.table({"rep": [rep] * len(values_), "value": pa.array(values_, pa.float64()), "times": [int(times[0]), *times[inside + 1].tolist(), int(times[-2])], "below": [True] + [False] * (len(values_) - 1)}))
        made = pa.concat_tables(out)
        return made.add_column(0, "arm", pa.array([arm] * made.num_rows))

    counts = drawn(bounded, ["value", "_low", "_high"], reps, seed, work, "arm string, rep long, value double, times long, below boolean", block_rows)
    counts = counts.groupBy("arm", "rep", "value", "below").agg(F.sum("times").alias("times"))
    of = Window.partitionBy("arm", "rep")  # some sixteen times the root of the arm's rows
    upto = F.sum("times").over(of.orderBy(F.desc("below"), F.asc_nulls_last("value")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("total", F.sum("times").over(of))
    middle = [F.min(F.when(F.col("upto") > at, F.struct("upto", "value", "times"))) for at in (F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))]
    met = placed.filter("times > 0").groupBy("arm", "rep").agg(*[m["value"].alias(c) for m, c in zip(middle, ("_a", "_b"), strict=True)])
    stat = F.col("_a") + (F.col("_b") - F.col("_a")) / 2
    return met.select("arm", "rep", F.when(stat.isNull(), F.raise_error("a replicate's median lies beyond the counted values")).otherwise(stat).alias("stat"))


def permuted_sums(rows: DataFrame, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(arm, rep, NAMES): sums over rows (arm, k from 0, n, x, y) whose ys change places, as permutations.placed() has them.

    A task holds a block of xs by place and a share of the ys, and moves each of those in every replicate.
    """
    shares, tasks = _shares(rows, MOST_SHARES, block_rows)
    blocks = F.ceil(F.col("n") / block_rows)
    named = rows.filter("arm is not null").select(F.col("arm").cast("string").alias("arm"), "k", "n", "x", "y")
    xs = named.select("arm", "k", "n", "x", F.floor(F.col("k") / block_rows).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    ys = named.select("arm", "k", "y", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_block"), F.pmod(F.floor(F.col("k") / STEP), F.lit(shares)).cast("int").alias("_share"))
    ys = ys.toDF("arm", "k", "y", "_block", "_share")  # apart from the rows that they meet again

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"arm": pa.array([], pa.string()), "rep": pa.array([], pa.int64())} | {c: pa.array([], pa.float64()) for c in NAMES})
        arm, n, first = x["arm"][0].as_py(), x["n"][0].as_py(), x["_block"][0].as_py() * block_rows
        size = min(n, first + block_rows) - first
        value, there = _by_place(x, "x", first, size)
        k, given = np.asarray(y["k"]), y["y"].combine_chunks()
        other, has = np.asarray(given.fill_null(0.0)), np.asarray(given.is_valid()).astype(float)
        plain, there = bool(there.all() and has.all()), there.astype(float)
        square = value * value
        wide, high = grid(n)
        keys = [[np.uint64(int(hashlib.md5(f"{seed}:{arm}:{rep}:{i}".encode()).hexdigest()[:8], 16) & MASK | 1) for i in range(ROUNDS)] for rep in range(reps)]
        sums = np.zeros((reps, len(NAMES)))
        for at in range(0, len(k), STEP):
            own, b, h = k[at : at + STEP].astype(np.uint64), other[at : at + STEP], has[at : at + STEP]
            for rep in range(reps):
                place = moved(own, n, wide, high, keys[rep]).astype(np.int64)
                u, v = b, h
                if size < n:
                    inside = (place >= first) & (place < first + size)
                    place, u, v = place[inside] - first, b[inside], h[inside]
                a = value[place]
                if plain:
                    sums[rep] += (len(place), a.sum(), u.sum(), a @ a, u @ u, a @ u)
                else:
                    t = there[place]
                    sums[rep] += (t @ v, a @ v, u @ t, square[place] @ v, (u * u) @ t, a @ u)
        return pa.table({"arm": [arm] * reps, "rep": np.arange(reps)} | dict(zip(NAMES, sums.T, strict=True)))

    keys = ["arm", "_block", "_share"]
    made = xs.repartition(2 * tasks, *keys).groupBy(*keys).cogroup(ys.repartition(2 * tasks, *keys).groupBy(*keys)).applyInArrow(run, "arm string, rep long, " + ", ".join(f"{c} double" for c in NAMES))
    return made.groupBy("arm", "rep").agg(*[F.sum(c).alias(c) for c in NAMES])


def permuted_correlations(rows: DataFrame, reps: int, seed: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(arm, rep, stat): Pearson's correlation of x and the permuted y in each replicate."""
    means = F.broadcast(rows.groupBy(F.col("arm").alias("_of")).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my")))  # a row for each arm
    moved = rows.join(means, F.col("arm") == F.col("_of")).select("arm", "k", "n", (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))
    return permuted_sums(moved, reps, seed, block_rows).select("arm", "rep", correlation().alias("stat"))
