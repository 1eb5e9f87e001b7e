"""Blocks of documents, and which keys of theirs stand more than once in the corpus.

Documents are dealt by hash to blocks of a few MB, so a task works on whole blocks with numpy. A block sends every key it
has only once, whatever the number of its copies, to the part of the corpus's keys that it falls in; the part answers
which of them are repeated. Neither a hot key nor a hot group of copies gathers anywhere: a part sees a key at most once
from each block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block; a task holds some 60 to 100 times as many for each block that it works on.
BLOCK_BYTES = 2 << 20
#: The keys of so many blocks make a part, which a task sorts: some MB.
BLOCKS_A_PART = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NO_ID = np.iinfo(np.int64).max

KEYS = "part int, block int, keys binary, many binary"
HITS = "block int, keys binary"


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """((block, doc_id, text) of every row of docs, the number of blocks); a null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return rows.select(block.alias("block"), "doc_id", F.col("text").cast("binary").alias("text")), blocks


def documents_of(block: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """The ids and texts of a block, in an order that depends on nothing but themselves."""
    rows = sorted(zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


class Rolling:
    """Hashes of all stretches of a sequence of 64-bit values: sums of the values times powers of an odd base, modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers = np.full(n + 1, _BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers[:n], out=self.sums[1:])
        self.back = np.full(n + 1, _INVERSE)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def __call__(self, start: np.ndarray | slice, length: int | np.ndarray) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        """The hash of the stretch of this length at every place that has one."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The values with their bits mixed, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where, among the width values (below 2**32) from each place on, the least stands; the first of several."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, reach = values.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64), 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return (np.minimum(low[:n], low[width - reach : width - reach + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def window_starts(lengths: np.ndarray, window: int) -> np.ndarray:
    """The places, in the texts set end to end, where a window of one text begins."""
    ends = np.cumsum(lengths)
    n = np.maximum(lengths - window + 1, 0)
    return np.repeat(ends - lengths - (np.cumsum(n) - n), n) + np.arange(n.sum())


def runs(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, last) of the runs of a sorted array."""
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else np.zeros(0, np.int64)
    return [(int(part[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def each(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + n - 1 for each of the pairs, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _all_equal(values: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
    """Whether the stretches at a and b hold the same values; bytes are compared eight at once."""
    step = 1
    if values.dtype == np.uint8 and length.min(initial=8) >= 8:
        step, n = 8, len(values)
        raw, values = np.concatenate([values, np.zeros(8, np.uint8)]), np.empty(n, np.uint64)
        for o in range(min(8, n)):
            values[o::8] = raw[o : o + (n - o + 7) // 8 * 8].view(np.uint64)
    n = -(-length // step)
    at = np.minimum(each(np.zeros(len(n), np.int64), n) * step, np.repeat(length - step, n))  # the last eight end with the stretch
    return bool((values[np.repeat(a, n) + at] == values[np.repeat(b, n) + at]).all())


def equal_stretches(values: np.ndarray, start: np.ndarray, length: np.ndarray, offset: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stands, same): the first of the stretches that hold the same values at the same offset, and for each stretch the place in stands of its own.

    Hashes bring equal ones together; the values decide, and where they belie a hash all are told apart by value.
    """
    _, stands, same = np.unique(hashes, return_index=True, return_inverse=True)
    first = stands[same]
    rest = np.flatnonzero(first != np.arange(len(start)))
    fits = (length[rest] == length[first[rest]]) & (offset[rest] == offset[first[rest]])
    if fits.all() and _all_equal(values, start[rest], start[first[rest]], length[rest]):
        return stands, same
    number: dict[tuple[int, bytes], int] = {}
    own = [number.setdefault((o, values[a : a + m].tobytes()), len(number)) for a, m, o in zip(start.tolist(), length.tolist(), offset.tolist(), strict=True)]
    _, stands, same = np.unique(np.array(own, np.int64), return_index=True, return_inverse=True)
    return stands, same


class Windows:
    """The windows of a block's documents, set end to end as values: for each its place and that of its seed."""

    def __init__(self, values: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, window: int, gram: int):
        self.values, self.lengths, self.window = values, lengths, window
        self.rolling = Rolling(hashes)
        self.grams = self.rolling.all(gram)
        self.starts = window_starts(lengths, window)
        self.seeds = least_places(self.grams >> np.uint64(32), window - gram + 1)[self.starts]
        self.heads = np.flatnonzero(np.r_[True, self.seeds[1:] != self.seeds[:-1]][: len(self.seeds)])  # seeds rise, so each stands in one run of windows

    def seed_keys(self) -> np.ndarray:
        return self.grams[self.seeds[self.heads]]

    def stretches(self, hits: np.ndarray, parts: int) -> dict[str, np.ndarray]:
        """The stretches of windows around the seeds in hits: start, n windows, seed; stands: the stretches that stand for
        equal ones, by part; same: the place in stands of each stretch's own; part: of each in stands."""
        keep = among(self.grams[self.seeds[self.heads]], hits)
        n = np.diff(np.r_[self.heads, len(self.seeds)])[keep]
        start, seed = self.starts[self.heads[keep]], self.seeds[self.heads[keep]]
        length = n + self.window - 1
        hashes = mixed(self.rolling(start, length) + n.astype(np.uint64)) + (seed - start).astype(np.uint64)
        stands, same = equal_stretches(self.values, start, length, seed - start, hashes)
        part = (mixed(self.grams[seed[stands]]) % np.uint64(parts)).astype(np.int64)
        sort = np.lexsort((stands, part))
        place = np.empty(len(sort), np.int64)
        place[sort] = np.arange(len(sort))
        return {"start": start, "n": n, "seed": seed, "same": place[same], "stands": stands[sort], "part": part[sort]}

    def marked(self, s: dict[str, np.ndarray], masks: dict[int, bytes], also: np.ndarray | None = None) -> np.ndarray:
        """Which values are covered by a window that the parts' masks mark; also: stretches all of whose windows count."""
        n, at = s["n"], s["stands"]
        bits = np.zeros(int(n[at].sum()), bool)
        begins = np.cumsum(n[at]) - n[at]
        for p, first, last in runs(s["part"]):
            size = int(n[at[first:last]].sum())
            bits[begins[first] : begins[first] + size] = np.unpackbits(np.frombuffer(zstandard.decompress(masks[p]), np.uint8), count=size)
        gone = bits[each(begins[s["same"]], n)]
        if also is not None:
            gone |= np.repeat(also, n)
        starts = each(s["start"], n)[gone]
        edge = np.zeros(len(self.values) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def packed(bits: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(bits).tobytes(), 3)


def key_parts(blocks: int) -> int:
    """In how many parts the keys of so many blocks are compared."""
    return -(-blocks // BLOCKS_A_PART)


def keys_table(block: int, keys: np.ndarray, parts: int) -> pa.Table:
    """The rows that a block sends: for each part its keys, once each, and which stand in the block more than once."""
    keys, n = np.unique(keys, return_counts=True)
    part = (mixed(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keys, many, part = keys[order], (n[order] > 1), part[order]
    ends = np.searchsorted(part, np.arange(parts), "right")
    begins = np.r_[0, ends[:-1]]
    own = np.flatnonzero(ends > begins)
    return pa.table(
        {
            "part": pa.array(own, pa.int32()),
            "block": pa.array(np.full(len(own), block), pa.int32()),
            "keys": pa.array([keys[begins[p] : ends[p]].tobytes() for p in own], pa.binary()),
            "many": pa.array([np.packbits(many[begins[p] : ends[p]]).tobytes() for p in own], pa.binary()),
        }
    )


def _repeated(rows: pa.Table) -> pa.Table:
    keys = [np.frombuffer(k, np.uint64) for k in rows.column("keys").to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for k, m in zip(keys, rows.column("many").to_pylist(), strict=True)]
    every = np.concatenate(keys)
    order = np.argsort(every)
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(every), bool)
    hit[order] = np.r_[False, same] | np.r_[same, False]
    alone = np.concatenate(many)
    hit |= np.isin(every, every[alone]) if alone.any() else False
    ends = np.cumsum([len(k) for k in keys])
    answers = [every[e - len(k) : e][hit[e - len(k) : e]] for k, e in zip(keys, ends, strict=True)]
    kept = [i for i, a in enumerate(answers) if len(a)]
    return pa.table({"block": rows.column("block").take(pa.array(kept, pa.int64())), "keys": pa.array([answers[i].tobytes() for i in kept], pa.binary())})


def repeated(sent: DataFrame) -> DataFrame:
    """(block, keys): of the rows of keys_table() the keys that stand more than once, sent back to each block that has them."""
    return sent.groupBy("part").applyInArrow(_repeated, HITS)


def hits_of(answers: pa.Table) -> np.ndarray:
    """The sorted keys of the answers that a block got."""
    return np.sort(np.concatenate([np.frombuffer(k, np.uint64) for k in answers.column("keys").to_pylist()] + [np.zeros(0, np.uint64)]))


def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the keys are in the sorted array."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def by_block(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return rows.groupBy("block").applyInArrow(work, schema)


def with_answers(rows: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(block, its answers) for every block of rows; the rows' shuffle is the one of by_block()."""
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)
