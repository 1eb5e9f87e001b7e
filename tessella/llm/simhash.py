"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced.

Fingerprints within the radius of each other are found in two steps. Sixteen tables, each keyed by one of four
16-bit blocks and one of four 12-bit blocks of the rest, bring together every pair within three differing bits
(three differences leave one block of four untouched, twice over). Inside a bucket the fingerprints stand as bit
planes: one 64-bit word holds the same bit of 64 fingerprints, carry-save counters add up the differences of one
fingerprint to all 64 at once, and a block is abandoned as soon as all of its lanes are beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh, settle, slices, table
from tessella.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a bucket that are compared in one group; larger buckets are split into pairs of chunks.
CHUNK = 4096
#: Fingerprints times blocks of 64 lanes that are compared at once.
STEP = 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: a bit is 1 if over half of the shingles' XXH64 values have it."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashed = np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 1 << 16):
        ones += np.unpackbits(hashed[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the fingerprint in the place of the text, which is the second column."""
    for batch in (part for whole in batches for part in slices(whole, 1)):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
        names = [n if i != 1 else "fp" for i, n in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays([c if i != 1 else pa.array(found) for i, c in enumerate(batch.columns)], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, further columns) of every row of (doc_id, text, ...); fp holds the 64 bits as a signed long. Null or wordless text gives 0."""
    rest = ", ".join(f"{n} {k}" for n, k in docs.dtypes[2:])
    return docs.mapInArrow(_fingerprints, "doc_id long, fp long" + (f", {rest}" if rest else ""))


def _bucket_keys():
    """The keys of the sixteen tables, as one array."""
    keys = []
    for i in range(4):
        block = F.expr(f"shiftrightunsigned(fp, {16 * i}) & 65535")
        low = F.expr(f"fp & {(1 << 16 * i) - 1}L") if i else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.expr(f"shiftleft(shiftrightunsigned(fp, {16 * (i + 1)}), {16 * i})")) if i < 3 else low
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(4095).cast("long"))
            keys.append(F.lit((4 * i + j) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def _planes(fps: np.ndarray) -> np.ndarray:
    """planes[k, b]: bit b of the fingerprints 64 k to 64 k + 63, one lane each."""
    n = len(fps)
    full = np.zeros(-(-n // 64) * 64, np.uint64)
    full[:n] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = bits.reshape(-1, 64, 64).transpose(0, 2, 1)
    return np.packbits(np.ascontiguousarray(lanes), axis=2, bitorder="little").view(np.uint64).reshape(-1, 64)


def near_pairs(fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j < ends[i], whose fingerprints differ in at most radius (up to 3) bits; at most 64 STEP at once."""
    planes, n, one = _planes(fps), len(fps), np.uint64(1)
    all_ones = ~np.uint64(0)
    rows = np.arange(n)
    blocks = np.where(ends - 1 > rows, (ends - 1) // 64 - rows // 64 + 1, 0)
    start = 0
    total = np.concatenate([[0], np.cumsum(blocks)])
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + STEP, "right")) - 1)
        i = np.repeat(rows[start:stop], blocks[start:stop])
        k = i // 64 + (np.arange(len(i)) - np.repeat(total[start:stop] - total[start], blocks[start:stop]))
        low, high = np.maximum(i + 1 - 64 * k, 0), np.minimum(ends[i] - 64 * k, 64)  # lanes that are later in the run
        above = np.where(low >= 64, np.uint64(0), all_ones << np.minimum(low, 63).astype(np.uint64))
        below = np.where(high <= 0, np.uint64(0), all_ones >> (64 - np.clip(high, 1, 64)).astype(np.uint64))
        dead = ~(above & below)
        ones, twos = np.zeros_like(dead), np.zeros_like(dead)
        for b in range(64):
            if b % 8 == 0:  # abandon the blocks of which no lane is left
                alive = dead != all_ones
                i, k, dead, ones, twos = i[alive], k[alive], dead[alive], ones[alive], twos[alive]
                if not len(i):
                    break
            differs = planes[k, b] ^ (np.uint64(0) - ((fps[i] >> np.uint64(b)) & one))
            carry = ones & differs
            ones ^= differs
            dead |= twos & carry
            twos ^= carry
        if len(i):
            if radius < 3:  # the counters hold up to three
                dead |= {0: ones | twos, 1: twos, 2: ones & twos}[radius]
            lanes = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            yield i[at], 64 * k[at] + lane
        start = stop


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each index reaches over the pairs, which are taken in as they come and not kept."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            least = np.minimum(a, b)
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            while (root != root[root]).any():
                root = root[root]
    return root


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by group; links each fingerprint to the first of those it reaches within its group."""

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        first = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
        ends = np.r_[np.flatnonzero(first)[1:], len(keys)][np.cumsum(first) - 1]
        root = _roots(len(fps), near_pairs(fps.view(np.uint64), ends))
        at = np.flatnonzero((root != np.arange(len(fps))) & (fps != fps[root]))
        edges = np.unique(np.stack([fps[at], fps[root[at]]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    keys, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)])
        fps = np.concatenate([fps, batch.column(3).to_numpy()])
        if len(fps) >= 1 << 18:  # all but the last group, which the next batch may go on with
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield linked(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
    if len(fps):
        yield linked(keys, fps)


def links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within the radius of each other (stars, not all pairs).

    A bucket beyond chunk fingerprints is dealt out as pairs of chunks, so no task holds more than two chunks of it.
    """
    rows = fps.select("fp", F.explode(_bucket_keys()).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = rows.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), "fp")
    grouped = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return grouped.mapInArrow(_links, "a long, b long")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, further columns) of the rows (doc_id, text, ...), and (fp, root): root is the least fingerprint that fp reaches."""
    marked = settle(fingerprints(docs))
    fps = settle(marked.select("fp").distinct())
    roots = components(links(fps), "a", "b")
    return marked, fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs, by the contract of op3.

    Null or wordless text has fingerprint zero and links like any other; equal fingerprints are one class, so
    copies are never paired; repeated rows give repeated rows; a null doc_id keeps its row but names no component.
    A bit that just half of the shingles set is not set; a component is named by its smallest id, so ties need no rule.
    Long texts are fingerprinted whole, some MB of texts at once. An empty table gives an empty result, and further
    columns are ignored.
    """
    marked, rooted = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = rooted.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (null last), ties to the text's hash.

    Rows that repeat a doc_id are told apart by their texts; of rows that repeat both one stays. Null and wordless texts
    are one group. Long texts are fingerprinted whole; an empty table stays empty; further columns of any name are kept,
    and of repeated rows that differ in them any may stay.
    """
    key, mark, drop = fresh(docs, "key", "mark", "drop")
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked, rooted = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), own.alias("mark")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    least = rooted.join(marked.groupBy("fp").agg(F.min(place).alias("least")), "fp")  # combined before the shuffle: copies share fp
    first = least.groupBy("root").agg(F.min("least").alias("first"))
    rows = marked.join(least.join(first, "root").select("fp", "first"), "fp")
    later = rows.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))))
    gone = later.select(name.alias(key), F.col("mark").alias(mark)).distinct()
    left = docs.withColumns({key: name, mark: own}).join(gone, [key, mark], "left_anti")
    again = F.row_number().over(Window.partitionBy(key, mark).orderBy(key, mark))  # in the order that the join leaves
    return left.withColumn(drop, again).filter(F.col(drop) == 1).select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
