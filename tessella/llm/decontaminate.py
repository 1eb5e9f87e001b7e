"""Benchmark decontamination by spaced seeds.

A mask names the words of a stretch that count and those that may differ. The hashes of all masked stretches of the
benchmark form the test side; a document's stretches are looked up there, and each hit lays an item against the document
along one diagonal. On that diagonal the longest overlap that tolerates substitutions decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import slices, table

#: Words of a stretch that must agree (1) and that may differ (0).
MASKS = ("11101011", "1101100111", "11001010111", "111111", "1110011011")
#: An overlap counts from so many words, or from the whole item if it has fewer, and from this share of equal words.
MIN_WORDS = 13
MIN_SAME = 0.8
#: Words of benchmark text that are sent to the executors at once; a larger benchmark is worked off in parts.
PART_WORDS = 2_000_000



def _short_masks(n: int) -> list[str]:
    """Masks of which one agrees wherever an item of n words stands whole: its ends, and one more piece between them than words may differ."""
    pieces = n - math.ceil(MIN_SAME * n - 1e-9) + 1
    inner = max(0, n - 2)
    return ["".join("1" if i in (0, n - 1) or (i - 1) * pieces // inner == p else "0" for i in range(n)) for p in range(pieces)]


#: The masks, and the number of words of the items that each is for; None: items of MIN_WORDS and more.
SEEDS = [(m, None) for m in MASKS] + [(m, n) for n in range(1, MIN_WORDS) for m in _short_masks(n)]

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or b in _KEEP else 0x20 for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Places in items that are laid against a document's at once; those on one diagonal count once.
_HITS = 1 << 20
_GAP = max(len(m) for m, _ in SEEDS)


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; bytes beyond ASCII count as letters."""
    return text.translate(_WORDS).split() if text else []


@dataclass
class Index:
    vocabulary: dict[bytes, int]
    items: list[int]
    texts: list[np.ndarray]
    keys: list[np.ndarray]  # for each mask the sorted hashes,
    where: list[np.ndarray]  # and the item and the position of each


def _stretches(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the stretches whose counting words are all known."""
    picked = [i for i, c in enumerate(mask) if c == "1"]
    at = np.arange(max(0, len(ids) - len(mask) + 1))
    for i in picked:
        at = at[ids[at + i] != 0]
    found = np.zeros(len(at), np.uint64)
    for i in picked:
        found = (found ^ ids[at + i].astype(np.uint64)) * _PRIME
        found ^= found >> np.uint64(29)
    return at, found


def index(rows: list[tuple[int, bytes | None]]) -> Index:
    """The seeds of benchmark rows (item_id, text)."""
    split = [words(t) for _, t in rows]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}), 1)}
    texts = [np.array([vocabulary[w] for w in ws], np.int64) for ws in split]
    keys, where = [], []
    for mask, n in SEEDS:
        own = [(i, t) for i, t in enumerate(texts) if (len(t) == n if n else len(t) >= MIN_WORDS)]
        found = [(np.full(len(at), i), at, h) for i, t in own for at, h in [_stretches(t, mask)]]
        item, at = (np.concatenate([x[k] for x in found] + [np.zeros(0, np.int64)]) for k in (0, 1))
        h = np.concatenate([x[2] for x in found] + [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        keys.append(h[order])
        where.append(np.stack([item[order], at[order]], axis=1).astype(np.int64).reshape(-1, 2))
    return Index(vocabulary, [i for i, _ in rows], texts, keys, where)


def longest_overlap(same: np.ndarray, least: float = MIN_SAME) -> tuple[int, int]:
    """(start, end) of the longest stretch that begins and ends with equal words and has at least this share of them; the first of several."""
    sums = np.concatenate([[0.0], np.cumsum(same - least)]) + 1e-9 * np.arange(len(same) + 1)
    equal = np.flatnonzero(same).tolist()
    lows: list[int] = []
    for i in equal:
        if not lows or sums[i] < sums[lows[-1]]:
            lows.append(i)
    best = (0, 0)
    k = len(lows) - 1
    for j in (i + 1 for i in reversed(equal)):
        while k >= 0 and sums[j] >= sums[lows[k]]:
            if j - lows[k] >= best[1] - best[0] and j > lows[k]:
                best = (lows[k], j)
            k -= 1
    return best


def overlaps(found: Index, texts: list[bytes | None]) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, words, equal words, start in the text, start in the item) of the best overlap of each text and item that counts."""
    get = found.vocabulary.get
    split = [[get(w, 0) for w in words(t)] for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    begins = np.cumsum(lengths + _GAP) - lengths - _GAP
    ids = np.zeros(int(lengths.sum()) + _GAP * len(split), np.int64)
    if not len(split):
        return []
    for b, s in zip(begins, split, strict=True):
        ids[b : b + len(s)] = s
    diagonals = []
    for (mask, _), keys, where in zip(SEEDS, found.keys, found.where, strict=True):
        if not len(keys):
            continue
        at, h = _stretches(ids, mask)
        low = np.searchsorted(keys, h, "left")
        n = np.searchsorted(keys, h, "right") - low
        hit = np.flatnonzero(n)
        at, low, n = at[hit], low[hit], n[hit]
        step = np.cumsum(n) // _HITS
        for first, last in zip(*(np.searchsorted(step, np.unique(step), side) for side in ("left", "right")), strict=True):
            own = n[first:last]
            pick = np.repeat(low[first:last] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            place = np.repeat(at[first:last], own)
            doc = np.searchsorted(begins, place, "right") - 1  # a stretch lies within one text, since the gaps are not known words
            diagonals.append(np.unique(np.stack([doc, where[pick, 0], place - where[pick, 1]], axis=1), axis=0))
    if not diagonals:
        return []
    best: dict[tuple[int, int], tuple] = {}
    for doc, item, shift in np.unique(np.concatenate(diagonals), axis=0).tolist():
        own = found.texts[item]
        low, high = max(shift, int(begins[doc])), min(shift + len(own), int(begins[doc] + lengths[doc]))
        same = ids[low:high] == own[low - shift : high - shift]
        a, b = longest_overlap(same)
        if b - a >= min(MIN_WORDS, len(own)):
            row = (b - a, int(same[a:b].sum()), low + a - int(begins[doc]), low + a - shift)
            if (doc, item) not in best or row[:2] > best[doc, item][:2]:
                best[doc, item] = row
    return [(doc, item, *row) for (doc, item), row in best.items()]


def _parts(benchmark: DataFrame, part_words: int) -> Iterator[list[tuple[int, bytes | None]]]:
    """The benchmark's rows in parts of a bounded number of words, and only one part at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    parts = -(-int(total) // part_words)
    for p in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        yield sorted(((r.item_id, r.text.encode()) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


_SCHEMA = "doc_id long, item_id long, n_words long, n_same long, doc_start long, item_start long"


def contamination(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """A row for each document and benchmark item with an overlap that counts: its length and equal words, and where it begins (words from 0).

    Null or empty texts overlap nothing; repeated rows of docs give repeated rows, items with one id count apart, null ids
    are kept. Of an item's overlaps with a text the longest counts, then the one with more equal words, then the first.
    Long texts are searched whole, some MB of texts at once. An empty table on either side gives an empty result; further
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for part in _parts(benchmark, part_words):
        shared = docs.sparkSession.sparkContext.broadcast(index(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, 1)):
                found = overlaps(shared.value, batch.column(1).cast(pa.binary()).to_pylist())
                ids = batch.column(0).to_pylist()
                columns = list(zip(*((ids[d], shared.value.items[i], *rest) for d, i, *rest in found))) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in _SCHEMA.split(", ")])

        found = rows.mapInArrow(run, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _SCHEMA) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """docs without the rows that overlap a benchmark item; columns and rows stay as they are.

    Null, empty and wordless texts stay; long texts are searched whole, some MB of texts at once; repeated rows go or stay
    alike; null ids on either side and further columns of any name do no harm; an empty table on either side changes nothing.
    """
    names, text = docs.columns, docs.columns.index("text")
    for part in _parts(benchmark, part_words):
        shared = docs.sparkSession.sparkContext.broadcast(index(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, text)):
                dirty = {d for d, *_ in overlaps(shared.value, batch.column(text).cast(pa.binary()).to_pylist())}
                yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema).select(*names)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
