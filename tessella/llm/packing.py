"""Packing documents into sequences of a fixed number of tokens, by best-two-fit.

A bin is filled greedily, the largest piece that fits first; then its smallest piece gives way to two unpacked ones that
fill its place and the gap more tightly, as long as such a pair exists. What a bin takes depends only on how many pieces
of each length are left, so the bins are planned over the counts of lengths, at most one for each token of a sequence,
and a run of equal bins is planned at once. Pieces are then numbered within their length by counts of the files' parts
and prefix sums over the parts, and each looks up its place in the plan; no piece is shuffled for that, and neither the
driver nor a task sees more of them than counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessella.llm.common import fresh, stored, table
from tessella.llm.words import bytes_of, pieces

#: Tokens of a sequence.
CAPACITY = 1024
#: The token that ends a document.
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Counts of (part, length) that are broadcast at most, some 30 bytes each; more are joined by a shuffle.
BROADCAST_COUNTS = 1_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Bytes that are, or may begin, white space.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])


def _opens(data: np.ndarray) -> np.ndarray:
    """Where the tokenizer's own splitting always begins anew: at a space before something that is not white space."""
    found = data == 32
    found[:-1] &= ~_BLANK[data[1:]]
    found[-1:] = False
    return found


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by turns from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """The ids of a text by a file of the tokenizers library, without special tokens; a text that spells one is a text.

    A byte-level vocabulary whose ids follow the order of its merges is a table of ranks, and tiktoken gives the same ids
    from it in a quarter of the time.
    """
    told = json.loads(Path(vocabulary).read_text("utf-8"))
    model, split = told["model"], told.get("pre_tokenizer") or {}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    plain = not told.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if plain and model.get("type", "BPE") == "BPE" and all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged)):
        byte, special = _byte_of(), {t["content"] for t in told.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding(Path(vocabulary).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _encoded(encode: Callable[[str], list[int]], data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and where those of each begin and the last end."""
    held = data.tobytes()
    each = [np.array(encode(held[a:b].decode("utf-8", "replace")), np.uint32) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate(([0], np.cumsum([len(x) for x in each])))


def _cut(ids: np.ndarray, begins: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """row, piece, start and length of the pieces of documents whose ids begin there; the first of a document's is the shorter."""
    sizes = np.diff(begins)
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = sizes - (n - 1) * capacity
    start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
    return row, piece, start, np.where(piece > 0, capacity, first[row])


def pieces_of(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's tokens and end, cut where longer than a sequence.

    ids are little-endian unsigned 32-bit numbers. Null and empty texts are their end alone. The remainder of a longer
    document is its first piece. A very long text is tokenized in parts, which gives the same tokens; its ids, four bytes
    each, are held whole. Repeated rows and null ids are documents each; an empty table gives no rows, and other columns
    of docs do not matter. vocabulary: a file of the tokenizers library that splits before spaces.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)

        def out(doc_ids: pa.Array, ids: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
            row, piece, start, length = _cut(ids, begins, capacity)
            offsets = np.append(np.cumsum(length) - length, len(ids)) * 4
            held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), held], ["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            data, begins = bytes_of(batch.column(1))
            going, held = -1, []  # a text that comes in parts
            for part, starts, rows in pieces(data, begins, _opens):
                ids, at = _encoded(encode, part, starts)
                if going >= 0 and rows[0] != going:
                    whole = np.concatenate([*held, np.array([end_id], np.uint32)])
                    yield out(batch.column(0).slice(going, 1), whole, np.array([0, len(whole)]))
                    going, held = -1, []
                if len(rows) == 1:
                    going = int(rows[0])
                    held.append(ids)
                else:
                    yield out(batch.column(0).take(pa.array(rows)), np.insert(ids, at[1:], end_id), at + np.arange(len(at)))
            if going >= 0:
                whole = np.concatenate([*held, np.array([end_id], np.uint32)])
                yield out(batch.column(0).slice(going, 1), whole, np.array([0, len(whole)]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Runs of equal bins, (number of bins, pieces of each length in a bin), that hold so many pieces of each length.

    A run goes on while every choice that its first bin made is still open; fewer pieces never open a better one.
    """
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("a piece must have a length from 1 to the capacity")
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if n > 0}
    plan = []
    while left:
        taken: dict[int, int] = {}
        most: dict[int, int] = {}  # of each length that some choice found there
        gap, again = capacity, True
        for s, n in left.items():
            if k := min(n, gap // s):
                again &= n >= gap // s  # a bin that takes the last ones is alone
                taken[s] = most[s] = k
                gap -= k * s
        while gap:
            least = min(taken)
            pair = _tightest(left, taken, least, gap)
            if not pair:
                break
            taken[least] -= 1
            for s in pair:
                taken[s] = taken.get(s, 0) + 1
            for s in pair:
                most[s] = max(most.get(s, 0), taken[s] + (s == least))
            gap += least - sum(pair)
            taken = {s: k for s, k in taken.items() if k}
        bins = min((left[s] - most[s]) // k for s, k in taken.items()) + 1 if again else 1
        for s, k in taken.items():
            left[s] -= k * bins
        left = {s: n for s, n in left.items() if n}
        plan.append((bins, taken))
    return plan


def _tightest(left: dict[int, int], taken: dict[int, int], least: int, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths of greatest sum that fit the gap once a piece of the least length is gone, and fill more than it."""
    free = [s for s, n in left.items() if n > taken.get(s, 0)]  # from the largest
    best, low = None, len(free) - 1
    for s in free:
        while low >= 0 and free[low] + s <= least + gap:
            low -= 1
        if low + 1 < len(free):
            other = free[low + 1]
            if other > s:  # the two have met
                other = s
            if other == s and left[s] - taken.get(s, 0) < 2:
                rest = [x for x in free[low + 1 :] if x < s]
                if not rest:
                    continue
                other = rest[0]
            if s + other > least and s + other <= least + gap and (best is None or s + other > sum(best)):
                best = (s, other)
    return best


def _lookup(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the stretches of its pieces that a run takes: first piece, first bin, pieces in a bin, offset of the first."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for bins, taken in plan:
        offset = 0
        for s, k in sorted(taken.items(), reverse=True):
            found.setdefault(s, []).append((used.get(s, 0), first, k, offset))
            used[s] = used.get(s, 0) + bins * k
            offset += s * k
        first += bins
    return {s: np.array(rows, np.int64) for s, rows in found.items()}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, with sequence_id and offset: bins by best-two-fit, the pieces of a bin one after the other from 0.

    cut has a column length, from 1 to the capacity, and any others, which are kept; columns named like the new ones are
    replaced. Pieces of one length are alike, so ties need no rule; an empty table gives an empty result.
    """
    cut = cut.drop("sequence_id", "offset")
    part, nth, base = fresh(cut, "part", "nth", "base")
    columns = cut.columns
    at = columns.index("length")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = np.asarray(batch.column(at))
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            sizes = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - (np.cumsum(sizes) - sizes)[ranked] + seen[ranked]
            seen += sizes
            yield batch.append_column(part, pa.array(np.full(len(length), own, np.int64))).append_column(nth, pa.array(rank))

    added = [T.StructField(c, T.LongType()) for c in (part, nth)]
    numbered = stored(cut.mapInArrow(number, T.StructType([*cut.schema.fields, *added])), "packing-pieces")
    counts = stored(numbered.groupBy(part, "length").agg(F.count("*").alias("n")), "packing-counts")
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one for each length
    lookup = _lookup(best_two_fit(sizes, capacity))
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = counts.select(part, "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    bases = F.broadcast(bases) if counts.count() <= BROADCAST_COUNTS else bases
    known = numbered.join(bases, [part, "length"]).select(*columns, (F.col(base) + F.col(nth)).alias(nth))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(at)), np.asarray(batch.column(batch.num_columns - 1))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                own, rows = length == s, lookup[int(s)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                n = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 1] + n // row[:, 2], row[:, 3] + n % row[:, 2] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    added = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    return known.mapInArrow(find, T.StructType([*cut.schema.fields, *added]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the tokens of each sequence, of rows from place() that still have their ids."""
    gathered = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))  # at most a sequence's tokens
    return gathered.select("sequence_id", "length", F.aggregate("pieces", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"))


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their ids and places; see pieces_of() and place()."""
    return place(pieces_of(docs, vocabulary, end_id, capacity), capacity)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the pieces of all documents; of the ids only their checksum is kept."""
    cut = pieces_of(table(spark, sf_dir, "documents"))
    return place(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
