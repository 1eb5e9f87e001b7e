"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Where a window of 50 bytes hangs on the 16-byte gram of it with the least hash, equal windows have equal seeds at equal
places. Seeds that stand once in the corpus are dropped. The stretches of windows around each repeated seed go, once for
each block and text, to the part of the corpus that the seed falls in. There the stretches form one text, each with a
terminator of its own; its suffixes are sorted and give its Burrows-Wheeler transform. Backward extension, breadth first,
turns the intervals of strings of one length into those of strings one byte longer: each boundary between neighbours in
the order is met first at the length of their common prefix, so the values come in increasing order, and the expansion
stops at the minimum length. Boundaries never met part nothing: their neighbours share the whole window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import blocks
from tessella.llm.common import table

#: Bytes of a window, and of the grams among which its seed is.
WINDOW, GRAM = 50, 16
#: Bytes of stretches whose suffixes are sorted together; a part with more is worked off by seeds in several texts.
TOGETHER = 4 << 20
_VALUES = blocks.mixed(np.arange(1, 257, dtype=np.uint64))
_ANSWERS = "block int, part int, keys binary"
_SENT = "part int, block int, payload binary"


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of text, in which 0 marks the terminators; ends holds, for each place, that of its terminator.

    Terminators are smaller than all other values and differ from each other, the earlier being the smaller. By prefix
    doubling over what is not yet in order; a stretch's suffixes compare to its terminator at most.
    """
    n = len(text)
    places = np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | text[np.minimum(places + k, ends)]
    closing = text == 0
    key[closing] = np.arange(closing.sum()) - n
    order = np.argsort(key)
    ranked = key[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, places, 0))
    done = 7
    while True:
        open_ = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(open_):
            return order
        at = order[open_]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + done, ends[at])]
        sort = np.argsort(pair)
        at, pair = at[sort], pair[sort]
        order[open_] = at
        head[open_] = np.r_[True, pair[1:] != pair[:-1]]
        rank[at] = np.maximum.accumulate(np.where(head[open_], open_, 0))
        done *= 2


def common_prefix_classes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in the suffix order its class: neighbours that share least values or more are in one."""
    n = len(text)
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    before = text[order - 1].astype(np.int16)  # the transform; before the first place stands the last terminator
    last_to_first = inverse[order - 1]
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    first = text[order]
    heads = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (first[1:] == 0)])
    low, high = heads.astype(np.int32), np.r_[heads[1:], n].astype(np.int32)  # strings of one value; each terminator alone
    met[high] = True
    for _ in range(1, least):
        size = high - low
        ends = np.cumsum(size, dtype=np.int32)
        place = np.arange(ends[-1], dtype=np.int32) + np.repeat(low - (ends - size), size)
        owner = np.repeat(np.arange(len(low), dtype=np.int32), size)
        real = np.flatnonzero(before[place])
        if not len(real):
            break
        place, owner = place[real], owner[real]
        symbol = (before[place] - 1).astype(np.uint8)
        sort = np.argsort(symbol, kind="stable")  # the places rise, and so do their values before for each symbol
        to, owner, symbol = last_to_first[place[sort]], owner[sort], symbol[sort]
        edge = np.flatnonzero((owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))
        low, high = to[np.r_[0, edge + 1]], to[np.r_[edge, len(to) - 1]] + 1
        new = ~met[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        met[high] = True
    return np.cumsum(met[:n]) - 1


def window_classes(stretches: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, start) for the windows of the stretches, those of one stretch after those of another; start: of each stretch's windows."""
    lengths = np.array([len(s) for s in stretches], np.int64)
    raw = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8).astype(np.int64) + 1
    closing = np.cumsum(lengths + 1) - 1
    raw[closing] = 0
    order = suffix_order(raw, np.repeat(closing, lengths + 1))
    classes = np.empty(len(raw), np.int64)
    classes[order] = common_prefix_classes(raw, order, window)
    n = lengths - window + 1
    places = np.repeat(closing - lengths - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return classes[places], np.cumsum(n) - n


class _Block(blocks.Windows):
    """The documents of a block as bytes."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        self.ids, self.texts = blocks.documents_of(rows)
        self.text = b"".join(self.texts)
        raw = np.frombuffer(self.text, np.uint8)
        super().__init__(raw, _VALUES[raw], np.array([len(t) for t in self.texts], np.int64), window, gram)

    def ids_of(self, s: dict[str, np.ndarray]) -> np.ndarray:
        """The document of each stretch; a null id is the greatest."""
        ids = np.array([blocks.NO_ID if i is None else i for i in self.ids], np.int64)
        return ids[np.searchsorted(np.cumsum(self.lengths), s["start"], "right")] if len(s["start"]) else np.zeros(0, np.int64)


def _seeds(rows: pa.Table, parts: int, window: int, gram: int) -> pa.Table:
    return blocks.keys_table(rows.column("block")[0].as_py(), _Block(rows, window, gram).seed_keys(), parts)


def _stretches(rows: pa.Table, answers: pa.Table, parts: int, window: int, gram: int) -> pa.Table:
    out: dict[str, list] = {"part": [], "block": [], "payload": []}
    if rows.num_rows:
        own = _Block(rows, window, gram)
        s = own.stretches(blocks.hits_of(answers), parts)
        at, ids = s["stands"], own.ids_of(s)
        for p, first, last in blocks.runs(s["part"]):
            mine = at[first:last]
            start, n = s["start"][mine], s["n"][mine]
            texts = b"".join([own.text[a : a + m + window - 1] for a, m in zip(start.tolist(), n.tolist(), strict=True)])
            head = n.astype(np.uint16).tobytes() + (s["seed"][mine] - start).astype(np.uint16).tobytes() + ids[mine].tobytes()
            out["part"].append(p)
            out["block"].append(rows.column("block")[0].as_py())
            out["payload"].append(len(mine).to_bytes(8, "little") + zstandard.compress(head + texts, 3))
    return pa.table({"part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.int32()), "payload": pa.array(out["payload"], pa.binary())})


def smallest_ids(stretches: list[bytes], seeds: list[bytes], ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, start): for each window of the distinct stretches the least id of those given for stretches that hold it; start: of each stretch's windows.

    Equal stretches count as one. A seed around which all are equal is settled by that; the others go into the transform,
    whole seeds together.
    """
    n = np.array([len(s) - window + 1 for s in stretches], np.int64)
    start = np.cumsum(n) - n
    least = np.repeat(ids, n)
    groups: dict[bytes, list[int]] = {}
    for i, s in enumerate(seeds):
        groups.setdefault(s, []).append(i)
    pending: list[int] = []
    size = 0

    def settle() -> None:
        classes, _ = window_classes([stretches[i] for i in pending], window)
        where = blocks.each(start[pending], n[pending])
        order = np.argsort(classes)
        heads = np.flatnonzero(np.r_[True, np.diff(classes[order]) > 0])
        lowest = np.minimum.reduceat(least[where][order], heads)
        least[where[order]] = np.repeat(lowest, np.diff(np.r_[heads, len(order)]))

    for _, members in sorted(groups.items()):
        if len(members) > 1:
            pending += members
            size += sum(len(stretches[i]) + 1 for i in members)
            if size >= TOGETHER:
                settle()
                pending, size = [], 0
    if pending:
        settle()
    return least, start


def _masks(rows: pa.Table, window: int, gram: int) -> pa.Table:
    """For each block's stretches of a part which of their windows start in a document with a smaller id."""
    number: dict[bytes, int] = {}
    seeds: list[bytes] = []
    which, ids, counts, sizes = [], [], [], []
    for payload in rows.column("payload").to_pylist():
        m = int.from_bytes(payload[:8], "little")
        raw = zstandard.decompress(payload[8:])
        n, offset = np.frombuffer(raw, np.uint16, m), np.frombuffer(raw, np.uint16, m, 2 * m)
        at = 12 * m
        for k, o in zip(n.tolist(), offset.tolist(), strict=True):
            text = raw[at : at + k + window - 1]
            at += k + window - 1
            if text not in number:
                number[text] = len(number)
                seeds.append(text[o : o + gram])
            which.append(number[text])
        ids.append(np.frombuffer(raw, np.int64, m, 4 * m))
        counts.append(m)
        sizes.append(n.astype(np.int64))
    own, ids, n = np.array(which, np.int64), np.concatenate(ids), np.concatenate(sizes)
    smallest = np.full(len(number), blocks.NO_ID)
    np.minimum.at(smallest, own, ids)
    least, start = smallest_ids(list(number), seeds, smallest, window)
    place = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    bits = least[place] < np.repeat(ids, n)
    ends = np.cumsum([n[a : a + c].sum() for a, c in zip(np.cumsum(counts) - counts, counts, strict=True)])
    packed = [blocks.packed(b) for b in np.split(bits, ends[:-1])]
    return pa.table({"block": rows.column("block"), "part": rows.column("part"), "keys": pa.array(packed, pa.binary())})


def _kept(rows: pa.Table, answers: pa.Table, parts: int, window: int, gram: int) -> pa.Table:
    own = _Block(rows, window, gram)
    kinds = answers.column("part").to_numpy()
    s = own.stretches(blocks.hits_of(answers.filter(pa.array(kinds < 0))), parts)
    ids = own.ids_of(s)
    later = ids > ids[s["stands"]][s["same"]]  # the same bytes stand in this block under a smaller id
    lost = own.marked(s, dict(zip(kinds.tolist(), answers.column("keys").to_pylist(), strict=True)), later)
    raw = np.frombuffer(own.text, np.uint8)
    removed, spans, kept, a = [], [], [], 0
    for text in own.texts:
        part = lost[a : a + len(text)]
        removed.append(int(part.sum()))
        spans.append(int((part & ~np.r_[False, part[:-1]]).sum()) if removed[-1] else 0)
        kept.append(raw[a : a + len(text)][~part].tobytes() if removed[-1] else text)
        a += len(text)
    return pa.table({"doc_id": pa.array(own.ids, pa.int64()), "n_bytes": pa.array(own.lengths), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def unique_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of docs: the text's bytes (UTF-8) without those of strings that start in a document with a smaller id.

    Null and empty texts have no bytes, texts shorter than a window lose none. A null doc_id is greater than all others;
    rows that repeat a doc_id take nothing from each other. What is left may end within a letter, so it is binary. A very
    long text stands whole in one block, beside others that its hash deals there. A string that several documents share
    stays in the one of smallest id, so ties need no rule. An empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    rows, parts = blocks.blocked(docs, block_bytes)
    seeds = blocks.repeated(blocks.by_block(rows, lambda t: _seeds(t, blocks.key_parts(parts), window, gram), blocks.KEYS))
    sent = blocks.with_answers(rows, seeds, lambda t, a: _stretches(t, a, parts, window, gram), _SENT)
    masks = sent.groupBy("part").applyInArrow(lambda t: _masks(t, window, gram), _ANSWERS)
    answers = seeds.select("block", F.lit(-1).alias("part"), "keys").unionByName(masks)
    return blocks.with_answers(rows, answers, lambda t, a: _kept(t, a, parts, window, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unique_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
