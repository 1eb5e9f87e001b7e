"""Substring dedup by seed and extend: passages of 35 words or more that stand anywhere else.

Winnowing picks, of the 12-word grams of every 35-word window, the one with the least hash: equal windows have equal
seeds at equal places. Documents are joined on seeds through the blocks; a seed that stands only once is dropped, and
with it all windows that hang on it. The stretches of windows around a repeated seed meet, equal ones of a block as one,
where they are laid upon each other at the seed. From there the matches are extended both ways, word by word: stretches
that agree so far form a class, and every further word splits it. A window is repeated if the classes of its left and of
its right end have another stretch in common. The union of the repeated windows is that of all maximal repeats of at
least 35 words. Hashes only bring stretches together; the words decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import blocks
from tessella.llm.common import table

#: Words of a window, and of the grams among which its seed is.
WINDOW, GRAM = 35, 12
_SENT = "part int, block int, payload binary"
_ANSWERS = "block int, part int, keys binary"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class _Block(blocks.Windows):
    """The documents of a block, and their words, numbered within the block."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        self.ids, texts = blocks.documents_of(rows)
        self.words = [t.split() for t in texts]  # at bytes 09-0D and 20
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for ws in self.words for w in ws], np.int64)
        hashes = np.array([word_hash(w) for w in number], np.uint64)
        super().__init__(flat, hashes[flat] if len(flat) else np.zeros(0, np.uint64), np.array([len(ws) for ws in self.words], np.int64), window, gram)


def _seeds(rows: pa.Table, parts: int, window: int, gram: int) -> pa.Table:
    return blocks.keys_table(rows.column("block")[0].as_py(), _Block(rows, window, gram).seed_keys(), parts)


def _stretches(rows: pa.Table, answers: pa.Table, parts: int, window: int, gram: int) -> pa.Table:
    """For each part the block's stretches around its repeated seeds: how many windows, where the seed is, whether it stands there twice, the words."""
    out: dict[str, list] = {"part": [], "block": [], "payload": []}
    if rows.num_rows:
        own = _Block(rows, window, gram)
        s = own.stretches(blocks.hits_of(answers), parts)
        every = [w for ws in own.words for w in ws]
        many = np.bincount(s["same"], minlength=len(s["stands"])) > 1
        for p, first, last in blocks.runs(s["part"]):
            mine = s["stands"][first:last]
            start, n = s["start"][mine], s["n"][mine]
            texts = [b" ".join(every[a : a + m + window - 1]) for a, m in zip(start.tolist(), n.tolist(), strict=True)]
            head = n.astype(np.uint16).tobytes() + (s["seed"][mine] - start).astype(np.uint16).tobytes() + many[first:last].astype(np.uint8).tobytes()
            out["part"].append(p)
            out["block"].append(rows.column("block")[0].as_py())
            out["payload"].append(len(mine).to_bytes(8, "little") + zstandard.compress(head + b"\n".join(texts), 3))
    return pa.table({"part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.int32()), "payload": pa.array(out["payload"], pa.binary())})


def _split(classes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The classes after one more word."""
    return np.unique(classes * (int(word.max(initial=0)) + 1) + word, return_inverse=True)[1]


def repeated_windows(texts: list[list[bytes]], offsets: np.ndarray, copies: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """For each of the different stretches which of its windows stand anywhere else: in another stretch, or in a copy of its own.

    offsets: where the seed begins; copies: how often the stretch stands, 2 for more.
    """
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for ws in texts for w in ws], np.int64)
    lengths = np.array([len(ws) for ws in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    n, rows = lengths - window + 1, np.arange(len(texts))
    seed: dict[bytes, int] = {}
    base = np.array([seed.setdefault(flat[b + o : b + o + gram].tobytes(), len(seed)) for b, o in zip(begins.tolist(), offsets.tolist(), strict=True)], np.int64)

    def word(at: np.ndarray) -> np.ndarray:  # beyond its ends a stretch agrees with no other
        inside = (at >= 0) & (at < lengths)
        return np.where(inside, flat[np.minimum(begins + np.maximum(at, 0), len(flat) - 1)], len(number) + rows)

    left, right = [base], [base]
    for k in range(window - gram):
        left.append(_split(left[-1], word(offsets - k - 1)))
        right.append(_split(right[-1], word(offsets + gram + k)))
    found = [np.zeros(m, bool) for m in n.tolist()]
    for k in range(window - gram + 1):
        own = np.flatnonzero((offsets >= k) & (offsets - k < n))  # have a window with k words before the seed
        if not len(own):
            continue
        a, b = left[k][own], right[window - gram - k][own]
        _, both = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
        again = np.bincount(both, weights=copies[own])[both] > 1
        for i in own[again].tolist():
            found[i][offsets[i] - k] = True
    return found


def _masks(rows: pa.Table, window: int, gram: int) -> pa.Table:
    """For each block's stretches of a part which of their windows are repeated."""
    number: dict[tuple[int, bytes], int] = {}
    copies: list[int] = []
    sent: list[list[int]] = []
    for payload in rows.column("payload").to_pylist():
        m = int.from_bytes(payload[:8], "little")
        raw = zstandard.decompress(payload[8:])
        offset, many = np.frombuffer(raw, np.uint16, m, 2 * m), np.frombuffer(raw, np.uint8, m, 4 * m)
        which = []
        for o, twice, text in zip(offset.tolist(), many.tolist(), raw[5 * m :].split(b"\n"), strict=True):
            i = number.setdefault((o, text), len(number))
            if i == len(copies):
                copies.append(0)
            copies[i] += 1 + twice
            which.append(i)
        sent.append(which)
    found = repeated_windows([t.split(b" ") for _, t in number], np.array([o for o, _ in number], np.int64), np.minimum(copies, 2), window, gram)
    answers = [blocks.packed(np.concatenate([found[i] for i in which])) for which in sent]
    return pa.table({"block": rows.column("block"), "part": rows.column("part"), "keys": pa.array(answers, pa.binary())})


def _kept(rows: pa.Table, answers: pa.Table, parts: int, window: int, gram: int) -> pa.Table:
    own = _Block(rows, window, gram)
    kinds = answers.column("part").to_numpy()
    s = own.stretches(blocks.hits_of(answers.filter(pa.array(kinds < 0))), parts)
    gone = own.marked(s, dict(zip(kinds.tolist(), answers.column("keys").to_pylist(), strict=True)))
    texts, removed, at = [], [], 0
    for ws in own.words:
        lost = gone[at : at + len(ws)]
        at += len(ws)
        removed.append(int(lost.sum()))
        texts.append(b" ".join(ws) if not removed[-1] else b" ".join([w for w, x in zip(ws, lost.tolist(), strict=True) if not x]))
    return pa.table({"doc_id": pa.array(own.ids, pa.int64()), "n_words": pa.array(own.lengths), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(texts, pa.binary()).cast(pa.string())})


def unique_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs: the text without the words of repeated windows, its words joined by one space.

    A window counts as repeated where its sequence of words also starts at any other place, in the same row or another;
    all places of a tie go alike. Rows that repeat a doc_id are documents of their own. Null and empty texts have no
    words, texts shorter than a window lose none. A null doc_id keeps its row. A very long text stands whole in
    one block, beside others that its hash deals there. An empty table gives an empty result; further columns are ignored, whatever their names.
    """
    rows, parts = blocks.blocked(docs, block_bytes)
    seeds = blocks.repeated(blocks.by_block(rows, lambda t: _seeds(t, blocks.key_parts(parts), window, gram), blocks.KEYS))
    sent = blocks.with_answers(rows, seeds, lambda t, a: _stretches(t, a, parts, window, gram), _SENT)
    masks = sent.groupBy("part").applyInArrow(lambda t: _masks(t, window, gram), _ANSWERS)
    answers = seeds.select("block", F.lit(-1).alias("part"), "keys").unionByName(masks)
    return blocks.with_answers(rows, answers, lambda t, a: _kept(t, a, parts, window, gram), "doc_id long, n_words long, n_removed long, kept string")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unique_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
