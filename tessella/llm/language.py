"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree up to order 3 whose counts are frozen after training. A byte is coded in the longest
context that knows it; every shorter step costs the escape probability of the context left (method C: distinct
successors over successors plus distinct successors, without exclusion). Under frozen counts the code length of a byte
depends on the last four bytes alone, so the trees are flattened into sorted tables that hold the exact code length in
every language at once, and a text is scored by looking its bytes up in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import bucket_of, learnable, slices, table

#: Longest context, in bytes.
ORDER = 3
#: The bound of the training sample: rows of a language, and characters of a text.
TRAIN_ROWS = 400
TRAIN_CHARS = 1 << 16
#: Documents that are predicted with less confidence are rejected by keep_identified().
MIN_SCORE = 0.5
_START = b"\n" * ORDER
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are looked up at once.
_STEP = 1 << 20


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # for each order, the sorted codes of context and byte
    bits: list[np.ndarray]  # their code lengths, a column for each language
    contexts: list[np.ndarray]  # for each order, the sorted codes of the contexts
    escapes: list[np.ndarray]  # the code lengths of leaving them


def codes(texts: list[bytes], order: int = ORDER, before: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts the code of itself and the order bytes before it, and where the texts begin.

    before: the ORDER bytes that stand before each text, where it goes on another one.
    """
    joined = np.frombuffer(b"".join([(before[i] if before else _START) + t for i, t in enumerate(texts)]), np.uint8)
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + ORDER) - lengths
    found = np.zeros(len(joined), np.uint32)
    for k in range(order + 1):
        found[k:] |= joined[: len(joined) - k].astype(np.uint32) << np.uint32(8 * k)
    own = np.ones(len(joined), bool)
    for k in range(1, ORDER + 1):
        own[begins - k] = False
    return found[own], np.cumsum(lengths) - lengths


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
            if own:
                grams, n = np.unique(codes(own)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def sample(docs: DataFrame, rows: int = TRAIN_ROWS, longest: int = TRAIN_CHARS) -> DataFrame:
    """(lang, text): at most the given rows of each language, chosen by a hash among the rows that may be learnt from.

    Of a text longer than the bound so many characters are learnt, from a place drawn by its id.
    """
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    able = able.filter((bucket_of(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 40)) / float(1 << 40)
    sizes = able.groupBy("lang").agg(F.count("*").alias("rows"))
    near = able.join(F.broadcast(sizes), "lang").filter(draw < 3.0 * rows / F.col("rows"))  # sizes: a row for each language; near: about three times as many as are taken
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", "text"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= rows).select("lang", learnable(F.col("text"), F.col("doc_id"), longest).alias("text"))


def learn(labelled: DataFrame) -> Model:
    """The frozen model of rows (lang, text); what comes to the driver is bounded by the sample, not by the corpus."""
    counts = labelled.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    column = np.array([langs.index(x) for x in counts["lang"].to_pylist()], np.int64)
    return build(langs, column, counts["gram"].to_numpy().astype(np.uint32), counts["n"].to_numpy())


def build(langs: list[str], column: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Model:
    keys, bits, contexts, escapes = [], [], [], []
    lower = None
    for k in range(ORDER + 1):
        cut = grams & np.uint32((1 << 8 * (k + 1)) - 1)
        own, at = np.unique(cut, return_inverse=True)
        count = np.zeros((len(own), len(langs)))
        np.add.at(count, (at, column), n)
        context, where = np.unique(own >> np.uint32(8), return_inverse=True)
        total, kinds = np.zeros((len(context), len(langs))), np.zeros((len(context), len(langs)))
        np.add.at(total, where, count)
        np.add.at(kinds, where, count > 0)
        if k:
            shorter = bits[-1][np.searchsorted(keys[-1], own & np.uint32((1 << 8 * k) - 1))]
        else:
            shorter = np.full(count.shape, 8.0)  # order -1: all bytes alike
        whole = total + kinds
        escape = np.where(total > 0, -np.log2(np.where(kinds > 0, kinds, 1) / np.maximum(whole, 1)), 0.0)
        seen = -np.log2(np.where(count > 0, count, 1) / np.maximum(whole, 1)[where])
        keys.append(own)
        bits.append(np.where(count > 0, seen, escape[where] + shorter))
        contexts.append(context)
        escapes.append(escape)
    return Model(langs, keys, bits, contexts, escapes)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(model: Model, grams: np.ndarray) -> np.ndarray:
    """The bits of each byte in every language, from the code of the byte and the three before it."""
    out = np.zeros((len(grams), len(model.langs)))
    rest = np.arange(len(grams))
    for k in range(ORDER, -1, -1):
        now = grams[rest] & np.uint32((1 << 8 * (k + 1)) - 1)
        at, known = _find(model.keys[k], now)
        out[rest[known]] += model.bits[k][at[known]]
        rest, now = rest[~known], now[~known]
        at, known = _find(model.contexts[k], now >> np.uint32(8))
        out[rest[known]] += model.escapes[k][at[known]]
    out[rest] += 8.0
    return out


def text_bits(model: Model, texts: list[bytes]) -> np.ndarray:
    """The code length of each text in every language; long texts are worked off in pieces, a few MB at once."""
    sums = np.zeros((len(texts), len(model.langs)))
    held: list[tuple[int, bytes, bytes]] = []
    size = 0

    def settle() -> None:
        grams, starts = codes([t for _, t, _ in held], before=[b for *_, b in held])
        bits = code_lengths(model, grams)
        np.add.at(sums, [i for i, *_ in held], np.add.reduceat(bits, starts, axis=0))

    for i, text in enumerate(texts):
        for at in range(0, len(text), _STEP):
            held.append((i, text[at : at + _STEP], text[at - ORDER : at] if at else _START))
            size += len(held[-1][1])
            if size >= _STEP:
                settle()
                held, size = [], 0
    if held:
        settle()
    return sums


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits above the line, fractions and numerals are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; the score is the posterior of the best language, all alike beforehand."""
    able = [i for i, t in enumerate(texts) if t and model.langs and has_letter(t)]
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if able:
        bits = text_bits(model, [texts[i].encode() for i in able])
        best = bits.argmin(axis=1)
        gap = bits - bits.min(axis=1, keepdims=True)
        scores[able] = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        for i, b in zip(able, best, strict=True):
            langs[i] = model.langs[b]
    return langs, scores


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs, by the contract of op4.

    A null text, or one without a letter, is `und` with score 0; without any row to learn from all are. A null doc_id
    keeps its row, with held_out false. Repeated rows keep their rows; an empty table gives an empty result; further
    columns are ignored. Ties go to the language that comes first in the alphabet. Long texts are scored whole, piece by
    piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(sample(docs)) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            langs, scores = predict(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that have no language (`und`) or whose language is in doubt; columns and rows stay as they are.

    Null, empty and letterless texts are `und` and go. Long texts are scored whole, piece by piece; repeated rows and ties
    go or stay alike; null ids, nulls elsewhere and further columns of any name do no harm; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(sample(docs)))
    names, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text)):
            langs, scores = predict(shared.value, batch.column(text).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*names)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
