"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents, over one shared backoff.

A word is spelt byte by byte after at most seven bytes of the same word, so a stem tells as much as a whole word does.
Each class has absolutely discounted counts of the longest contexts; what they leave goes to a backoff that both share
and that goes on through ever shorter contexts: in how many distinct words of the whole corpus a byte follows the same
bytes (Kneser-Ney's count of contexts), discounted alike, down to all bytes alike. Above the spelling stand the pairs of
neighbouring words, all of them: what the discounted counts of a class leave to a word after another goes to the number
of classes that have the pair, discounted as well, and what these leave to its spelling. A rare expression therefore
tells little unless one class really uses it. A toxic text is mostly ordinary, so its likelihood of a word is mixed from
both models; the log-likelihood ratio of the mixture and the ordinary model, divided by the number of words, goes through
a logistic curve that fits labelled rows which the counts have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import bucket_of, learnable, slices, stored, table

#: The bound of the training sample: labelled toxic rows, ordinary rows for each of them, characters of a text.
TOXIC_ROWS, ORDINARY = 2000, 3
TRAIN_CHARS = 1 << 16
#: One in so many of the sampled rows calibrates the score instead of filling the counts.
CALIBRATE = 4
#: What absolute discounting takes from every count.
DISCOUNT = 0.75
#: Share of a toxic text's words that the toxic model is taken to account for.
MIX = 0.01
#: Bytes that make a gram: the context and the byte that follows.
GRAM = 8
#: Distinct words that a task holds before it hands them on or forgets their ratios.
HELD_WORDS = 400_000
#: Longest part of a word that is spelt, in characters; longer runs are cut into pieces of this size.
PIECE = 64
#: Words of texts that are scored in one go, and words that are spelt in one go.
STEP = 200_000
#: Counts that travel in one row.
SLICE = 1 << 16
_WORD = re.compile(rf"[^\W_]{{1,{PIECE}}}")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the words, one for each byte and one for the end, and which word each belongs to."""
    spelt = [b" " + w.encode() + b"\n" for w in ws]
    lengths = np.array([len(x) for x in spelt], np.int64)
    raw = np.frombuffer(b"".join(spelt), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(ws)), lengths)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = raw.copy()
    for k in range(1, GRAM):
        keys[k:] |= np.where(place[k:] >= k, raw[: max(0, len(raw) - k)], np.uint64(0)) << np.uint64(8 * k)
    return keys[place > 0], owner[place > 0]


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: set[str] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(words(text))
            if len(held) >= HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["word"])
                held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["word"])


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word): the distinct words of all of docs."""
    return docs.select(F.col("text").cast("string")).mapInArrow(_distinct_words, "word string").distinct()


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text, calibrates) of at most the given toxic rows and ORDINARY times as many others, and how many labelled rows each class has."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter((bucket_of(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 40)) / float(1 << 40)
    most = F.when(F.col("toxic") == 1, toxic_rows).otherwise(ORDINARY * min(toxic_rows, sizes.get(1, 0)))
    near = marked.filter(draw < 3.0 * most / F.when(F.col("toxic") == 1, sizes.get(1, 1)).otherwise(sizes.get(0, 1)))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(draw, "doc_id"))
    drawn = near.withColumn("rank", rank).filter(F.col("rank") <= most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learnt = texts.join(F.broadcast(drawn), "doc_id").withColumn("text", learnable(F.col("text"), F.col("doc_id"), TRAIN_CHARS))  # bounded by toxic_rows
    return learnt.groupBy("doc_id", "toxic", (F.col("rank") % CALIBRATE == 0).alias("calibrates")).agg(F.min("text").alias("text")), sizes


def _class_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of the words of each document, a word once."""
    for batch in batches:
        marks = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        for c in (0, 1):
            ws = [w for t, x in zip(texts, marks, strict=True) if x == c for w in set(words(t))]
            if ws:
                keys, n = np.unique(grams(ws)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n)], ["toxic", "gram", "n"])


def hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for each pair of words, from their hashes; among 10^10 pairs of texts some thousandth of a pair is taken for a learnt one."""
    return v * np.uint64(0x9E3779B97F4A7C15) + w


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of neighbouring words of each document, by their hashes, a pair once."""
    for batch in batches:
        for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ws = words(text)
            h = hashes(ws)
            at = np.unique(pair_keys(h[:-1], h[1:]), return_index=True)[1]
            v, w = h[:-1][at], h[1:][at]
            columns = [pa.array(x.view(np.int64)) for x in (pair_keys(v, w), v, w)]
            yield pa.RecordBatch.from_arrays([pa.array([mark] * len(at), pa.int32()), *columns], ["toxic", "pair", "v", "w"])


@dataclass
class Model:
    keys: np.ndarray  # sorted grams
    ratios: np.ndarray  # log ratios of their last bytes, toxic over ordinary
    contexts: np.ndarray  # sorted contexts
    leave: np.ndarray  # log ratios of what the classes leave to the backoff
    logs: np.ndarray | None = None  # while it learns, their log probabilities in the ordinary and the toxic model
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted keys of pairs of words
    pair_logs: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log ratios of a word after another
    firsts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of their first words
    first_logs: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log ratios of what the classes leave to other words after them


def shorter(keys: np.ndarray) -> list[np.ndarray]:
    """For each order below the longest, the sorted last bytes of the grams; of order 0 all bytes."""
    cut = [np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1)) for k in range(GRAM - 1)]
    return [np.arange(256, dtype=np.uint64), *cut[1:]]


def backoff(keys: np.ndarray, grams_of: list[np.ndarray], counts: list[np.ndarray], n_words: int) -> np.ndarray:
    """The probability of each gram's last byte in the shared model of the order below the longest.

    grams_of: shorter(keys); counts: in how many places of distinct words each of them stands. Grams of none of the
    sampled words count as unseen, and their share goes to the shorter context with the rest of the discount.
    """
    p = np.full(256, 1 / 256)
    for k, (own, n) in enumerate(zip(grams_of, counts, strict=True)):
        context, where = np.unique(own >> np.uint64(8), return_inverse=True)
        if k:
            at, known = _places(grams_of[k - 1], context)
            total = np.where(known & (context != 0x20), counts[k - 1][at], n_words)  # words begin after a blank
            below = p[np.searchsorted(grams_of[k - 1], own & np.uint64((1 << 8 * k) - 1))]
        else:
            total, below = np.array([n.sum()]), p
        kept = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[where]
        p = kept + (1 - np.bincount(where, weights=kept, minlength=len(context)))[where] * below
    return p[np.searchsorted(grams_of[-1], keys & np.uint64((1 << 8 * (GRAM - 1)) - 1))]


def kneser_ney(keys: np.ndarray, counts: np.ndarray, base: np.ndarray) -> Model:
    """Two interpolated models from the class counts [2, grams] over the shared probabilities of the grams."""
    contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
    logs, leave = [], []
    for n in counts:
        total = np.bincount(where, weights=n, minlength=len(contexts))
        own = np.maximum(n - DISCOUNT, 0) / np.maximum(total[where], 1)
        rest = 1 - np.bincount(where, weights=own, minlength=len(contexts))
        logs.append(np.log(own + rest[where] * base))
        leave.append(np.log(rest))
    return Model(keys, (logs[1] - logs[0]).astype(np.float32), contexts, (leave[1] - leave[0]).astype(np.float32), np.array(logs))


def spelling(model: Model, ws: list[str]) -> np.ndarray:
    """The log-likelihood ratio of each word's spelling, toxic over ordinary."""
    keys, owner = grams(ws)
    at, known = _places(model.keys, keys)
    found = np.zeros(len(keys))
    found[known] = model.ratios[at[known]]
    at, seen = _places(model.contexts, keys[~known] >> np.uint64(8))
    found[~known] = np.where(seen, model.leave[at] if len(model.leave) else 0.0, 0.0)
    return np.bincount(owner, weights=found, minlength=len(ws))


def _spelt(model: Model, filling: DataFrame) -> DataFrame:
    """(w, s0, s1): the hash of each word of the sample, and the probability of its spelling in each class."""
    sent = filling.sparkSession.sparkContext.broadcast((model.keys, model.logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, logs = sent.value
        for ws in (batch.column(0).to_pylist() for batch in batches if batch.num_rows):
            keys, owner = grams(ws)
            at = np.searchsorted(learnt, keys)
            spelt = [pa.array(np.exp(np.bincount(owner, weights=x[at], minlength=len(ws)))) for x in logs]
            yield pa.RecordBatch.from_arrays([pa.array(hashes(ws).view(np.int64)), *spelt], ["w", "s0", "s1"])

    found = stored(corpus_words(filling).mapInArrow(run, "w long, s0 double, s1 double"), "toxicity-words")
    sent.destroy()
    return found


def add_pairs(model: Model, filling: DataFrame) -> None:
    """The model with the pairs of words of the sample (toxic, text), by the documents of each class that have them.

    The probabilities are made in tasks; the driver gets two numbers for each pair.
    """
    by_class = [F.count_if(F.col("toxic") == c).alias(f"n{c}") for c in (0, 1)]
    found = filling.mapInArrow(_class_pairs, "toxic int, pair long, v long, w long").groupBy("pair", "v", "w").agg(*by_class)
    found = found.withColumn("n2", (F.col("n0") > 0).cast("long") + (F.col("n1") > 0).cast("long"))  # in how many classes: Kneser-Ney's count of contexts
    found = stored(found, "toxicity-pairs")
    kept = [F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) for c in range(3)]
    sums = [F.greatest(F.sum(f"n{c}"), F.lit(1)).alias(f"m{c}") for c in range(3)] + [F.sum(kept[c]).alias(f"k{c}") for c in range(3)]
    rest = [1 - F.col(f"k{c}") / F.col(f"m{c}") for c in range(3)]  # what the counts leave after a first word
    firsts = found.groupBy("v").agg(*sums)
    below = [kept[2] / F.col("m2") + rest[2] * F.col(f"s{c}") for c in (0, 1)]
    p = [kept[c] / F.col(f"m{c}") + rest[c] * below[c] for c in (0, 1)]
    pairs = found.join(firsts, "v").join(_spelt(model, filling), "w").select("pair", F.log(p[1] / p[0]).cast("float").alias("ratio")).toArrow()
    keys = pairs["pair"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model.pairs, model.pair_logs = keys[order], pairs["ratio"].to_numpy()[order]
    left = firsts.select("v", F.log(rest[1] / rest[0]).cast("float").alias("ratio")).toArrow()
    keys = left["v"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model.firsts, model.first_logs = keys[order], left["ratio"].to_numpy()[order]


@dataclass
class Met:
    """What a task knows of the words that it has met: the place of each, and by place its hash and two log ratios."""

    places: dict[str, int] = field(default_factory=dict)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spelt: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of its spelling
    after: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of what the classes leave to other words after it

    def take(self, model: Model, texts: list[list[str]]) -> np.ndarray:
        """The places of the words of the texts, one after the other."""
        new = list({w for ws in texts for w in ws} - self.places.keys())
        if new:
            found = hashes(new)
            at, known = _places(model.firsts, found)
            after = np.zeros(len(new))
            after[known] = model.first_logs[at[known]]
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.hashes = np.concatenate([self.hashes, found])
            self.spelt = np.concatenate([self.spelt, *(spelling(model, new[i : i + STEP]) for i in range(0, len(new), STEP))])
            self.after = np.concatenate([self.after, after])
        return np.fromiter(map(self.places.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))


def _ratios(model: Model, texts: list[list[str]], met: Met) -> np.ndarray:
    sizes = np.array([len(ws) for ws in texts], np.int64)
    at = met.take(model, texts)
    out = np.zeros(len(texts))
    if not len(at):
        return out
    raw = met.spelt[at]
    place, known = _places(model.pairs, pair_keys(met.hashes[at[:-1]], met.hashes[at[1:]]))
    follows = met.after[at[:-1]] + raw[1:]
    follows[known] = model.pair_logs[place[known]]
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(at), bool)
    inner[starts[sizes > 0]] = False
    raw[inner] = follows[inner[1:]]
    mixed = np.log1p(MIX * np.expm1(np.minimum(raw, 500)))
    out[sizes > 0] = np.add.reduceat(mixed, starts[sizes > 0]) / sizes[sizes > 0]
    return out


def evidence(model: Model, texts: list[list[str]], met: Met) -> np.ndarray:
    """The log-likelihood ratio of the mixture and the ordinary model, by word; met keeps the words' ratios from call to call."""
    out, begin, held = [np.zeros(0)], 0, 0
    for i, ws in enumerate(texts):
        held += len(ws)
        if held >= STEP or i == len(texts) - 1:
            if len(met.places) > HELD_WORDS:
                met.__init__()
            out.append(_ratios(model, texts[begin : i + 1], met))
            begin, held = i + 1, 0
    return np.concatenate(out)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the points, slightly regularised, by Newton's method."""
    scale = x.std() or 1.0
    a = np.stack([(x - x.mean()) / scale, np.ones(len(x))], axis=1)
    beta, ridge = np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.clip(np.linalg.solve(hessian, a.T @ (weight * (y - p)) - ridge * beta), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta[0] / scale, beta[1] - beta[0] * x.mean() / scale


def _shared_counts(docs: DataFrame, grams_of: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """In how many places of distinct words of docs each gram of each order stands, and the number of these words.

    Each task counts into arrays as long as the sample's grams, and slices of them are added up.
    """
    sent = docs.sparkSession.sparkContext.broadcast(grams_of)
    begins = np.cumsum([0, *map(len, grams_of)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(begins[-1] + 1, np.int64)  # the last place counts the words

        def settle(ws: list[str]) -> None:
            total[-1] += len(ws)
            found, n = np.unique(grams(ws)[0], return_counts=True)
            for k in reversed(range(len(sent.value))):
                cut, at = np.unique(found & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
                found, n = cut, np.bincount(at, weights=n).astype(np.int64)
                at, known = _places(sent.value[k], found)
                total[begins[k] + at[known]] += n[known]

        ws: list[str] = []
        for batch in batches:
            ws += batch.column(0).to_pylist()
            if len(ws) >= HELD_WORDS:
                settle(ws)
                ws = []
        if ws:
            settle(ws)
        for i in range(0, len(total), SLICE):
            if total[i : i + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([zstandard.compress(total[i : i + SLICE].tobytes(), 3)])], ["slice", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(c), np.int64) for c in rows.column("counts").to_pylist())
        return pa.table({"slice": rows.column("slice")[:1], "counts": pa.array([zstandard.compress(total.tobytes(), 3)])})

    schema = "slice int, counts binary"
    found = corpus_words(docs).mapInArrow(run, schema).groupBy("slice").applyInArrow(added, schema).toArrow()
    whole = np.zeros(begins[-1] + 1, np.int64)
    for i, c in zip(found["slice"].to_pylist(), found["counts"].to_pylist(), strict=True):
        part = np.frombuffer(zstandard.decompress(c), np.int64)
        whole[i * SLICE : i * SLICE + len(part)] = part
    return [whole[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)], int(whole[-1])


def spelling_model(docs: DataFrame, filling: DataFrame) -> Model | None:
    """The model without pairs from the sample (toxic, text) and all of docs, or None if a class has no gram."""
    found = filling.mapInArrow(_class_grams, "toxic int, gram long, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n")).toArrow()
    marks, own, n = found["toxic"].to_numpy(), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    if len(set(marks)) < 2:
        return None
    keys, where = np.unique(own, return_inverse=True)
    counts = np.zeros((2, len(keys)))
    counts[marks, where] = n
    grams_of = shorter(keys)
    return kneser_ney(keys, counts, backoff(keys, grams_of, *_shared_counts(docs, grams_of)))


def _told(rows: DataFrame, key: str, shared: Broadcast[Model]) -> DataFrame:
    """(key, evidence, spoken) of rows (key, text): the evidence of each text, and whether it has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = [words(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(evidence(shared.value, texts, met)), pa.array([bool(ws) for ws in texts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [key, "evidence", "spoken"])

    return rows.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, evidence double, spoken boolean")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast[Model], float, float, float] | None:
    """The model in every task, the slope and offset of its curve and the share of toxic labels; None if a class has no row to learn from.

    What the driver gets is bounded by the sample: its grams and pairs, the corpus's counts of the grams, and a number
    for each row that calibrates.
    """
    rows, sizes = sample(docs, labels)
    rows = stored(rows, "toxicity-sample")
    filling = rows.filter(~F.col("calibrates")).select("toxic", "text")
    model = spelling_model(docs, filling)
    if model is None:
        return None
    add_pairs(model, filling)
    model.logs = None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    points = sorted((r.toxic, r.evidence) for r in _told(rows.filter("calibrates"), "toxic", shared).collect())
    if {y for y, _ in points} != {0, 1}:
        points = sorted((r.toxic, r.evidence) for r in _told(rows, "toxic", shared).collect())
    y, x = np.array(points, float).T
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    return shared, *map(float, calibrate(x, y, weight * len(y) / weight.sum())), sizes[1] / (sizes[0] + sizes[1])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of docs, by the contract of op9.

    A text without a word scores the share of toxic labels; if a class has no row to learn from, all texts score 0.
    Of several labels of a document the greater counts, and labels other than 0 and 1 are none. A score of just one half
    is predicted 1, equal texts have equal scores. A null doc_id keeps its
    row, with held_out false; repeated rows keep their rows; long texts are scored whole, and learnt from in part; an empty
    table gives an empty result; further columns of docs or labels are ignored.
    """
    learnt = learn(docs, labels)
    if learnt is None:
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("evidence"), F.lit(0.0).alias("score"))
    else:
        shared, slope, offset, prior = learnt
        curve = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("evidence") * slope + offset))))
        found = _told(docs, "doc_id", shared).withColumn("score", F.when(F.col("spoken"), curve).otherwise(prior))
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
