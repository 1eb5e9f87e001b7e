import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tessella.llm import toxicity
from tessella.llm.common import table

DATA = "/root/testdata/sf0.1"


def test_probabilities_equal_a_walk_over_dictionaries(spark, monkeypatch):
    """The interpolated probabilities of every gram and pair, from dictionaries of strings."""
    rng = np.random.default_rng(2)
    words = {c: ["".join(rng.choice(list("ab\u00e9"), rng.integers(1, 11))) for _ in range(120)] for c in (0, 1)}
    corpus = sorted({w for c in words for w in words[c]} | {"abc", "b", "zzz"})

    def spelt(ws, order=7):
        raw = [b" " + w.encode() + b"\n" for w in ws]
        return [x[max(0, i - order) : i + 1] for x in raw for i in range(1, len(x))]

    number = lambda g: int.from_bytes(g, "big")
    grams = {c: Counter(spelt(words[c])) for c in words}
    listed = {number(g): g for c in grams for g in grams[c]}
    keys = np.array(sorted(listed), np.uint64)
    counts = np.array([[grams[c][listed[int(k)]] for k in keys] for c in (0, 1)], float)
    grams_of = toxicity.shorter(keys)
    shared = [Counter(map(number, spelt(corpus, k))) for k in range(7)]
    base = toxicity.backoff(keys, grams_of, [np.array([shared[k][int(g)] for g in own]) for k, own in enumerate(grams_of)], len(corpus))
    model = toxicity.kneser_ney(keys, counts, base)
    known = [{g[-(k + 1) :] for g in listed.values()} for k in range(7)]
    known[0] = {bytes([b]) for b in range(256)}
    seen = [Counter(spelt(corpus, k)) for k in range(7)]

    def below(g, k):
        if k < 0:
            return 1 / 256
        g = g[-(k + 1) :]
        total = sum(n for x, n in seen[k].items() if x[:-1] == g[:-1])
        own = {x: max(seen[k][x] - toxicity.DISCOUNT, 0) / total for x in known[k] if x[:-1] == g[:-1]}
        return own[g] + (1 - sum(own.values())) * below(g, k - 1)

    def probability(c, g):
        total = sum(n for x, n in grams[c].items() if x[:-1] == g[:-1])
        own = {x: max(n - toxicity.DISCOUNT, 0) / total for x, n in grams[c].items() if x[:-1] == g[:-1]}
        return own.get(g, 0) + (1 - sum(own.values())) * below(g, 6)

    for k, *got in zip(keys, *model.logs, strict=True):
        assert got == pytest.approx([math.log(probability(c, listed[int(k)])) for c in (0, 1)])
    a, b, d = words[0][0], words[1][0], words[0][1]
    pairs = {(a, b): (1, 6), (a, d): (3, 0), (b, a): (0, 2)}
    filling = [(c, f"{v} {w}") for (v, w), n in pairs.items() for c in (0, 1) for _ in range(n[c])]
    toxicity.add_pairs(model, spark.createDataFrame([*filling, (1, None), (0, "")], "toxic int, text string"))

    def less(n):
        return max(n - toxicity.DISCOUNT, 0)

    def after(c, v):
        """How often the class has a word after v, what its counts leave, and what the numbers of classes leave."""
        own = {w: n for (u, w), n in pairs.items() if u == v}
        total, types = sum(n[c] for n in own.values()), sum((n[0] > 0) + (n[1] > 0) for n in own.values())
        return total, types, 1 - sum(less(n[c]) for n in own.values()) / max(total, 1), 1 - sum(less((n[0] > 0) + (n[1] > 0)) for n in own.values()) / types

    def pair(c, v, w):
        n, (total, types, rest, left) = pairs[v, w], after(c, v)
        spelling = math.prod(probability(c, g) for g in spelt([w]))
        return less(n[c]) / max(total, 1) + rest * (less((n[0] > 0) + (n[1] > 0)) / types + left * spelling)

    want = {k: math.log(pair(1, *k) / pair(0, *k)) for k in pairs}
    before = {v: math.log(after(1, v)[2] / after(0, v)[2]) for v in (a, b)}
    own = dict(zip((a, b, "abc"), toxicity.spelling(model, [a, b, "abc"]), strict=True))
    mixed = lambda r: math.log(1 - toxicity.MIX + toxicity.MIX * math.exp(r))
    texts = [[a, b, a], [], [a, "abc", b], [b], [a, d]]
    told = [(mixed(own[a]) + mixed(want[a, b]) + mixed(want[b, a])) / 3, 0, (mixed(own[a]) + mixed(before[a] + own["abc"]) + mixed(own[b])) / 3, mixed(own[b]), (mixed(own[a]) + mixed(want[a, d])) / 2]
    for step in (1, 4, 1000):  # texts one by one, in steps, and all at once
        monkeypatch.setattr(toxicity, "STEP", step)
        assert toxicity.evidence(model, texts, toxicity.Met()) == pytest.approx(told, rel=1e-5)
    monkeypatch.setattr(toxicity, "HELD_WORDS", 0)
    met = toxicity.Met()
    assert [*toxicity.evidence(model, texts, met), *toxicity.evidence(model, texts, met)] == pytest.approx(told * 2, rel=1e-5)


def test_counts_of_the_corpus_equal_a_walk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abc"), rng.integers(1, 10))) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    some = sorted({w for t in texts[:10] for w in t.split()})
    grams_of = toxicity.shorter(np.unique(toxicity.grams(some)[0]))
    monkeypatch.setattr(toxicity, "SLICE", 50)
    counts, n = toxicity._shared_counts(docs, grams_of)
    distinct = sorted({w for t in texts for w in t.split()})
    assert n == len(distinct)
    every = toxicity.grams(distinct)[0]
    for k, (own, got) in enumerate(zip(grams_of, counts, strict=True)):
        want = Counter((every & np.uint64((1 << 8 * (k + 1)) - 1)).tolist())
        assert got.tolist() == [want[g] for g in own.tolist()]


def test_pairs_of_harmless_words(spark):
    """Two words that are ordinary alone and toxic together."""
    rng = np.random.default_rng(4)
    filler = [f"{a}{b}" for a in "klmn" for b in ("ar", "os", "it")]
    rows = []
    for i in range(1500):
        ws = list(rng.choice(filler, 12))
        at = int(rng.integers(1, 10))
        ws[at : at + 2] = ["green", "apple"] if i % 5 == 0 else ["apple", "green"]
        rows.append((i, " ".join(ws), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(docs, docs.select("doc_id", "toxic")).filter("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in got]) > 0.95


@pytest.mark.parametrize("learnt", [12, 60])
def test_expressions_of_a_few_documents(spark, learnt):
    """Words that stand side by side in a few toxic texts, and apart in as many others."""
    rng = np.random.default_rng(1)
    filler = [f"{a}{b}" for a in "klmnp" for b in ("ar", "os", "it", "un")]
    rows = []
    for i in range(learnt + 300):
        ws = list(rng.choice(filler, 12))
        ws[2], ws[3 if i % 2 else 8] = "blue", "river"
        rows.append((i, " ".join(ws), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.filter(f"doc_id < {learnt}").select("doc_id", "toxic")
    found, _ = toxicity.sample(docs, labels)
    assert learnt > 12 or found.filter("toxic = 1 and not calibrates").count() <= 5
    got = toxicity.toxicity(docs.drop("toxic"), labels).filter(f"doc_id >= {learnt}").collect()
    toxic, clean = (np.sort([r.evidence for r in got if r.doc_id % 2 == c]) for c in (1, 0))
    wins = (np.searchsorted(clean, toxic, "left") + np.searchsorted(clean, toxic, "right")).sum() / (2 * len(toxic) * len(clean))
    assert wins > (0.95 if learnt > 12 else 0.85)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, DATA).filter("held_out").collect()}
    truth = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect() if r.doc_id in got}
    assert all(crc32(str(i).encode()) % 5 == 0 for i in got)
    toxic = sorted(got[i].score for i, t in truth.items() if t == 1)
    clean = sorted(got[i].score for i, t in truth.items() if t == 0)
    wins = (np.searchsorted(clean, toxic, "left") + np.searchsorted(clean, toxic, "right")).sum() / (2 * len(toxic) * len(clean))
    assert wins > 0.93  # a few hundred toxic rows to learn from
    assert np.mean(np.array(toxic) >= 0.5) > 0.6 and np.mean(np.array(clean) >= 0.5) < 0.02


def test_odd_rows(spark):
    rows = [(i, "you utter scum" if i % 2 else "a calm sentence", 0.0) for i in range(200)] + [(None, "scum", 0.0), (7, None, 0.0), (7, "", 0.0), (8, "word " * 30000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(200)] + [(3, 0, "x"), (None, 1, "x"), (4, None, "x"), (5, 7, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id not in (None, 7, 8))
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
