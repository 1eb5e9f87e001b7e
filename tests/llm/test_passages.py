import hashlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import blocks, passages
from tessella.llm.common import table


def brute(docs, window=35):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(ws[k : k + window]) for _, ws in words for k in range(len(ws) - window + 1))
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - window + 1):
            if seen[tuple(ws[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out, key=str)


def test_least_places():
    rng = np.random.default_rng(0)
    for n, width in ((0, 3), (2, 3), (50, 1), (50, 24), (200, 35)):
        values = rng.integers(0, 9, n)
        want = [k + int(np.argmin(values[k : k + width])) for k in range(max(0, n - width + 1))]
        assert blocks.least_places(values, width).tolist() == want


@pytest.mark.parametrize("window, gram, block_bytes", [(35, 12, 1 << 20), (8, 3, 300)])
def test_small_corpora_equal_brute_force(spark, window, gram, block_bytes):
    rng = np.random.default_rng(window)
    draw = lambda n: list(rng.choice(list("abcdefghé"), n))
    shared = [draw(int(n)) for n in rng.integers(window - 2, 3 * window, 6)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "x " * 500), (None, "y\x0b" * 100)]
    for i in range(30):
        text = draw(20) + shared[i % 6] + draw(int(rng.integers(0, 90))) + shared[rng.integers(6)][: window + 3] + [" "]
        docs.append((10 + i, " ".join(text)))
    docs += docs[-2:]
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, kept string, block int")
    got = passages.unique_passages(frame, window, gram, block_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, window)
    assert passages.unique_passages(frame.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    want = sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(docs))
    assert sorted(map(tuple, passages.op5_passages(spark, folder).collect())) == want
    assert sum(r[2] for r in want) > 0


def test_words_decide_where_all_hashes_are_equal():
    """The classes of stretches with one seed, and the stretches of a block, under hashes that tell nothing."""
    rng = np.random.default_rng(2)
    window, gram = 7, 3
    for _ in range(200):
        texts, offsets, copies = [], [], []
        for _ in range(int(rng.integers(1, 9))):
            offset, after = int(rng.integers(0, window - gram + 1)), 0
            after = int(rng.integers(window - gram - offset, window - gram + 1))
            texts.append([*rng.choice([b"a", b"b"], offset), b"s", *rng.choice([b"t", b"u"], 1, p=[0.9, 0.1]), b"v", *rng.choice([b"a", b"b"], after)])
            offsets.append(offset)
            copies.append(int(rng.integers(1, 3)))
        distinct = dict.fromkeys(zip(map(tuple, texts), offsets))
        first = [next(i for i, (t, o) in enumerate(zip(texts, offsets)) if (tuple(t), o) == d) for d in distinct]
        texts, offsets, copies = [texts[i] for i in first], [offsets[i] for i in first], [copies[i] for i in first]
        got = passages.repeated_windows(texts, np.array(offsets), np.array(copies), window, gram)
        seen = Counter()
        for t, o, c in zip(texts, offsets, copies):
            for w in range(len(t) - window + 1):
                seen[(o - w, tuple(t[w : w + window]))] += c
        want = [[seen[(o - w, tuple(t[w : w + window]))] > 1 for w in range(len(t) - window + 1)] for t, o in zip(texts, offsets)]
        assert [g.tolist() for g in got] == want
    values = rng.integers(0, 2, 300)
    start, length = rng.integers(0, 280, 60), rng.integers(1, 6, 60)
    offset = rng.integers(0, 2, 60)
    stands, same = blocks.equal_stretches(values, start, length, offset, np.zeros(60, np.uint64))
    for i in range(60):
        for j in range(60):
            alike = offset[i] == offset[j] and values[start[i] : start[i] + length[i]].tolist() == values[start[j] : start[j] + length[j]].tolist()
            assert (same[i] == same[j]) == alike
    assert (same[stands] == np.arange(len(stands))).all()
