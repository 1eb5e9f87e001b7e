import hashlib

import numpy as np
import pytest

from tessella.llm import blocks, suffixes
from tessella.llm.common import table


def brute(docs, window=50):
    least = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    number = lambda i: (i is None, i or 0)
    for i, t in raw:
        for k in range(len(t) - window + 1):
            s = t[k : k + window]
            least[s] = min(least.get(s, (True, 1)), number(i))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if least[t[k : k + window]] < number(i):
                gone[k : k + window] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_order_and_classes_equal_brute_force():
    rng = np.random.default_rng(3)
    for size in (1, 2, 6, 30):
        parts = [bytes(rng.choice(list(b"ab\xff\x00"), rng.integers(4, 40))) for _ in range(size)]
        parts = list(dict.fromkeys(parts + [p[1:-1] + b"ab" for p in parts]))
        raw = np.concatenate([np.r_[np.frombuffer(p, np.uint8).astype(np.int64) + 1, 0] for p in parts])
        closing = np.flatnonzero(raw == 0)
        order = suffixes.suffix_order(raw, closing[np.searchsorted(closing, np.arange(len(raw)))])
        suffix = [tuple(raw[i : closing[np.searchsorted(closing, i)]] + len(parts)) + (int(np.searchsorted(closing, i)),) for i in range(len(raw))]
        assert order.tolist() == sorted(range(len(raw)), key=suffix.__getitem__)
        for least in (1, 2, 5, 9):
            got = suffixes.common_prefix_classes(raw, order, least)
            for k in range(1, len(order)):
                a, b = suffix[order[k - 1]], suffix[order[k]]
                assert (got[k] == got[k - 1]) == (a[:least] == b[:least] and min(len(a), len(b)) >= least and least <= min(len(a), len(b)) - 1)


@pytest.mark.parametrize("window, gram, block_bytes", [(50, 16, 1 << 20), (12, 5, 300)])
def test_small_corpora_equal_brute_force(spark, window, gram, block_bytes):
    rng = np.random.default_rng(window)
    draw = lambda n: "".join(rng.choice(list("abc dé"), n))
    shared = [draw(int(n)) for n in rng.integers(window - 2, 4 * window, 6)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "x" * 500), (8, "x" * 300), (None, "y" * 200), (None, "y" * 100)]
    for i in range(30):
        docs.append((100 - i, draw(20) + shared[i % 6] + draw(int(rng.integers(0, 90))) + shared[rng.integers(6)][: window + 3]))
    docs += docs[-3:] + [(7, docs[-1][1][3:-3])]
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, kept string, block int")
    got = [(*r[:4], hashlib.sha256(r.kept).hexdigest()) for r in suffixes.unique_bytes(frame, window, gram, block_bytes).collect()]
    assert sorted(got, key=str) == brute(docs, window)
    assert suffixes.unique_bytes(frame.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()])
    assert sorted(map(tuple, suffixes.op8_suffixes(spark, folder).collect()), key=str) == want
    assert sum(r[2] for r in want) > 0


def test_seeds_are_looked_up_once_each_not_for_every_window(monkeypatch):
    asked = []
    found = blocks.among
    monkeypatch.setattr(blocks, "among", lambda keys, wanted: asked.append(len(keys)) or found(keys, wanted))
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    own = blocks.Windows(raw, suffixes._VALUES[raw], np.array([3000, 20, 1980]), 50, 16)
    hits = np.sort(own.seed_keys()[::2])
    s = own.stretches(hits, 3)
    assert asked == [len(np.unique(own.seeds))] and asked[0] < len(own.starts) / 10
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(s["start"], s["n"], strict=True)])
    assert sorted(covered) == own.starts[np.isin(own.grams[own.seeds], hits)].tolist()
