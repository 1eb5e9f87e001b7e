from itertools import combinations

import numpy as np

from tessella.llm import decontaminate as dc
from tessella.llm.common import table

DATA = "/root/testdata/sf0.001"


def brute_overlap(same):
    best = (0, 0, 0)
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            if same[a] and same[b - 1] and same[a:b].sum() >= dc.MIN_SAME * (b - a) - 1e-6 and b - a > best[0]:
                best = (b - a, a, b)
    return best[0]


def test_longest_overlap_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 5, *range(10, 60)]:
        same = rng.random(n) < rng.choice([0.2, 0.6, 0.8, 0.95])
        a, b = dc.longest_overlap(same)
        assert b - a == brute_overlap(same)


def brute(docs, items):
    out = {}
    for d, t in docs:
        ws = dc.words(t.encode() if t else None)
        for i, item in items:
            own = dc.words(item.encode() if item else None)
            most = 0
            for shift in range(1 - len(own), len(ws)):
                low, high = max(0, shift), min(len(ws), shift + len(own))
                same = np.array([ws[k] == own[k - shift] for k in range(low, high)], bool)
                if same.sum() >= 6:
                    a, b = dc.longest_overlap(same)
                    most = max(most, b - a)
            if own and most >= min(dc.MIN_WORDS, len(own)):
                out[d, i] = most
    return out


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(14, 50)))) for i in range(8)] + [(8, None), (9, ""), (10, "w1 w2")]
    docs = [(0, None), (1, ""), (2, "w5"), (3, " ".join(rng.choice(vocabulary, 3000)))]
    for k in range(24):
        item = items[k % 8][1].split()
        for _ in range(k // 8):
            item[rng.integers(len(item))] = "other"
        text = list(rng.choice(vocabulary, 40))
        docs.append((10 + k, " ".join(text[:20]) + ". " + ", ".join(item).upper() + " -- " + " ".join(text[20:])))
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.n_words for r in dc.contamination(frame, bench).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[k] == want[k] for k in got)
    parts = {(r.doc_id, r.item_id): r.n_words for r in dc.contamination(frame, bench, part_words=60).collect()}
    assert parts == got
    kept = dc.keep_clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in got})
    assert dc.contamination(frame, bench.limit(0)).count() == 0 and dc.contamination(frame.limit(0), bench).count() == 0
    assert dc.keep_clean(frame, bench.limit(0)).count() == len(docs)


def test_items_that_stand_in_documents_whole_are_found(spark):
    docs, bench = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    got = {(r.doc_id, r.item_id) for r in dc.contamination(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in (r.text or "")}
    assert want and want <= got


def test_every_pattern_of_short_items_and_of_15_words_is_found():
    for n in [*range(1, dc.MIN_WORDS), 15]:
        item = [f"w{i}" for i in range(n)]
        found = dc.index([(7, " ".join(item).encode())])
        for k in range(n // 5 + 1):
            for places in combinations(range(1, n - 1), k):
                text = ["x", *("other" if i in places else w for i, w in enumerate(item)), "y"]
                assert dc.overlaps(found, [" ".join(text).encode()]) == [(0, 0, n, n - k, 1, 0)]
        assert dc.overlaps(found, [b"", b"x y", " ".join(item[1:]).encode()]) == ([] if n < 15 else [(2, 0, 14, 14, 0, 1)])


def test_longest_overlap_ends_with_equal_words_before_it_is_chosen():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        same = rng.random(rng.integers(1, 25)) < 0.65
        a, b = dc.longest_overlap(same)
        assert b - a == brute_overlap(same)
