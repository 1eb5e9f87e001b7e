import numpy as np
import pytest
import xxhash

from tessella.llm import simhash


def brute(rows, radius=3):
    fps = [(i, simhash.fingerprint((t or "").encode())) for i, t in rows]
    label = {i: i for i, _ in fps}
    for _ in range(len(fps)):
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return sorted((i, f"{a:016x}", label[i]) for i, a in fps)


def test_fingerprint_is_the_majority_of_xxh64():
    words = [f"w{i}" for i in range(9)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(7)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 3.5)
    assert simhash.fingerprint(" \t".join(words).upper().encode()) == want
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint("É a b".encode()) == xxhash.xxh64_intdigest("É a b", 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs_equal_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.array([int(base[rng.integers(12)]) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for _ in range(300)], np.uint64)
    ends = np.r_[np.full(7, 7), np.full(143, 150), np.full(150, 300)]
    i, j = (np.concatenate(x) for x in zip(*simhash.near_pairs(fps, ends, radius)))
    want = {(a, b) for a in range(300) for b in range(a + 1, ends[a]) if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, "one"), (3, "one"), (4, "one two"), (5, "x " * 5000)]
    for g in range(12):
        text = [f"t{rng.integers(400)}" for _ in range(150)]
        for k in range(5):
            near = list(text)
            for _ in range(k):
                near[rng.integers(150)] = "changed"
            rows.append((10 + 5 * g + k, " ".join(near)))
    rows.append((9, rows[-1][1]))
    docs = spark.createDataFrame([(i, t, "n", "c") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted(map(tuple, simhash.simhash_groups(docs).collect()))
    assert got == brute(rows)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {c for _, _, c in got}


def test_split_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    fps = [1 << 40] + sorted({int(1 << 40) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 16, (60, 2))} - {1 << 40})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = simhash.components(simhash.links(frame), "a", "b")
    split = simhash.components(simhash.links(frame, chunk=7), "a", "b")
    assert sorted(whole.collect()) == sorted(split.collect()) and whole.count() == len(fps) - 1


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, None)], "doc_id long, text string")
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == 4 and {r.component_id for r in got if r.fingerprint != "0" * 16} == {7}
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {None}


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "b b b b"), (5, "a a a a"), (7, "a a a a"), (5, "b b b b"), (None, "c c c c"), (None, "c c c c"), (9, None), (8, " ")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, _key string, _mark int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "b b b b"), (5, "a a a a"), (None, "c c c c"), (8, " ")], key=str)


def test_many_close_fingerprints_link_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(24, 2)) for _ in range(400)], np.uint64))
    whole = simhash._roots(len(fps), simhash.near_pairs(fps, np.full(len(fps), len(fps))))
    monkeypatch.setattr(simhash, "STEP", 3)
    assert (simhash._roots(len(fps), simhash.near_pairs(fps, np.full(len(fps), len(fps)))) == whole).all() and not whole.any()
