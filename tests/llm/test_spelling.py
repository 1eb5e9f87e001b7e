import re
import zlib
from collections import Counter

from tessella.llm import spelling
from tests.compare import difference


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, one_in=199, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    form, out = {}, []
    for w in n:
        close = [v for v in n if near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out.append((w, len(close)))
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n[w], k, n[form[w]] if form[w] else None) for w, k in out), key=str)


WORDS = ["rivers", "riverss", "rivets", "reviers", "sriver", "river", "Rivers", "été-àprés", "àprésé", "àpréséÉ", "÷×aaaaa", "aaaaaaa", "aaaaaab", "aaaaaaaa", "banana", "bananas", "bandana", "Üxyzabc", "üxyzabc"]


def test_equals_brute_force(spark):
    rows = [(i % 50 if i % 13 else None, " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 2 + i % 9)) + "\n123_") for i in range(900)]
    rows += [(7, None), (8, ""), (9, "a" * 100_000), (10, "rivers " * 900), (10, "rivers " * 900), (11, "verylong" * 3000), *[(i, "verylong" * 2999 + "verilong") for i in range(5)]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    for one_in in (199, 3):
        got = spelling.spelling_variants(docs, one_in=one_in)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, one_in)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chains_of_forms(spark):
    counts = {"aaaaaa": 100_000, "aaaaab": 9_000, "aaaabb": 800, "aaabbb": 70, "aabbbb": 6, "zzzzzz": 9}
    docs = spark.createDataFrame([(1, f"{w} " * n) for w, n in counts.items()], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(docs, one_in=1 << 40).collect()}
    assert got["aabbbb"] == ("aaabbb", "aaaaaa") and got["aaaaab"] == ("aaaaaa", "aaaaaa") and got["zzzzzz"] == (None, "zzzzzz")


def test_sql(spark):
    assert difference(spark, "op13", spelling.op13_spelling, spelling.spelling_sql(), "/root/testdata/sf0.001") is None
