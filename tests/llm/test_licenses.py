import random
import re

from tessella.llm import licenses


def brute(text):
    """Base places by a slow walk over the words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "!!!", "Released under the MIT License.", "CC-BY-NC cc by nc cc by nc", "CC BY NCx", "xcc by nc",
    "Apache License, Version 2.0. été under the\nmit  license İ", "under the mit license under the mit license",
    "apache license version 20", " cc by nc", "cc_by_nc " * 3000,
]


def test_base_places_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.doc_id: tuple(r)[1:6] for r in licenses.license_scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_expressions():
    labels = licenses.labels_of
    assert labels("MIT") == ["mit"]
    assert labels("MIT OR Apache-2.0 AND BSD") == ["mit", "apache-2.0+bsd"]
    assert labels("(MIT OR Apache-2.0) AND BSD") == ["(apache-2.0|mit)+bsd"]
    assert labels("GPL-2.0 WITH Classpath-exception-2.0 OR MIT") == ["gpl-2.0 with classpath-exception-2.0", "mit"]
    assert labels("MIT OR") == ["mit"] and labels("OR MIT") == [] and labels("") == [] and labels("(MIT") == []
    assert labels("MIT and the rest") == ["mit+the"] and labels("mit or mit") == ["mit"] and labels("(mit or mit) and mit") == ["mit"]
    assert labels("((a or b) or (c)) or b") == ["a", "b", "c"] and labels("a and (b and c) and (b or c)") == ["(b|c)+a+b+c"]
    assert labels("(a or b) with (c and d) or e") == ["(a|b) with (c+d)", "e"]


def satisfied(label, have):
    """Whether these licenses satisfy a label, by Python's own reading of it."""
    names = set(re.findall(r"[a-z0-9.-]+", label))
    said = re.sub(r"[a-z0-9.-]+", lambda m: f"({m[0] in have})", label).replace("|", " or ").replace("+", " and ")
    return bool(names) and eval(said)


def test_labels_mean_what_their_expressions_mean():
    """Random expressions: some label is satisfied by just those sets of licenses that satisfy the expression."""
    rng, names = random.Random(6), ["a", "b", "c", "d"]

    def some(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(names)
        return f"({some(depth - 1)} {rng.choice(['and', 'or'])} {some(depth - 1)})" + rng.choice(["", f" and {rng.choice(names)}", f" or {rng.choice(names)}"])

    for _ in range(300):
        said = some(3)
        found = licenses.labels_of(said)
        for k in range(16):
            have = {n for i, n in enumerate(names) if k >> i & 1}
            assert any(satisfied(x, have) for x in found) == eval(re.sub(r"\b[a-d]\b", lambda m: str(m[0] in have), said)), said


def test_labels_and_odd_tables(spark):
    texts = ["// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "GNU General Public License, version 3", "plain"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = [(r.labels, r.base_labels, r.score) for r in licenses.license_scan(docs).collect()]
    assert sorted(got) == sorted([("apache-2.0,mit", "", 1.0), ("gpl,gpl-3", "", 0.5), ("", "", 0.0)])
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_one_form_at_every_size():
    for n in (2, 6, 7, 64, 128):
        assert licenses.labels_of(" AND ".join(f"(a{i:03} OR b{i:03})" for i in range(n))) == ["+".join(f"(a{i:03}|b{i:03})" for i in range(n))]
        names = [f"n{i}" for i in range(n)]
        assert licenses.labels_of(" or ".join(names)) == names
    assert licenses.labels_of("x or ((a or b) and (c or d)) or x with y") == ["x", "(a|b)+(c|d)", "x with y"]
    assert len(licenses.labels_of(" or ".join(f"n{i}" for i in range(100_000)))) == 100_000


def test_long_expressions_take_one_pass(spark):
    text = "SPDX License Identifier: (" + "mit or " * 200_000
    docs = spark.createDataFrame([(1, text), (2, "spdx-license-identifier: (mit or bsd) and (x or"), (3, "spdx-license-identifier : mit\nSPDX-License-Identifier:zlib ")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(docs).collect()}
    assert got == {1: ("", 0.0), 2: ("bsd,mit", 1.0), 3: ("zlib", 1.0)}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:6] for r in licenses.op10_license_scan(spark, folder).collect()} == want
    assert any(w[1] for w in want.values())


def test_automaton_finds_what_ends_within_other_phrases():
    machine = licenses.automaton({p: p for p in ("a b c d", "b c", "c", "b c e")})
    assert sorted(machine.find(b"a b c e x a b c d c".split())) == sorted([(2, "b c"), (2, "c"), (3, "b c e"), (7, "b c"), (7, "c"), (8, "a b c d"), (9, "c")])
