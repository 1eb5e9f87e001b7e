import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessella.llm import lines


def brute(docs):
    """Kept texts by comparing every line with every earlier one."""
    flat = []
    for doc, text in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0])):
        for k, raw in enumerate(text.split("\n")):
            ws = raw.replace("\t", " ").split()
            if ws:
                s = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else None
                flat.append((doc, k, " ".join(ws), s))
    gone = set()
    for i, (doc, k, line, s) in enumerate(flat):
        for d0, k0, line0, s0 in flat[:i]:
            if line == line0 or (s and s0 and 5 * len(s & s0) >= 4 * len(s | s0)):
                gone.add((doc, k))
                break
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}


def corpus():
    rng = np.random.default_rng(4)
    base = [list(rng.choice([f"w{i}" for i in range(500)], n)) for n in (3, 5, 9, 40, 60, 80, 120)]
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, "one\none\n one \ntwo")]
    for i in range(40):
        own = []
        for line in base:
            line = list(line)
            for _ in range(rng.integers(0, 4)):
                line[rng.integers(len(line))] = f"x{rng.integers(1000)}"
            own.append(" ".join(line) if i % 2 else "\t".join(line))
        docs.append((10 + i, "\n".join(own)))
    docs.append((None, docs[-1][1] + "\nlast one"))
    return docs


def test_lines_equal_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, line string, n_chars int")
    out = lines.dedup_lines(frame)
    assert out.columns == frame.columns and out.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    assert {r.doc_id: r.text for r in out.collect()} == brute(docs)


def test_fetching_by_shuffle_gives_the_same(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    whole = sorted(map(tuple, lines.line_report(frame).collect()), key=str)
    monkeypatch.setattr(lines.removed_lines, "__defaults__", (0,))
    assert sorted(map(tuple, lines.line_report(frame).collect()), key=str) == whole


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(lines.line_sql())
    got = lines.op1_line_dedup(spark, folder)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).count() == 0 and lines.line_report(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "z " * 30000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(twice).collect())
    assert got == [(0, ""), (1, "a b c d e f"), (1, "a b c d e f"), (2, "z " * 30000)]


def test_columns_that_clash_and_many_lines(spark):
    text = "\n".join(f"w{i % 50} b{i}" for i in range(20_000)) + "\nw1 b1"
    frame = spark.createDataFrame([(1, text, "a", 1, 2), (2, "w1 b1\nnew", None, 3, 4)], "doc_id long, text string, _doc string, _Removed int, _hash int")
    got = lines.dedup_lines(frame)
    assert got.columns == frame.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: text[: -len("\nw1 b1")], 2: "new"}


def test_a_token_is_one_hash_of_five_words(spark):
    words = "a b c d e f a b c d e".split()
    hashes = [F.xxhash64(F.lit(w)) for w in words]
    rows = spark.createDataFrame([(" ".join(words),), ("a b c d",)], "line string")
    want = F.array_sort(F.array_distinct(F.array(*[F.xxhash64(*hashes[i : i + 5]) for i in range(len(words) - 4)])))
    got = [r[0] for r in rows.select(lines.tokens(F.col("line"))).collect()]
    assert got == [rows.select(want).first()[0], []] and len(got[0]) == 6  # the first five words stand twice


def passed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    return {r.id for r in lines.screened(rows).collect()}


def test_a_phrase_in_common_does_not_pass_the_screen(spark):
    assert passed(spark, [f"p{i % 20} q r s t a{i} b{i} c{i}" for i in range(200)]) == set()  # one shingle of four
    near = ["a b c d e f g h i j k l m n o p q r s t u v w x y z " + x for x in ("1", "2")]
    assert passed(spark, [*near, near[0].replace("z", "_") + " 3 4 5 6 7 8"]) >= {0, 1}


def test_the_screen_keeps_every_pair_at_the_bound(spark):
    rng = np.random.default_rng(7)
    texts, pairs = [], []
    for common in (1, 2, 3, 4, 5, 8, 12, 16, 20, 36, 40, 80):  # shingles that both have; all others differ
        for extra in range(common // 4 + 1):
            for _ in range(3):
                body = [f"w{rng.integers(1 << 40)}" for _ in range(common + 4)]
                more = [f"x{rng.integers(1 << 40)}" for _ in range(common // 4)]
                pairs.append((len(texts), len(texts) + 1))
                texts += [" ".join(more[:extra] + body), " ".join(body + more[extra:])]
    kept = passed(spark, texts)
    assert all({i, j} <= kept or texts[i] == texts[j] for i, j in pairs)
