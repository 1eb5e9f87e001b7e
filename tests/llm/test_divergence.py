import re
from collections import Counter, defaultdict

from tessella.llm import divergence
from tessella.llm.words import WIDE, bytes_of, pieces
from tests.compare import connection, rows_of

import numpy as np
import pyarrow as pa


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    held = Counter((lang, t) for lang, _, words in docs for t in set(words))
    own, whole = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        kept = [t for t in words if held[lang, t] >= min_docs]
        own[lang, source].update(kept)
        whole[lang].update(kept)
    found = []
    for (lang, source), counts in own.items():
        terms = sorted(whole[lang])
        price = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms))
        pairs = [(-sum(abs(price(counts, t) - price(c, t)) for t in terms), s.encode(), s) for (x, s), c in own.items() if x == lang and s != source]
        own_terms = [(price(whole[lang], t) - price(counts, t), t.encode(), t) for t in terms if counts[t] and price(counts, t) > price(whole[lang], t)]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(own_terms)[:top])):
            found += [(lang, source, part, item, -value, i) for i, (value, _, item) in enumerate(items, 1)]
    return sorted(found)


ROWS = (
    [("en", f"s{i % 7}", f"river Stone{i % 3} été İx café{i % 5} river") for i in range(60)]
    + [("en", "hot", "river mill mill 12 a-b")] * 40
    + [("en", "none", "?!"), ("en", None, None), (None, None, "river"), ("fr", "s1", "mot"), ("fr", "s2", ""), ("en", "long", "river mill " * 30_000)]
)


def test_equals_brute_force_in_blocks_and_tiles(spark):
    docs = spark.createDataFrame([(1, *r, "x") for r in ROWS], "doc_id long, lang string, source string, text string, value string")
    want = brute(ROWS, 5, 3)
    assert {(r[0], r[1]) for r in want if r[2] == "pair"} >= {("en", "none"), ("en", ""), ("fr", "s1")}
    got = divergence.divergence(docs, 5, 3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, divergence.divergence(docs, 5, 3, block_postings=7, tile_sources=3).collect())) == want
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_many_occurrences_stay_exact(spark):
    big = 3 * 10**9  # times the unit this passes 64 bits
    price = spark.range(1).select(divergence._price(divergence.F.lit(big * 7), divergence.F.lit(big * 7 + 11))).first()[0]
    assert price == 1 + 10**9 * (big * 7 + 5) // (big * 7 + 11)


def test_sql_and_pieces(spark):
    folder = "/root/testdata/sf0.001"
    found = connection(folder).execute(divergence.divergence_sql())
    df = divergence.op11_divergence(spark, folder)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in found.description], found.fetchall())
    texts = pa.array(["one two three", None, "four " * 50, "", "x" * 70 + " y"])
    data, begins = bytes_of(texts)
    parts = list(pieces(data, begins, lambda x: ~WIDE[x], 20))
    assert b"".join(p.tobytes() for p, _, _ in parts) == data.tobytes()
    assert [i for _, _, rows in parts for i in sorted(set(rows))][:2] == [0, 1] and all(len(p) <= 20 for p, _, rows in parts if rows[0] == 2)
    assert np.array([len(p) for p, _, rows in parts if rows[0] == 4]).tolist() == [70, 2]
