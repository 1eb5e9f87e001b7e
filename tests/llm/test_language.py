import math
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tessella.llm import language
from tessella.llm.common import table

DATA = "/root/testdata/sf0.001"


def tree_bits(train, text, order=3):
    """Code length of text by walking a dictionary of contexts, as the definition says."""
    seen = defaultdict(Counter)
    for t in train:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k : i]][t[i]] += 1
    text, total = b"\n" * order + text, 0.0
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            context = seen.get(text[i - k : i]) if k else seen.get(b"")
            if not context:
                continue
            whole = sum(context.values()) + len(context)
            if text[i] in context:
                total -= math.log2(context[text[i]] / whole)
                break
            total -= math.log2(len(context) / whole)
        else:
            total += 8
    return total


def test_flattened_tables_give_the_trees_code_lengths(spark):
    train = {"a": [b"the cat sat on the mat", b"a hat"], "b": ["le chat était là".encode(), b"la la"]}
    rows = [(x, t.decode()) for x, ts in train.items() for t in ts]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    texts = [b"the chat sat", b"zzz", "là-bas \x00 hat".encode(), b"t", b"the the the la la cat"]
    got = language.text_bits(model, texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert got[i, j] == pytest.approx(tree_bits(train[lang], t))


def test_held_out_accuracy(spark):
    docs = table(spark, DATA, "documents")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [r for r in docs.collect() if crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and len(got) == docs.count()
    assert all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    rows = [(1, "hello there", "en", 1), (1, "hello there", "en", 1), (3, None, "en", 2), (4, "", None, 3), (5, "12 !", "en", 4), (None, "bonjour toi", "fr", 5), (9, "bonjour toi " * 20000, "fr", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = language.identify(docs).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} <= {"und"}
