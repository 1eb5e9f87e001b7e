import importlib

import pytest

from tessella.llm import decontaminate, language, mixing, simhash
from tessella.llm.common import table
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute as brute_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_brute_force_keeps(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    docs = stage["language"](spark, docs, DATA)
    model = language.learn(language.sample(table(spark, DATA, "documents")))
    found = dict(zip(rows, zip(*language.predict(model, [r.text for r in rows.values()])), strict=True))
    left = {d: rows[d].text for d, (lang, score) in found.items() if lang != "und" and score >= language.MIN_SCORE}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == left
    assert len(left) > 0.9 * len(rows)

    docs = spark.createDataFrame(stage["lines"](spark, docs, DATA).collect(), docs.schema)
    left = brute_lines(sorted(left.items()))
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == left

    docs = spark.createDataFrame(stage["near_duplicates"](spark, docs, DATA).collect(), docs.schema)
    left = {d: left[d] for d, _, c in brute_groups(sorted(left.items())) if d == c}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == left

    docs = spark.createDataFrame(stage["decontaminate"](spark, docs, DATA).collect(), docs.schema)
    index = decontaminate.index([(r.item_id, r.text.encode()) for r in table(spark, DATA, "benchmark").collect()])
    left = {d: t for d, t in left.items() if not decontaminate.overlaps(index, [t.encode()])}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == left

    mixed = stage["mixture"](spark, docs, DATA)
    assert mixed.columns == [*columns, "mix_epoch", "mix_block", "mix_order"]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_run_is_the_registered_query(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and simhash.simhash_groups(out.dropDuplicates(["doc_id"])).filter("doc_id <> component_id").count() == 0


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, an empty table."""
    text = "the quick brown fox jumps over the lazy dog and runs away into the forest"
    rows = [(i, f"{text} {i} w{i} x{i * 7}\nline {i}", "en", "s", 1) for i in range(40)]
    rows += [(None, None, None, None, None), (None, "", "en", None, None), (7, "²½", None, "s", 1), (50, "word " * 200_000, "en", "t", 3), (51, text, None, None, None), (51, text, None, None, None)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, _removed int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, DATA)
            assert out.columns[: len(docs.columns)] == docs.columns
            kept = out.collect()
            if name != "mixture":
                frame = spark.createDataFrame(kept, docs.schema)
        if frame.isEmpty():
            assert not kept
        else:
            assert {50, 51} <= {r.doc_id for r in kept} and None not in {r.doc_id for r in kept}
