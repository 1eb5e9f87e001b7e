"""Hand-made rows that no table of the data folders holds."""

import json
import math
from datetime import datetime
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessella.functions import normalize as nz
from tessella.functions import text as tx
from tessella.operators import aggregates as ag
from tessella.operators import joins, permutations, quality, ranking, resample, sets, vectors
from tessella.operators.products import block_pairs
from tessella.registry import ORACLES, QUERIES
from tessella.sources import records, sinks
from tests.compare import rows_of


def one(spark, *columns, **values):
    frame = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    row = frame.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_targets_and_aliases(spark):
    rows = spark.createDataFrame([("",), (" NaN ",), ("none",), ("inf",), ("1e3",), (None,), ("x",)], "t string")
    assert [r[0] for r in rows.select(nz.target(F.col("t"))).collect()] == [None, None, None, None, 1000.0, None, None]
    fields = F.create_map(F.lit("first"), F.lit("na"), F.lit("second"), F.lit("1.5"))
    assert one(spark, *nz.picked_target(fields, ["first", "second"])) == (None, "first")
    assert one(spark, *nz.picked_target(fields, ["absent", "second"])) == (1.5, "second")


def test_split_labels(spark):
    rows = spark.createDataFrame([(" Holdout ",), ("TR",), ("tst",), (None,)], "s string")
    assert [r[0] for r in rows.select(nz.canonical_split(F.col("s"))).collect()] == ["test", "train", None, None]
    assert [r[0] for r in rows.select(nz.canonical_split(F.col("s"), nz.BENCHMARK_SPLITS)).collect()] == [None, None, "test", None]
    with pytest.raises(Exception, match="unknown split label"):
        rows.select(nz.canonical_split(F.col("s"), strict=True)).collect()


def test_formula_family_and_validation_size(spark):
    for elements, formula in ((["O", "H", "C", "H"], "CH2O"), (["Ti", "O", "O"], "O2Ti")):
        assert one(spark, nz.hill_formula(F.array(*[F.lit(e) for e in elements]))) == formula
    for elements, want in ((["O", "N"], (True, False, True)), (["N"], (False, True, False)), (["O"], (True, False, False)), (["Fe"], (False, False, False))):
        flags = nz.family_flags(F.array(*[F.lit(e) for e in elements]))
        assert one(spark, flags["is_oxide"], flags["is_nitride"], flags["is_oxynitride"]) == want
    sizes = spark.createDataFrame([(n,) for n in (1, 5, 10, 50, 250, 1000)], "n int")
    assert [r[0] for r in sizes.select(nz.validation_size(F.col("n"))).collect()] == [1, 1, 5, 5, 25, 100]


def test_duplicates_keep_the_first_of_equals_and_the_better(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 1, 2), ("b", 2, 3), ("c", None, 4)], "k string, q int, at int")
    assert {r.k: r["at"] for r in ranking.best_of_key(rows, "k", ["q"], "at").collect()} == {"a": 0, "b": 3, "c": 4}
    assert {r.k: (r.extra, r.kept, r.seen, r.tied) for r in ranking.duplicate_report(rows, "k", ["q"], "at").collect()} == {"a": (1, 0, "0,1", True), "b": (1, 3, "2,3", False)}


def test_split_conflicts(spark):
    rows = spark.createDataFrame([("x", "train"), ("x", "test"), ("y", "val")], "id string, split string")
    splits, conflicts = resample.settled_split(rows, "id")
    assert [tuple(r) for r in splits.collect()] == [("y", "val")] and [tuple(r) for r in conflicts.collect()] == [("x", "test|train")]
    assert sorted(tuple(r) for r in resample.settled_split(rows, "id", "first")[0].collect()) == [("x", "train"), ("y", "val")]


def test_budgets_are_nested(spark):
    pool = spark.range(500).select(F.col("id").cast("string").alias("id"))
    small, large = (({r.id for r in resample.budget_subset(pool, "id", "1", n, 5).collect()}) for n in (50, 200))
    assert len(small) == 50 and len(large) == 200 and small < large


def test_bounds_ties_and_constant_targets(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3)], "g int, v double")
    assert [r.bucket for r in ranking.quantile_buckets(rows, ["g"], "v", [0.5]).orderBy("v").collect()] == [1, 1, 2]
    flat = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0)], "g int, target double, prediction double")
    assert ag.parity(flat, ["g"]).first().r2 is None
    tied = spark.createDataFrame([(1, e, v) for e, v in ((1, 3.0), (2, 1.0), (3, 1.0))], "run int, epoch int, loss double")
    found = ag.best_epoch(tied, ["run"]).first()
    assert (found.best_epoch, found.unique) == (2, False)
    assert ag.group_summary(flat.limit(1), ["g"], "target").first().sd is None


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(1, 1, 0.01), (1, 2, 0.04), (1, 3, 0.03), (1, 4, float("nan")), (1, 5, None)], "f int, i int, p double")
    got = {r.i: r.q for r in ranking.benjamini_hochberg(rows, ["f"], "p").collect()}
    assert {k: v and round(v, 9) for k, v in got.items()} == {1: 0.03, 2: 0.04, 3: 0.04, 4: None, 5: None}


def test_permutation_p_is_never_zero(spark):
    observed = spark.createDataFrame([(5.0,)], "stat double")
    stats = spark.range(9999).select(F.lit(0.0).alias("stat"))
    assert permutations.p_values(observed, stats, []).first().p == pytest.approx(1 / 10000)


def test_display_and_tolerance(spark):
    rows = spark.createDataFrame([("0.0341836", "0.0342"), ("0.0341836", "0.034"), ("5", "5"), ("5", "6"), ("a", "a"), ("0.05", "0.1"),
                                  ("5.4", "5"), ("12.3", "12"), ("0.4", "1e-3"), ("0.0014", "1e-3"), ("1234", "1.2e3"), ("1200", "1.2e3"), ("5.0", "5"), ("inf", "5"), (" a", "a ")], "a string, d string")
    assert [r[0] for r in rows.select(quality.matches_display(F.col("a"), F.col("d"))).collect()] == [True, True, True, False, True, True, False, False, False, True, False, True, True, False, True]
    some = spark.createDataFrame([("a", 3.0, 1.0), ("a", 2.0, 2.0)], "v string, x double, y double")
    assert quality.constant(some, "v", 2).first().value == "a" and quality.row_count(some).first().value == "2"
    assert quality.cell_difference(some, F.col("x") == 3, "x", "y").first().value == "2.0"
    assert one(spark, quality.array_length(F.lit('{"a": [1, [2], 3]}'), "/a")) == 3
    for column, n in (("v", 3), ("x", 2)):
        with pytest.raises(Exception, match="expected 3 rows, found 2|x is not constant"):
            quality.constant(some, column, n).collect()
    pairs = spark.createDataFrame([(1.0, 1.0 + 1e-11), (1.0, 1.1), (None, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pairs.select(quality.close(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    assert quality.contained("a/../b", "/r") and not quality.contained("../b", "/r") and not quality.contained("/rx/a", "/r")
    assert one(spark, quality.json_at(F.lit('{"a/b": [1, {"~": 2}]}'), "/a~1b/1/~0")) == "2"
    two = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="rows that match: 2"):
        quality.only_cell(two, F.col("k") == 1, "v").collect()


def test_histories(spark):
    texts = spark.createDataFrame([("[[1.0,0],[0.5,0]]",), ("[1.0,0.5]",)], "j string")
    assert [r[0] for r in texts.select(records.history_losses(F.col("j"))).collect()] == [[1.0, 0.5]] * 2
    with pytest.raises(Exception, match="empty history row"):
        spark.createDataFrame([("[[]]",)], "j string").select(records.history_losses(F.col("j"))).collect()


def test_spans_leftmost_longest_first_ranked(spark):
    terms = (("short", "distribution"), ("long", "out-of-distribution"), ("other", "out"))
    rows = spark.createDataFrame([(1, "An Out-of-Distribution test\nout, distribution"), (2, None), (3, "nothing")], "id int, t string")
    got = sorted((r.id, r.line_no, r.start, r.term, r.found) for r in tx.term_matches(rows, "t", terms).collect())
    assert got == [(1, 1, 3, "long", "Out-of-Distribution"), (1, 2, 0, "other", "out"), (1, 2, 5, "short", "distribution")]


def test_json_leaves(spark):
    value = {"a/b": {"x~y": [1, {"z": "deep"}]}, "c": True}
    rows = spark.createDataFrame([(1, json.dumps(value)), (2, None)], "id int, j string")
    assert sorted((r.pointer, r.value) for r in tx.json_leaves(rows, "j").collect()) == [("/a~1b/x~0y/0", "1"), ("/a~1b/x~0y/1/z", "deep"), ("/c", "true")]


def test_split_files_of_three_shapes(spark):
    texts = ['{"train": ["a", "b"], "test": ["c"]}', '{"a": "train", "c": "test", "b": "train"}', '[{"id": "a", "split": "val"}, {"jid": "b", "split": "train"}, {"id": "a", "split": "train"}, {"id": "c", "split": "test"}]']
    for t in texts:
        rows = spark.createDataFrame([(t,)], "t string")
        assert sorted(tuple(r) for r in records.last_entries(rows, records.split_entries(F.col("t"))).collect()) == [("a", "train"), ("b", "train"), ("c", "test")]


def test_split_files_that_are_wrong_or_odd(spark):
    def entries(t):
        return [tuple(r) for r in one(spark, records.split_entries(F.lit(t)))]

    assert entries('{"Train": ["a", 7], "note": "x", "HOLDOUT": ["b"], "val": []}') == [("a", "train"), ("7", "train"), ("b", "test")]
    assert entries('[{"material_id": " m ", "dataset_split": "training"}, {"jid": "", "id": "i", "split": null, "subset": "dev"}]') == [("m", "train"), ("i", "val")]
    for wrong in ('{"a": "bogus"}', '[{"id": "a", "split": "bogus"}]', '[{"split": "val"}]', '{"train": "a"}', '"train"', '[1]'):
        with pytest.raises(Exception, match="USER_RAISED|unknown split|no id|no list|neither"):
            entries(wrong)


def test_ids_in_all_forms(spark):
    forms = {
        '[["JVASP-1", 0.5], [{"name": "n"}]]': ["JVASP-1", "n"], '[{"file_id": 3}, {"id": null, "name": "x"}, "s", 4]': ["3", "x", "s", "4"],
        '{"ids": ["a"], "data": {"entries": ["b"]}}': ["a", "b"], '{"JVASP-1": 1, "other": 2}': ["JVASP-1", "other"], "null": [], "{}": [], "[]": [],
    }
    for text, want in forms.items():
        assert one(spark, records.ids_of(F.lit(text))) == want
    for wrong in ('[{"n": 1}]', "[[]]", "[[[1]]]", '"a"', "5", '{"ids": "a"}', '{"ids": {"ids": {"ids": []}}}'):
        with pytest.raises(Exception, match="no id in|no list of ids|nested too deep"):
            one(spark, records.ids_of(F.lit(wrong)))


def test_embedding_rows(spark):
    meta = spark.createDataFrame([("pool", "1", "a"), ("pool", "0", "b"), ("head", "0", "a")], "embedding_source string, embedding_index string, family string")
    matrix = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "embedding_index long, x array<double>")
    found = records.embedding_rows(meta, matrix, "pool", ["a", "b"])
    assert sorted((r.embedding_index, r.family, r.x) for r in found.collect()) == [(0, "b", [1.0]), (1, "a", [2.0])]
    for source, families, rows, why in (("none", ["a", "b"], matrix, "no rows"), ("head", ["a"], matrix, "another number"), ("pool", ["a"], matrix, "unknown family")):
        with pytest.raises(Exception, match=why):
            records.embedding_rows(meta, rows, source, families).collect()
    with pytest.raises(Exception, match="not contiguous"):
        records.embedding_rows(meta.filter("family = 'a'"), matrix, "pool", ["a"]).collect()


def test_all_terms(spark):
    texts = ["OOD penalty", "pre-trained on the oxides", "Zero\u2011shot state", "does not move", "mechanistically", "generalisable", "robustly; OOD", "drove inertial"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = sorted((r.i, r.term) for r in tx.term_matches(rows, "t").collect())
    want = ["ood_penalty", "oxide_pretrained", "zero_shot_state", "checkpoint_pinned", "causal_language", "generalization_language", "robustness_language"]
    assert got == sorted([*enumerate(want), (6, "ood")])


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Material_ID,Dataset_Split\n a ,training\nb,test\na,dev\n")
    assert sorted(tuple(r) for r in records.read_split_table(spark, str(tmp_path / "s.csv")).collect()) == [("a", "val"), ("b", "test")]
    for k, row in enumerate((",val", "c,bogus")):
        (tmp_path / f"w{k}.csv").write_text(f"id,split\n{row}\n")
        with pytest.raises(Exception, match="no id|unknown split"):
            records.read_split_table(spark, str(tmp_path / f"w{k}.csv")).collect()
    (tmp_path / "r.json").write_text('[{"id": "a", "n": 1}, {"id": "b"}]')
    assert records.read_json_array(spark, str(tmp_path / "r.json"), "id string, n int").count() == 2
    run = tmp_path / "results/protocol_1/oxide/N50_seed3/leaf"
    run.mkdir(parents=True)
    (run / "summary.json").write_text('{"mae": 0.5}')
    found = records.read_runs(spark, str(tmp_path / "results/*/*/*/leaf/summary.json"), "mae double").first()
    assert (found.protocol, found.family, found.n, found.seed, found.mae) == ("1", "oxide", 50, 3, 0.5)
    (tmp_path / "id_prop.csv").write_text("file,target\nPOSCAR-x.vasp,1.5\n")
    assert [tuple(r) for r in records.read_structure_list(spark, str(tmp_path / "id_prop.csv")).collect()] == [("POSCAR-x.vasp", 1.5)]
    (tmp_path / "d.md").write_text("intro\n## One\nbody\n## Two\n")
    assert [tuple(r) for r in records.read_sections(spark, str(tmp_path / "d.md")).collect()] == [("One", "body"), ("Two", "")]
    assert records.checksums(spark, str(tmp_path / "*.md")).first().bytes == 25


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan"), "x|y"), (2, 0.1, None)], "a int, b double, c string")
    out = str(tmp_path / "out")
    sinks.write_csv(rows, out, ["c", "a"])
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(rows, out, ["c", "a"])
    with pytest.raises(ValueError):
        sinks.write_csv(rows.limit(0), str(tmp_path / "none"), ["a"])
    assert [json.loads(r.json) for r in sinks.json_rows(rows).orderBy("json").collect()] == [{"a": 1, "b": None, "c": "x|y"}, {"a": 2, "b": 0.1, "c": None}]
    assert sinks.markdown_table(rows.select("a", "c")) == "| a | c |\n| --- | --- |\n| 1 | x\\|y |\n| 2 |  |"
    sinks.write_parquet(rows, str(tmp_path / "p"))
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.text(str(tmp_path / "j")).count() == 2


def test_cardinality(spark):
    left, right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, l string"), spark.createDataFrame([(1, "r")], "k int, r string")
    assert joins.checked_join(left, right, ["k"], "many_to_one").count() == 2
    with pytest.raises(ValueError):
        joins.checked_join(left, right, ["k"], "one_to_one")
    assert {r.provenance for r in joins.with_provenance(right, left.select("k").distinct(), ["k"]).collect()} == {"both"}


def test_blocks_of_neighbours_agree(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, i % 2, rng.normal(size=4).tolist()) for i in range(60)], "id long, family int, x array<double>")
    key = lambda r: (r.id, r["rank"])
    whole = sorted(joins.nearest(rows, rows, 3).collect(), key=key)
    assert sorted(joins.nearest(rows, rows, 3, limit=17).collect(), key=key) == whole
    a, b = (sorted((r.id, round(r.silhouette, 9)) for r in vectors.silhouette(rows, n).collect()) for n in (1000, 13))
    assert a == b


def test_mahalanobis_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    status, found = vectors.mahalanobis(rows.filter("id < 5"), rows)
    c = x - x.mean(axis=0)
    s = c.T @ c / 60
    mu = np.trace(s) / 4
    spread = ((s - mu * np.eye(4)) ** 2).sum()
    noise = min(spread, sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / 60**2)
    inverse = np.linalg.inv((1 - noise / spread) * s + noise / spread * mu * np.eye(4))
    want = [math.sqrt(v @ inverse @ v) for v in c[:5]]
    assert status == "ok" and [r.distance for r in found.orderBy("id").collect()] == pytest.approx(want)
    assert vectors.mahalanobis(rows, rows.filter("id < 19"))[0] == "skipped_reference_count_lt_5x_dim"
    with pytest.raises(ValueError):
        vectors.mahalanobis(rows, rows.filter("id < 19"), strict=True)


def test_components_and_scaling_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose([r.x for r in vectors.standardised(rows, rows).orderBy("id").collect()], z)
    scored, shares = vectors.principal_components(rows, rows)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert shares == pytest.approx((s**2 / (s**2).sum())[:2].tolist())
    assert np.allclose(np.abs([r.scores for r in scored.orderBy("id").collect()]), np.abs(z @ v[:2].T))


def test_sets(spark):
    a, b = (spark.createDataFrame([(v,) for v in vs], "k int") for vs in ((1, 2, 2), (2, 3)))
    r = sets.set_algebra(a, b, "k").first()
    assert (r.n_left, r.n_right, r.n_both, r.n_union, r.disjoint, r.equal) == (2, 2, 1, 3, False, False)
    assert sets.not_finite(spark.createDataFrame([(1.0, float("inf"))], "a double, b double"), ["a", "b"]).collect()[0]["column"] == "b"


def test_ranks_and_quantiles_by_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, float(v) if i % 17 else None) for g in ("a", "b", None) for i, v in enumerate(np.round(rng.exponential(size=300), 1 if g == "a" else 6))]
    frame = spark.createDataFrame(rows, "g string, i int, v double")
    for falling in (False, True):
        got = {(r.g, r.i): (r._rank, r._n) for r in ranking.ranked(frame, ["g"], "v", ["i"], falling).collect()}
        for g in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0) if not falling else (r[2] is None, -(r[2] or 0)))
            assert [got[g, r[1]] for r in own] == [(k, 300) for k in range(1, 301)]
    found = ag.quantiles(frame.filter("g is not null"), ["g"], "v", [0.1, 0.5, 0.95]).collect()
    for r in found:
        want = np.percentile([v for g, _, v in rows if g == r.g and v is not None], [10, 50, 95])
        assert (r.q10, r.q50, r.q95) == pytest.approx(tuple(want))
    assert ranking.ranked(frame.limit(0), ["g"], "v", ["i"]).count() == 0


def test_groups_are_compared_by_counts_and_places(spark):
    rows = [("same", s, i, str(i % 3)) for s in "ab" for i in range(50)] + [("order", s, i if s == "a" else 49 - i, str(i)) for s in "ab" for i in range(50)]
    rows += [("members", "a", 1, "x"), ("members", "b", 1, "y"), ("times", "a", 1, "x"), ("times", "a", 2, "x"), ("times", "b", 1, "x"), ("alone", "a", 1, "x"), ("other", "c", 1, "x")]
    rows += [(None, s, 1, None) for s in "ab"] + [("ties", s, 1, x) for s, xs in (("a", "pq"), ("b", "qp")) for x in xs]
    frame = spark.createDataFrame(rows, "g string, side string, at int, v string").repartition(4)
    got = {r.g: r.verdict for r in joins.compared_groups(frame, ["g"], "side", "a", "b", "v", ["at"]).collect()}
    assert got == {"same": "equal", "order": "order_differs", "members": "members_differ", "times": "members_differ", None: "equal", "ties": "equal"}
    assert joins.compared_groups(frame.limit(0), ["g"], "side", "a", "b", "v", ["at"]).count() == 0


def written(folder, spark, **tables):
    """The folder with these tables (rows, schema) and none of the others."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def beside_sql(spark, folder, name):
    """Rows of a query and of its SQL."""
    con = duckdb.connect()
    for path in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{path}/*.parquet'")
    got, found = QUERIES[name](spark, folder), con.execute(ORACLES[name])
    return rows_of(got.columns, got.collect()), rows_of([c[0] for c in found.description], found.fetchall())


def test_a_first_loss_of_zero_has_a_relative_loss(spark, tmp_path):
    losses = {0: (0.0, 2.0), 5: (4.0, 1.0), 10: (0.0, -1.0), 1: (0.0, 0.0), 6: (2.0, 1.0), 2: (8.0, 2.0)}
    rows = [(10 * u + i, datetime(2024, 1, 1, 0, i), u, "view", v) for u, vs in losses.items() for i, v in enumerate(vs)]
    folder = written(tmp_path, spark, events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))
    mine, theirs = beside_sql(spark, folder, "AG14")
    assert mine == theirs and len(mine) == 3


def test_terms_that_the_sql_does_not_name_are_not_counted(spark, tmp_path):
    html = '<title>Inert</title>\n<p class="x">ood, 12 domain shift; robust OOD 13</p>'
    folder = written(tmp_path / "units", spark, pages=([(1, html), (2, None)], "page_id long, html string"), events=([(7, '{"k": 14}'), (8, '{"k": null}')], "event_id long, props string"))
    mine, theirs = beside_sql(spark, folder, "TX1_units")
    assert mine == theirs and len(mine) == 5
    texts = [(1, "version OOD\nrobust \u017fignificant licen\u017fe"), (2, ""), (3, None)]
    mine, theirs = beside_sql(spark, written(tmp_path / "texts", spark, documents=([(1, "version OOD\nrobust domain shift, license"), (2, ""), (3, None)], "doc_id long, text string")), "TX1")
    assert mine == theirs and len(mine) == 16
    found = tx.term_matches(spark.createDataFrame(texts, "doc_id long, text string"), "text", tx.TERMS + (("license", "license"),))
    assert sorted(r.term for r in found.collect()) == ["license", "ood", "robustness_language", "significance_language"]


def test_blocks_that_meet_are_a_bounded_number(spark):
    """Before, 80 blocks of five rows met in 6,400 pairs, each of which sent rows on."""
    rows = spark.range(400).select("id", F.array(F.col("id").cast("double")).alias("x"))

    def met(a, b):
        return pa.table({"pairs": [a.num_rows * b.num_rows]})

    def summed(found):
        return pa.table({"pairs": [pc.sum(found["pairs"]).as_py()]})

    found = [r.pairs for r in block_pairs(rows, rows, met, "pairs long", summed, 5).collect()]
    assert sum(found) == 160_000 and len(found) < 2_000
    apart = joins.nearest(rows, rows, 3, limit=5)
    assert {(r.id, r["rank"]): r.ref_id for r in apart.filter("id in (0, 200, 399)").collect()} == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (200, 1): 199, (200, 2): 201, (200, 3): 198, (399, 1): 398, (399, 2): 397, (399, 3): 396}


def test_rows_are_ranked_and_compared_in_as_many_partitions_as_they_need(spark, monkeypatch):
    rows = [(g, s, i * 7 % 50, i) for g in range(6) for s in "ab" for i in range(50)]
    rows += [(6, s, i if s == "a" else 49 - i, i) for s in "ab" for i in range(50)]
    frame = spark.createDataFrame(rows, "g int, side string, v int, at int")
    monkeypatch.setattr(joins, "PART_ROWS", 40)
    found = joins.compared_groups(frame, ["g"], "side", "a", "b", "v", ["at"])
    assert {r.g: r.verdict for r in found.collect()} == {g: "equal" if g < 6 else "order_differs" for g in range(7)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3 and plan.count(f", {-(-len(rows) // 40)}") >= 3


def test_bootstrap_means_draw_all_replicates_of_the_study(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), i, "view" if i % 3 else "click", i * 7 % 10 / 2) for i in range(12)] + [(12, datetime(2024, 1, 1), 1, "view", None)]
    folder = written(tmp_path, spark, events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))
    mine, theirs = beside_sql(spark, folder, "RS7")
    assert mine == theirs and len(mine) == 2 and all(50_000 in r for r in mine)


def test_all_terms_of_all_lines_are_counted(spark, tmp_path):
    """Before, terms that the added line does not hold were looked for and thrown away, and those it holds were counted in no other line."""
    rows = [(1, "version OOD\nrobust domain shift, inert\nİNERT license; in distribution shift"), (2, "pre-trained on the oxidesé ſource domain gap zero‐shot state_ ood"), (3, ""), (4, None), (None, "licenses unpinned cauſal does not\nmove")]
    mine, theirs = beside_sql(spark, written(tmp_path, spark, documents=(rows, "doc_id long, text string")), "TX1")
    assert mine == theirs
    got = {(doc, term): (n, others) for doc, n, others, term in mine}
    assert got[1, "ood"] == (2, "domain_shift:1,in_distribution:1,inert:2") and got[1, "robustness_language"][0] == 3 and got[1, "license"][0] == 1
    assert got[2, "source_domain"] == (2, "") and got[2, "ood"][0] == 2 and got[None, "causal_language"] == (2, "") and got[3, "ood"] == (1, "") and (4, "ood") not in got


def test_neighbours_beside_brute_force(monkeypatch):
    """Ties, copies, vectors that are not finite, and values that single precision cannot tell apart or hold."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(joins, "FIRST", 8)
    monkeypatch.setattr(joins, "TILE", 16)
    for way in ("plain", "grid", "small", "great", "far off", "copies"):
        y = rng.integers(0, 2, (150, 4)).astype(float) if way == "grid" else rng.normal(size=(150, 4))
        y = {"small": y * 1e-30, "great": y * 1e20 + 5e20, "far off": y * 1e-6 + 1000}.get(way, y)
        if way == "copies":
            y[rng.random(150) < 0.5], y[3, 0], y[5, 1] = y[0], np.nan, np.inf
        x, code, own = np.concatenate([y[::3], np.ones((1, 4))]), rng.permutation(150) // 2, rng.integers(-1, 75, 51)
        line, found, far = joins.nearest_rows(x, own, y, code, 6, 20)
        want = []
        for i, row in enumerate(x):
            distance = np.sqrt(((row - y) ** 2).sum(axis=1))
            order = [n for n in np.lexsort((code, distance)) if code[n] != own[i] and np.isfinite(distance[n])]
            want += [(i, code[n], distance[n]) for n in order[:6]]
        assert list(zip(line, code[found], far, strict=True)) == want, way


def test_exact_products_are_not_taken_for_all_pairs(spark, monkeypatch):
    """Before, the least distances of every 2,000 by 2,000 rows were selected anew; now few pairs are looked at beyond one product."""
    seen, plain = [], joins._distances
    monkeypatch.setattr(joins, "_distances", lambda x, y, line, found: seen.append(len(line)) or plain(x, y, line, found))
    y = np.random.default_rng(1).normal(size=(20_000, 16))
    joins.nearest_rows(y[:200], np.arange(200), y, np.arange(20_000), 15, 100)
    assert 200 * 15 <= sum(seen) < 200 * 150
    rows = spark.range(40).select("id", F.array(F.col("id").cast("double")).alias("x"))
    assert joins.nearest(rows, rows, 3, limit=5).count() == 120
