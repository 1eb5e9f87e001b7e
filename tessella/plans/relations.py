"""Join, ranking, sorting and set queries (JN, WN, SO, ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import aggregates as ag
from tessella.operators import distribution, joins, ranking, sets
from tessella.plans.aggregates import rounded
from tessella.plans.base import HISTORIES, PREDICTIONS, RUNS, VECTORS, baselines, documents, histories, predictions, query, runs, table, vectors

SUMMARY = "s AS (SELECT family, n, avg(mae) AS m FROM runs GROUP BY 1, 2)"


def summary(spark, d):
    return runs(spark, d).groupBy("family", "n").agg(F.avg("mae").alias("m"))


@query("JN1", f"WITH {RUNS}, {SUMMARY} SELECT family, n, round(m, 4) AS m, zero_shot FROM s LEFT JOIN zero USING (family)")
def lookup(spark, d):
    return rounded(summary(spark, d).join(F.broadcast(baselines(spark, d)), "family", "left"), 4, "m")


@query("JN2", f"WITH {RUNS}, {SUMMARY}, t AS (SELECT family, n, count(*) AS scratch FROM runs WHERE seed < 2 AND n < '4' GROUP BY 1, 2) SELECT family, n, scratch, scratch IS NOT NULL AS supported FROM s LEFT JOIN t USING (family, n)")
def support(spark, d):
    scratch = runs(spark, d).filter("seed < 2 and n < '4'").groupBy("family", "n").agg(F.count("*").alias("scratch"))
    return joins.with_support(summary(spark, d).drop("m"), scratch, ["family", "n"])


@query("JN3", f"WITH {RUNS} SELECT a.family, a.n, round(a.mae, 4) AS mae_tuned, round(b.mae, 4) AS mae_scratch FROM runs a JOIN runs b ON a.family = b.family AND a.n = b.n WHERE a.seed = 0 AND b.seed = 1")
def composite(spark, d):
    all_runs = runs(spark, d)
    tuned = all_runs.filter("seed = 0").select("family", "n", F.col("mae").alias("mae_tuned"))
    scratch = all_runs.filter("seed = 1").select("family", "n", F.col("mae").alias("mae_scratch"))
    return joins.checked_join(tuned, scratch, ["family", "n"], "one_to_one")


@query("JN4", """WITH e AS (SELECT user_id AS id, event_type AS seed, value FROM events), k AS (SELECT count(DISTINCT seed) AS k FROM e)
SELECT id, count(*) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd FROM e GROUP BY id HAVING count(DISTINCT seed) = (SELECT k FROM k)""")
def seed_tables(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("seed"), "value")
    return rounded(joins.seed_tables(rows, ["id"], "seed", "value"), 8, "mean", "sd")


@query("JN5", """SELECT coalesce(o.o_custkey, c.c_custkey) AS custkey, CASE WHEN c_custkey IS NULL THEN 'left_only' WHEN n IS NULL THEN 'right_only' ELSE 'both' END AS provenance, n
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
def provenance(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    rich = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return joins.with_provenance(orders, rich, ["custkey"])


@query("JN6", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def many_to_one(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "custkey")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return joins.checked_join(orders, customers, ["custkey"], "many_to_one").select("o_orderkey", "c_mktsegment")


@query("JN7", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def semi(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(done, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("JN8", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


BUCKET = "('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 10"


@query("JN9", f"""WITH b AS (SELECT md5(text) AS k, {BUCKET} AS b FROM documents), tr AS (SELECT DISTINCT k FROM b WHERE b < 8), te AS (SELECT DISTINCT k FROM b WHERE b = 9)
SELECT count(tr.k) AS n_overlap, count(*) AS n_right, round(100.0::DOUBLE * count(tr.k) / count(*), 8) AS percent FROM te LEFT JOIN tr ON te.k = tr.k""")
def overlap(spark, d):
    docs = documents(spark, d).select(F.md5("text").alias("k"), (ranking.hash_draw("42", F.col("doc_id").cast("string")) % 10).alias("b"))
    return rounded(joins.overlap(docs.filter("b < 8"), docs.filter("b = 9"), "k"), 8, "percent")


@query("JN10", """WITH a AS (SELECT user_id, event_type AS seed, avg(value) AS error, count(*)::DOUBLE AS target FROM events GROUP BY 1, 2), b AS (SELECT user_id, median(value) AS error, round(count(*) / 5.0)::DOUBLE AS target FROM events GROUP BY 1)
SELECT seed, count(*) AS pairs, count(*) FILTER (a.error < b.error) AS better FROM a JOIN b USING (user_id) WHERE abs(a.target - b.target) <= 3 GROUP BY 1""")
def paired(spark, d):
    events = table(spark, d, "events")
    tuned = distribution.means(events.select("user_id", F.col("event_type").alias("seed"), "value"), ["user_id", "seed"], "value")  # a mean may tie with the median
    tuned = tuned.select("user_id", "seed", F.col("mean").alias("error"), F.col("n").cast("double").alias("target"))
    zero = events.groupBy("user_id").agg(F.median("value").alias("error"), F.round(F.count("*") / 5.0).alias("target"))
    return joins.paired(tuned, zero, "user_id", 3.0).groupBy("seed").agg(F.count("*").alias("pairs"), F.count_if("better").alias("better"))


@query("JN11", "SELECT l_returnflag, n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def dictionary(spark, d):
    suppliers = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return table(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_returnflag", "n_name").agg(F.count("*").alias("n"))


@query("JN12", f"""WITH {VECTORS}, p AS (SELECT q.id, r.id AS ref_id, sqrt(list_sum(list_transform(list_zip(q.x, r.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM vecs q JOIN vecs r ON q.label > 7 AND r.label <= 7)
SELECT id, "rank"::INTEGER AS "rank", ref_id, round(distance, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, ref_id) AS "rank" FROM p) WHERE "rank" <= 5""")
def nearest(spark, d):
    rows = vectors(spark, d)
    return rounded(joins.nearest(rows.filter("label > 7"), rows.filter("label <= 7"), 5), 8, "distance")


@query("JN13", """WITH s AS (SELECT l_suppkey, l_linestatus, list(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey, CASE WHEN a.items = b.items THEN 'equal' WHEN list_sort(a.items) = list_sort(b.items) THEN 'order_differs' ELSE 'members_differ' END AS verdict
FROM s a JOIN s b USING (l_suppkey) WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O'""")
def compared_groups(spark, d):
    return joins.compared_groups(table(spark, d, "lineitem"), ["l_suppkey"], "l_linestatus", "F", "O", "l_partkey", ["l_orderkey", "l_linenumber"])


QUALITY = "q AS (SELECT md5(text) AS k, doc_id, (l.doc_id IS NOT NULL)::INTEGER AS labelled, n_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))"


def quality_rows(spark, d):
    labels = table(spark, d, "labels").select("doc_id").distinct()
    return joins.with_support(documents(spark, d), labels, ["doc_id"]).select(F.md5("text").alias("k"), "doc_id", F.col("supported").cast("int").alias("labelled"), "n_chars")


@query("WN1", "WITH q AS (SELECT md5(text) AS k, d.doc_id, (l.doc_id IS NOT NULL)::INTEGER AS labelled, n_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) SELECT k, doc_id, labelled, n_chars FROM q QUALIFY row_number() OVER (PARTITION BY k ORDER BY labelled DESC, n_chars DESC, doc_id) = 1")
def best_of_key(spark, d):
    return ranking.best_of_key(quality_rows(spark, d), "k", ["labelled", "n_chars"], "doc_id")


@query("WN2", """WITH q AS (SELECT md5(text) AS k, d.doc_id, (l.doc_id IS NOT NULL)::INTEGER AS labelled, n_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)
SELECT k, count(*) - 1 AS extra, arg_max(doc_id, (labelled, n_chars, -doc_id)) AS kept, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS seen, min((labelled, n_chars)) = max((labelled, n_chars)) AS tied FROM q GROUP BY 1 HAVING count(*) > 1""")
def duplicate_report(spark, d):
    return ranking.duplicate_report(quality_rows(spark, d), "k", ["labelled", "n_chars"], "doc_id")


@query("WN3", """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, ceil(0.2 * count(*) OVER (PARTITION BY event_type)) AS c, count(*) OVER (PARTITION BY event_type) AS m FROM events)
SELECT event_id, CASE WHEN k <= c THEN 'easy' WHEN k > m - c THEN 'hard' ELSE 'middle' END AS band FROM r""")
def bands(spark, d):
    return ranking.bands(table(spark, d, "events"), ["event_type"], "value", "event_id").select("event_id", "band")


@query("WN4", f"""WITH {PREDICTIONS}, named AS (SELECT nullif(family, 'N') AS family, target FROM preds), b AS (SELECT family, quantile_cont(target, 0.25) AS t1, quantile_cont(target, 0.5) AS t2, quantile_cont(target, 0.75) AS t3 FROM named GROUP BY 1)
SELECT b.family, CASE WHEN target <= t1 THEN 1 WHEN target <= t2 THEN 2 WHEN target <= t3 THEN 3 ELSE 4 END::INTEGER AS bucket, count(*) AS n, max(target) AS high FROM named a JOIN b ON a.family IS NOT DISTINCT FROM b.family GROUP BY 1, 2""")
def quantile_buckets(spark, d):
    named = predictions(spark, d).withColumn("family", F.nullif("family", F.lit("N")))
    found = ranking.quantile_buckets(named, ["family"], "target", [0.25, 0.5, 0.75])
    return found.groupBy("family", "bucket").agg(F.count("*").alias("n"), F.max("target").alias("high"))


@query("WN5", "SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0)::DOUBLE AS r FROM part")
def average_rank(spark, d):
    return distribution.average_ranks(table(spark, d, "part"), ["p_brand"], "p_size", "r").select("p_partkey", "r")


@query("WN6", """SELECT c_nationkey, c_custkey, "rank"::INTEGER AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS "rank" FROM customer) WHERE "rank" <= 3""")
def top_of_group(spark, d):
    return ranking.top_of_group(table(spark, d, "customer"), ["c_nationkey"], [F.desc(F.abs("c_acctbal")), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


@query("WN7", """SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT, doc_id)::INTEGER AS draw_rank FROM documents""")
def draw_rank(spark, d):
    return ranking.draw_rank(documents(spark, d), ["lang"], "doc_id", "7").select("doc_id", "draw_rank")


P_VALUES = "t AS (SELECT n_regionkey AS fam, c_nationkey AS item, (row_number() OVER (ORDER BY md5(c_nationkey::VARCHAR)) / 30.0)::DOUBLE AS p FROM (SELECT DISTINCT c_nationkey FROM customer) JOIN nation ON c_nationkey = n_nationkey)"


@query("WN8", f"""WITH {P_VALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, item) AS k, count(*) OVER (PARTITION BY fam) AS m FROM t)
SELECT fam, item, round(p, 8) AS p, round(least(1.0, min(p * m / k) OVER (PARTITION BY fam ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM r""")
def benjamini_hochberg(spark, d):
    return rounded(ranking.benjamini_hochberg(p_values(spark, d), ["fam"], "p"), 8, "p", "q")


def p_values(spark, d):
    from pyspark.sql.window import Window

    nations = table(spark, d, "customer").select("c_nationkey").distinct().join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = F.row_number().over(Window.orderBy(F.md5(F.col("c_nationkey").cast("string")))) / 30.0  # a row for each nation
    return nations.select(F.col("n_regionkey").alias("fam"), F.col("c_nationkey").alias("item"), p.alias("p"))


SPANS = (("license", "licensed? under|license"), ("grant", "under the"), ("version", "license, version [0-9]+"), ("number", "[0-9]+"))


@query("WN9", r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
p(term, priority, pattern) AS (VALUES ('license', 0, '(?:licensed? under|license)'), ('grant', 1, '(?:under the)'), ('version', 2, '(?:license, version [0-9]+)'), ('number', 3, '(?:[0-9]+)')),
marked AS (SELECT doc_id, line_no, line, priority, term, regexp_replace(line, '(?i)\b' || pattern || '\b', chr(1) || '\0' || chr(2), 'g') AS m FROM l, p WHERE regexp_matches(line, '(?i)\b' || pattern || '\b')),
cut AS (SELECT *, string_split(m, chr(1)) AS parts FROM marked),
each AS (SELECT doc_id, line_no, priority, term, generate_subscripts(parts, 1) AS i, parts FROM cut),
spans AS (
  SELECT doc_id, line_no, priority, term, split_part(parts[i], chr(2), 1) AS found,
         length(replace(array_to_string(parts[1:i - 1], ''), chr(2), '')) AS start, length(replace(array_to_string(parts[1:i - 1], ''), chr(2), '')) + length(split_part(parts[i], chr(2), 1)) AS stop
  FROM each WHERE i > 1
), ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY start, stop DESC, priority) AS k FROM spans),
walk(doc_id, line_no, k, upto, kept) AS (
  SELECT doc_id, line_no, k, stop, true FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.doc_id, o.line_no, o.k, CASE WHEN o.start >= w.upto THEN o.stop ELSE w.upto END, o.start >= w.upto
  FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.line_no = w.line_no AND o.k = w.k + 1
)
SELECT doc_id, line_no::INTEGER AS line_no, start::INTEGER AS start, stop::INTEGER AS "end", term, found FROM ordered JOIN walk USING (doc_id, line_no, k) WHERE kept""")
def accepted_spans(spark, d):
    """Non-overlapping matches of patterns that meet within documents: of `licensed under the` the first pattern's part stays."""
    from tessella.functions import text

    return text.term_matches(documents(spark, d).select("doc_id", "text"), "text", SPANS)


@query("SO1", f"WITH {RUNS} SELECT family, n, seed, mae FROM runs")
def multi_key_sort(spark, d):
    return runs(spark, d).orderBy(F.asc_nulls_last("family"), F.desc_nulls_last("n"), F.asc_nulls_last("seed"))


@query("SO2", f"WITH {RUNS} SELECT family, n, row_number() OVER (ORDER BY family <> 'BUILDING', family, n)::INTEGER AS place FROM (SELECT DISTINCT family, n FROM runs)")
def custom_order(spark, d):
    from pyspark.sql.window import Window

    cells = runs(spark, d).select("family", "n").distinct()
    return cells.withColumn("place", F.row_number().over(Window.orderBy(F.col("family") != "BUILDING", "family", "n")))  # a row for each cell of the report


@query("SO3", "(SELECT 'head' AS part, event_id FROM events ORDER BY value, event_id LIMIT 10) UNION ALL (SELECT 'tail', event_id FROM events ORDER BY value DESC, event_id DESC LIMIT 10)")
def head_and_tail(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    head, tail = events.orderBy("value", "event_id").limit(10), events.orderBy(F.desc("value"), F.desc("event_id")).limit(10)
    return sets.tagged_union({"head": head, "tail": tail}, "part").select("part", "event_id")


@query("ST1", "SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def tagged_union(spark, d):
    tables = {k: table(spark, d, k).groupBy(F.col(f"{k[0]}_nationkey").alias("nation")).agg(F.count("*").alias("n")) for k in ("customer", "supplier")}
    return sets.tagged_union(tables, "kind")


@query("ST2", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def first_by_key(spark, d):
    return sets.first_by_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("ST3", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N'),
c AS (SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_union)
SELECT *, n_left - n_both AS n_left_only, n_right - n_both AS n_right_only, n_both = 0 AS disjoint, n_both = n_left AS left_within, n_union = n_both AS equal FROM c""")
def set_algebra(spark, d):
    lines = table(spark, d, "lineitem")
    return sets.set_algebra(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'N'"), "l_partkey")


@query("ST4", """WITH f AS (SELECT DISTINCT lang, source FROM documents), g AS (SELECT l AS lang, s AS source FROM (SELECT unnest(['en', 'de', 'it']) AS l), (SELECT unnest(['src0', 'src1', 'src99']) AS s))
SELECT lang, source, 'missing' AS gap FROM (SELECT * FROM g EXCEPT SELECT * FROM f) UNION ALL SELECT lang, source, 'extra' FROM (SELECT * FROM f EXCEPT SELECT * FROM g)""")
def grid_gaps(spark, d):
    return sets.grid_gaps(documents(spark, d), {"lang": ["en", "de", "it"], "source": ["src0", "src1", "src99"]})


@query("ST5", "SELECT k, v FROM (SELECT c_nationkey AS k, 'customer' AS v, 0 AS turn FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', 1 FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY turn DESC) = 1")
def last_writer(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("v")).distinct()
    b = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("v")).distinct()
    return sets.last_writer([a, b], ["k"])
