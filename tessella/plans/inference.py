"""Split, sampling and inference queries (RS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import distribution, lookups, ranking
from tessella.operators import permutations as pm
from tessella.operators import replicates as rp
from tessella.operators import resample as rs
from tessella.operators.storage import settled
from tessella.plans.aggregates import rounded
from tessella.plans.base import documents, query, table, vectors

#: Replicates: the study's, and those of the queries whose SQL draws fewer.
REPS, FEW = 50_000, 100
DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
RANKED = f"r AS (SELECT doc_id, row_number() OVER (ORDER BY {DRAW.format(chr(39) + '42:' + chr(39) + ' || doc_id')}, doc_id) AS k, count(*) OVER () AS n FROM documents)"
HALF_EVEN = "CASE WHEN {0} - floor({0}) = 0.5 THEN 2 * round({0} / 2) ELSE round({0}) END"


@query("RS1", f"""WITH {RANKED}, c AS (SELECT *, {HALF_EVEN.format('(n * 0.8)')} AS t, {HALF_EVEN.format('(n * 0.1)')} AS v FROM r)
SELECT doc_id, CASE WHEN k <= t THEN 'train' WHEN k <= t + v THEN 'val' ELSE 'test' END AS split FROM c""")
def generated_split(spark, d):
    return rs.generated_split(documents(spark, d), "doc_id", "42")


TEXT_SPLITS = f"s AS (SELECT md5(text) AS k, CASE {DRAW.format(chr(39) + '42:' + chr(39) + ' || doc_id')} % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM documents)"


def text_splits(spark, d):
    bucket = ranking.hash_draw("42", F.col("doc_id").cast("string")) % 10
    return documents(spark, d).select(F.md5("text").alias("k"), F.when(bucket == 8, "val").when(bucket == 9, "test").otherwise("train").alias("split"))


@query("RS2", f"WITH {TEXT_SPLITS} SELECT k, min(split) AS split FROM s GROUP BY 1 HAVING count(DISTINCT split) = 1")
def settled_split(spark, d):
    return rs.settled_split(text_splits(spark, d), "k")[0]


@query("RS2_conflicts", f"WITH {TEXT_SPLITS} SELECT k, string_agg(DISTINCT split, '|' ORDER BY split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_conflicts(spark, d):
    return rs.settled_split(text_splits(spark, d), "k", "first")[1]


@query("RS3", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders")
def inferred_split(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("F", "train", "O", "val", "P", "test")])
    candidates = {"priority": F.try_element_at(names, F.col("o_orderpriority")), "status": F.try_element_at(names, F.col("o_orderstatus"))}
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", candidates[rs.inferred_split_column(orders, candidates)].alias("split"))


@query("RS4", f"WITH {RANKED}, c AS (SELECT *, {HALF_EVEN.format('(n * 0.8)')} AS t, {HALF_EVEN.format('(n * 0.1)')} AS v FROM r) SELECT 'generated' AS origin, CASE WHEN k <= t THEN 'train' WHEN k <= t + v THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM c GROUP BY 2")
def split_source(spark, d):
    origin, found = rs.split_source(None, None, lambda: rs.generated_split(documents(spark, d), "doc_id", "42"))
    return found.groupBy("split").agg(F.count("*").alias("n")).withColumn("origin", F.lit(origin))


@query("RS5", f"WITH {RANKED} SELECT doc_id, CASE WHEN k <= 10 THEN 'val' ELSE 'train' END AS role FROM r WHERE k <= 100")
def budget_subset(spark, d):
    return rs.budget_subset(documents(spark, d), "doc_id", "42", 100, 10)


@query("RS6", f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DRAW.format(chr(39) + '7:' + chr(39) + ' || doc_id')}, doc_id)::INTEGER AS draw_rank FROM documents)
SELECT * FROM r WHERE draw_rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""")
def balanced(spark, d):
    return rs.balanced(documents(spark, d).select("doc_id", "lang"), "lang", "doc_id", "7")


VALUES = f"""v AS (SELECT arm, value, k, count(*) OVER (PARTITION BY arm) AS n FROM (SELECT event_type AS arm, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events))"""


def replicates_sql(reps: int) -> str:
    return f"""{VALUES}, a AS (SELECT arm, max(n) AS n FROM v GROUP BY 1),
d AS (SELECT arm, rep, {DRAW.format("'42:' || arm || ':' || rep || ':' || j")} % n AS k FROM (SELECT arm, n, rep, unnest(range(n)) AS j FROM a, range({reps}) t(rep))),
m AS (SELECT arm, rep, avg(value) AS stat, median(value) AS med FROM d JOIN v USING (arm, k) GROUP BY 1, 2)"""


REPLICATES = replicates_sql(FEW)
CI = "round(quantile_cont({0}, 0.025), 8) AS ci_low, round(quantile_cont({0}, 0.975), 8) AS ci_high, round(stddev_samp({0}), 8) AS se, count(*) AS reps"


def values(spark, d):
    return settled(rs.numbered(table(spark, d, "events"), "event_type", "event_id"))  # used several times


def fixed(df):
    return rounded(df, 8, "ci_low", "ci_high", "se")


@query("RS7", f"WITH {replicates_sql(REPS)} SELECT arm, {CI.format('stat')} FROM m GROUP BY 1")
def bootstrap_means(spark, d):
    return fixed(rs.interval(settled(rs.replicate_means(values(spark, d), REPS, "42")), ["arm"], "stat"))  # used several times


PAIR = "two AS (SELECT a.rep, b.{0} / a.{0} AS ratio, b.{0} - a.{0} AS difference FROM m a JOIN m b USING (rep) WHERE a.arm = (SELECT min(arm) FROM v) AND b.arm = (SELECT max(arm) FROM v))"


@query("RS8", f"WITH {REPLICATES}, {PAIR.format('stat')} SELECT 'ratio' AS kind, {CI.format('ratio')} FROM two UNION ALL SELECT 'difference', {CI.format('difference')} FROM two")
def bootstrap_contrasts(spark, d):
    pairs = rs.arm_contrasts(rs.replicate_means(values(spark, d), FEW, "42"))
    long = pairs.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("stat")) for k in ("ratio", "difference")])))
    return fixed(rs.interval(long, ["kind"], "stat"))


@query("RS9", f"WITH {REPLICATES}, o AS (SELECT rep, sum(stat * n) / sum(n) AS stat FROM m JOIN a USING (arm) GROUP BY 1) SELECT {CI.format('stat')} FROM o")
def stratified_bootstrap(spark, d):
    pooled = lookups.drawn_sums(values(spark, d), "value", FEW, "42").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("stat"))
    return fixed(rs.interval(pooled, [], "stat"))


@query("RS10", f"""WITH {VALUES.replace('value,', 'value, y,').replace('SELECT event_type AS arm, value, y,', 'SELECT event_type AS arm, value, (user_id % 50)::DOUBLE AS y,')}, a AS (SELECT arm, max(n) AS n FROM v GROUP BY 1),
d AS (SELECT arm, rep, {DRAW.format("'42:' || arm || ':' || rep || ':' || j")} % n AS k FROM (SELECT arm, n, rep, unnest(range(n)) AS j FROM a, range({FEW}) t(rep))),
c AS (SELECT arm, rep, corr(value, y) AS stat FROM d JOIN v USING (arm, k) GROUP BY 1, 2) SELECT arm, {CI.format('stat')} FROM c GROUP BY 1""")
def bootstrap_correlation(spark, d):
    pairs = rs.numbered(table(spark, d, "events").withColumn("value", F.struct("value", (F.col("user_id") % 50).cast("double").alias("y"))), "event_type", "event_id")
    pairs = settled(pairs.select("arm", "k", "n", F.col("value.value").alias("x"), F.col("value.y").alias("y")))  # used several times
    return fixed(rs.interval(lookups.drawn_correlations(pairs, FEW, "42"), ["arm"], "stat"))


@query("RS11", f"WITH {REPLICATES}, {PAIR.format('med')} SELECT {CI.format('difference')} FROM two")
def bootstrap_medians(spark, d):
    pairs = rs.arm_contrasts(rs.replicate_means(values(spark, d), FEW, "42", "median"))
    return fixed(rs.interval(pairs, [], "difference"))


#: Replicates of the bootstraps by multiplicities; sums over draws that SQL has no generator for, so tests hold them against brute force.
FULL = REPS


def full_means(spark, d):
    return settled(rp.replicate_means(table(spark, d, "events"), "event_type", "value", FULL, "42"))


@query("RS7_full")
def full_bootstrap_means(spark, d):
    return fixed(rs.interval(full_means(spark, d), ["arm"], "stat"))


@query("RS8_full")
def full_bootstrap_contrasts(spark, d):
    pairs = rs.arm_contrasts(full_means(spark, d))
    return fixed(rs.interval(pairs.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("stat")) for k in ("ratio", "difference")]))), ["kind"], "stat"))


@query("RS9_full")
def full_stratified_bootstrap(spark, d):
    pooled = full_means(spark, d).groupBy("rep").agg((F.sum(F.col("stat") * F.col("n")) / F.sum("n")).alias("stat"))
    return fixed(rs.interval(pooled, [], "stat"))


@query("RS10_full")
def full_bootstrap_correlation(spark, d):
    pairs = table(spark, d, "events").withColumn("y", (F.col("user_id") % 50).cast("double"))
    return fixed(rs.interval(settled(rp.replicate_correlations(pairs, "event_type", "event_id", "value", "y", FULL, "42")), ["arm"], "stat"))


@query("RS10_davies_bouldin")
def bootstrap_davies_bouldin(spark, d):
    """A thousand replicates, as the study draws of these two: each measures all vectors anew."""
    return fixed(rs.interval(settled(rp.replicate_davies_bouldin(vectors(spark, d).select("id", "family", "x"), 1000, "42")), [], "stat"))


@query("RS10_auc")
def bootstrap_auc(spark, d):
    rows = vectors(spark, d).select("family", F.col("x")[0].alias("score"))
    return fixed(rs.interval(settled(rp.replicate_areas(rows, "score", "family", 1000, "42")), [], "stat"))


@query("RS11_full")
def full_bootstrap_medians(spark, d):
    pairs = rs.arm_contrasts(settled(rp.replicate_medians(table(spark, d, "events"), "event_type", "value", FULL, "42")))
    return fixed(rs.interval(pairs, [], "difference"))


POINTS = """numbered AS (SELECT event_type AS arm, value AS x, {0} AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)"""
SHUFFLED = "pr AS (SELECT m.arm, m.rep, a.x, b.y FROM moved m JOIN numbered b ON m.arm = b.arm AND m.k = b.k JOIN numbered a ON m.arm = a.arm AND m.place = a.k)"
PLAIN = "(event_id * 7919 % 1000)::DOUBLE"


def points(spark, d, y=None):
    y = (F.col("event_id") * 7919 % 1000).cast("double") if y is None else y
    rows = table(spark, d, "events").select("event_type", "event_id", F.col("value").alias("x"), y.alias("y"))
    return settled(pm.numbered(rows, "event_type", "event_id").select("arm", "k", "n", "x", "y"))  # used several times


def extreme(mark: str) -> str:
    return f"SELECT arm, round(stat, 8) AS stat, round((count(*) FILTER ({mark}) + 1)::DOUBLE / (count(r) + 1), 8) AS p FROM o JOIN c USING (arm) GROUP BY arm, o.stat"


@query("RS12", f"WITH RECURSIVE {POINTS.format(PLAIN)}, {pm.bijection_sql(FEW, '42')}, {SHUFFLED}, o AS (SELECT arm, corr(x, y) AS stat FROM numbered GROUP BY 1), c AS (SELECT arm, rep, corr(x, y) AS r FROM pr GROUP BY 1, 2) {extreme('r >= stat')}")
def permutation_correlation(spark, d):
    rows = points(spark, d)
    stats = settled(lookups.permuted_correlations(rows, FEW, "42"))
    return rounded(pm.p_values(rows.groupBy("arm").agg(F.corr("x", "y").alias("stat")), stats, ["arm"]), 8, "stat", "p")


GAP = "avg(x) FILTER (y >= 500) - avg(x) FILTER (y < 500)"


@query("RS13", f"WITH RECURSIVE {POINTS.format(PLAIN)}, {pm.bijection_sql(FEW, '42')}, {SHUFFLED}, o AS (SELECT arm, {GAP} AS stat FROM numbered GROUP BY 1), c AS (SELECT arm, rep, {GAP} AS r FROM pr GROUP BY 1, 2) {extreme('abs(r) >= abs(stat)')}")
def permutation_difference(spark, d):
    rows = points(spark, d)
    gap = (F.avg(F.when(F.col("y") >= 500, F.col("x"))) - F.avg(F.when(F.col("y") < 500, F.col("x")))).alias("stat")
    marked = rows.withColumn("y", F.when(F.col("y") >= 500, 1.0).when(F.col("y") < 500, 0.0))
    sums = lookups.permuted_sums(marked, FEW, "42")
    high, low = F.try_divide("sxy", "sy"), F.try_divide(F.col("sx") - F.col("sxy"), F.col("m") - F.col("sy"))
    stats = settled(sums.select("arm", "rep", (high - low).alias("stat")))
    return rounded(pm.p_values(rows.groupBy("arm").agg(gap), stats, ["arm"], "two_sided"), 8, "stat", "p")


@query("RS14", f"""WITH RECURSIVE numbered AS (SELECT 'all' AS arm, embedding::DOUBLE[] AS x, label::DOUBLE AS y, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings),
{pm.bijection_sql(FEW, '42')}, pr AS (SELECT -1 AS rep, x, y FROM numbered UNION ALL SELECT m.rep, a.x, b.y FROM moved m JOIN numbered b ON m.k = b.k JOIN numbered a ON m.place = a.k),
dims AS (SELECT rep, i, corr(v, y) AS r FROM (SELECT rep, y, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM pr) GROUP BY 1, 2),
most AS (SELECT rep, max(abs(r)) AS m FROM dims WHERE rep >= 0 GROUP BY 1) SELECT i::BIGINT AS dim, round(r, 8) AS stat, round((count(*) FILTER (m >= abs(r)) + 1)::DOUBLE / (count(*) + 1), 8) AS p FROM dims, most WHERE dims.rep = -1 GROUP BY i, r""")
def largest_permutation(spark, d):
    """Every dimension of the vectors against their label, by the largest of all dimensions."""
    rows = pm.numbered(vectors(spark, d).select(F.lit("all").alias("one"), "id", "x", F.col("label").cast("double").alias("y")), "one", "id")
    found = settled(pm.dimension_permutations(settled(rows.select("arm", "k", "n", "x", "y")), FEW, "42"))
    return rounded(pm.largest(found), 8, "stat", "p")


@query("RS15", """WITH t AS (SELECT (c_nationkey % 3)::BIGINT AS fam, c_custkey AS item, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey * 7919 % 1009) / 1009.0::DOUBLE END AS p FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, item) AS k, count(*) OVER (PARTITION BY fam) AS m FROM t WHERE p IS NOT NULL)
SELECT fam, item, round(p, 8) AS p, round(least(1.0, min(p * m / k) OVER (PARTITION BY fam ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM r UNION ALL SELECT fam, item, NULL, NULL FROM t WHERE p IS NULL""")
def adjusted(spark, d):
    tests = table(spark, d, "customer").select((F.col("c_nationkey") % 3).cast("long").alias("fam"), F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") * 7919 % 1009 / 1009.0).alias("p"))
    return rounded(ranking.benjamini_hochberg(tests, ["fam"], "p"), 8, "p", "q")


AVERAGE = "rank() OVER (PARTITION BY p_brand ORDER BY {0}) + (count(*) OVER (PARTITION BY p_brand, {0}) - 1) / 2.0"


@query("RS16", f"""WITH r AS (SELECT p_brand, p_size, p_retailprice, ({AVERAGE.format('p_size')})::DOUBLE AS a, ({AVERAGE.format('p_retailprice')})::DOUBLE AS b FROM part)
SELECT p_brand, round(corr(p_size, p_retailprice), 8) AS pearson, round(corr(a, b), 8) AS spearman FROM r GROUP BY 1""")
def correlations(spark, d):
    return rounded(rs.correlations(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice"), 8, "pearson", "spearman")


#: Enough replicates for a q below 0.01 among a handful of arms.
GATE = 600
GATED = "CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value ELSE (event_id * 7919 % 1000)::DOUBLE END"


@query("RS17", f"""WITH RECURSIVE {POINTS.format(GATED)}, {pm.bijection_sql(GATE, '42')}, {SHUFFLED}, o AS (SELECT arm, corr(x, y) AS stat FROM numbered GROUP BY 1), c AS (SELECT arm, rep, corr(x, y) AS r FROM pr GROUP BY 1, 2),
p AS (SELECT arm, stat, (count(*) FILTER (r >= stat) + 1)::DOUBLE / (count(r) + 1) AS p FROM o JOIN c USING (arm) GROUP BY arm, o.stat),
k AS (SELECT *, row_number() OVER (ORDER BY p, arm) AS k, count(*) OVER () AS m FROM p), q AS (SELECT arm, stat, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM k),
d AS (SELECT arm, rep, {DRAW.format("'42:' || arm || ':' || rep || ':' || j")} % n AS k FROM (SELECT arm, n, rep, unnest(range(n)) AS j FROM (SELECT arm, max(n) AS n FROM numbered GROUP BY 1), range({FEW}) t(rep))),
b AS (SELECT arm, rep, corr(x, y) AS stat FROM d JOIN numbered USING (arm, k) GROUP BY 1, 2), i AS (SELECT arm, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM b GROUP BY 1)
SELECT arm, round(stat, 8) AS effect, round(q, 8) AS q, stat > 0 AND (lo > 0 OR hi < 0) AND q < 0.01 AS passes FROM q JOIN i USING (arm)""")
def decision(spark, d):
    """Effect, interval by bootstrap and q by permutation for each arm; the property of one arm is its values."""
    events = table(spark, d, "events")
    first = F.broadcast(events.agg(F.min("event_type").alias("first")))  # one row
    y = F.when(F.col("event_type") == F.col("first"), F.col("value")).otherwise((F.col("event_id") * 7919 % 1000).cast("double"))
    marked = events.join(first, F.lit(True)).select("event_type", "event_id", F.col("value").alias("x"), y.alias("y"))
    rows = settled(pm.numbered(marked, "event_type", "event_id").select("arm", "k", "n", "x", "y"))
    effects = rows.groupBy("arm").agg(F.corr("x", "y").alias("stat"))
    stats = settled(lookups.permuted_correlations(rows, GATE, "42"))
    tested = ranking.benjamini_hochberg(settled(pm.p_values(effects, stats, ["arm"])), [], "p")
    gated = rs.decision(rs.interval(settled(lookups.drawn_correlations(rows, FEW, "42")), ["arm"], "stat").join(tested.select("arm", F.col("stat").alias("effect"), "q"), "arm"))
    return rounded(gated, 8, "effect", "q").select("arm", "effect", "q", "passes")


@query("RS18", """WITH e AS (SELECT event_type AS metric, (event_id % 2 = 0) AS kept, value - 10 AS v FROM events), s AS (SELECT metric, 'all' AS scenario, avg(v) AS effect, quantile_cont(v, 0.4) AS lo, quantile_cont(v, 0.6) AS hi FROM e GROUP BY 1
UNION ALL SELECT metric, 'kept', avg(v), quantile_cont(v, 0.4), quantile_cont(v, 0.6) FROM e WHERE kept GROUP BY 1), c AS (SELECT *, CASE WHEN lo > 0 THEN 'above' WHEN hi < 0 THEN 'below' ELSE 'open' END AS says FROM s)
SELECT a.metric, sign(a.effect) <> sign(b.effect) AS sign_changes, a.says <> b.says AS category_changes FROM c a JOIN c b USING (metric) WHERE a.scenario = 'all' AND b.scenario = 'kept'""")
def materiality(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("metric"), "event_id", (F.col("value") - 10).alias("v"))

    def scenario(part, name):
        ends = distribution.quantiles(part, ["metric"], "v", {"ci_low": 0.4, "ci_high": 0.6})
        return part.groupBy("metric").agg(F.avg("v").alias("effect")).join(ends, "metric").withColumn("scenario", F.lit(name))

    return rs.materiality(scenario(rows, "all").unionByName(scenario(rows.filter("event_id % 2 = 0"), "kept")), "metric", "all", "kept")


@query("RS19", f"""WITH r AS (SELECT p_brand, p_size, p_retailprice, ({AVERAGE.format('p_size')})::DOUBLE AS a, ({AVERAGE.format('p_retailprice')})::DOUBLE AS b FROM part),
c AS (SELECT p_brand, corr(p_size, p_retailprice) AS pearson, corr(a, b) AS spearman FROM r GROUP BY 1), g AS (SELECT p_brand, avg(p_retailprice) FILTER (p_size > 25) - avg(p_retailprice) FILTER (p_size <= 25) AS m,
median(p_retailprice) FILTER (p_size > 25) - median(p_retailprice) FILTER (p_size <= 25) AS d FROM part GROUP BY 1)
SELECT p_brand, 'pearson' AS statistic, round(pearson, 8) AS value FROM c UNION ALL SELECT p_brand, 'spearman', round(spearman, 8) FROM c UNION ALL SELECT p_brand, 'mean_difference', round(m, 8) FROM g UNION ALL SELECT p_brand, 'median_difference', round(d, 8) FROM g""")
def statistics(spark, d):
    part = table(spark, d, "part")
    found = rs.correlations(part, ["p_brand"], "p_size", "p_retailprice")
    large, price = F.col("p_size") > 25, F.col("p_retailprice")
    means = part.groupBy("p_brand").agg((F.avg(F.when(large, price)) - F.avg(F.when(~large, price))).alias("mean_difference"))
    middle = distribution.quantiles(part.withColumn("large", large), ["p_brand", "large"], "p_retailprice", {"median": 0.5})
    side = [F.max(F.when(mark, F.col("median"))) for mark in (F.col("large"), ~F.col("large"))]
    gaps = means.join(middle.groupBy("p_brand").agg((side[0] - side[1]).alias("median_difference")), "p_brand")
    names = ("pearson", "spearman", "mean_difference", "median_difference")
    long = found.join(gaps, "p_brand").select("p_brand", F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in names])))
    return rounded(long, 8, "value")


@query("RS20", "SELECT event_type, round(quantile_cont(value, 0.025), 8) AS ci_low, round(quantile_cont(value, 0.975), 8) AS ci_high, round(stddev_samp(value), 8) AS se, count(*) AS reps FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def interval(spark, d):
    return fixed(rs.interval(table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))), ["event_type"], "value"))
