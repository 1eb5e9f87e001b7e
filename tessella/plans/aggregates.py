"""Aggregation queries (AG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import aggregates as ag
from tessella.plans.base import HISTORIES, PREDICTIONS, RUNS, baselines, documents, histories, predictions, query, runs, table


def rounded(df, places: int, *columns: str):
    """The columns rounded, and negative zero made zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("AG1", f"""WITH {RUNS} SELECT family, n, count(mae) AS runs, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS sd FROM runs GROUP BY 1, 2""")
def group_summary(spark, d):
    return rounded(ag.group_summary(runs(spark, d), ["family", "n"], "mae"), 4, "mean", "sd")


@query("AG2", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def value_counts(spark, d):
    return ag.value_counts(documents(spark, d), ["lang", "source"])


@query("AG3", """SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS "in_A", count(*) FILTER (l_returnflag = 'R') AS "in_R"
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def multiplicities(spark, d):
    return ag.multiplicities(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag", ["A", "R"])


@query("AG4", """SELECT CASE WHEN grouping_id(lang, source) = 3 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping_id(lang, source) >= 1 THEN 'all' ELSE source END AS source, count(*) AS n
FROM (SELECT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents) GROUP BY ROLLUP (lang, source)""")
def subtotals(spark, d):
    return ag.subtotals(documents(spark, d), "lang", "source")


@query("AG5", f"""WITH {RUNS} SELECT family, n, {', '.join(f'round(avg(mae) FILTER (seed = {s}), 4) AS seed_{s}' for s in range(5))} FROM runs GROUP BY 1, 2""")
def seed_columns(spark, d):
    return rounded(ag.seed_columns(runs(spark, d), ["family", "n"], "seed", list(range(5)), "mae"), 4, *[f"seed_{s}" for s in range(5)])


@query("AG6", f"""WITH {RUNS} SELECT family, n, count(*) AS runs, count(*) FILTER (mae > zero_shot) AS worse, round(avg((mae < zero_shot)::INT), 8) AS share_better
FROM runs JOIN zero USING (family) GROUP BY 1, 2""")
def against_baseline(spark, d):
    joined = runs(spark, d).join(F.broadcast(baselines(spark, d)), "family")
    return rounded(ag.against_baseline(joined, ["family", "n"], "mae", "zero_shot"), 8, "share_better")


@query("AG7", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95
FROM lineitem GROUP BY 1""")
def quantiles(spark, d):
    return rounded(ag.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.95]), 4, "q10", "q50", "q95")


@query("AG8", f"""WITH {PREDICTIONS},
r AS (SELECT * REPLACE (nullif(family, 'N') AS family), prediction - target AS err, abs(prediction - target) AS ae FROM preds),
b AS (SELECT family, count(*) AS n, avg(err) AS bias, avg(ae) AS mae, quantile_cont(ae, 0.5) AS median_ae, sqrt(avg(err * err)) AS rmse, quantile_cont(ae, 0.9) AS p90, quantile_cont(ae, 0.95) AS p95,
      quantile_cont(target, 0.25) AS t1, quantile_cont(target, 0.5) AS t2, quantile_cont(target, 0.75) AS t3 FROM r GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ae DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rk, count(*) OVER (PARTITION BY family) AS m FROM r),
t AS (SELECT family, count(*) FILTER (rk <= ceil(0.1 * m)) AS n_top, sum(ae) FILTER (rk <= ceil(0.1 * m)) / sum(ae) AS top_share FROM k GROUP BY 1),
q AS (SELECT family, avg(ae) FILTER (target <= t1) AS mae_q1, avg(ae) FILTER (target > t1 AND target <= t2) AS mae_q2,
      avg(ae) FILTER (target > t2 AND target <= t3) AS mae_q3, avg(ae) FILTER (target > t3) AS mae_q4 FROM (SELECT r.*, t1, t2, t3 FROM r JOIN b ON r.family IS NOT DISTINCT FROM b.family) GROUP BY 1)
SELECT b.family, n, round(bias, 4) AS bias, round(mae, 4) AS mae, round(median_ae, 4) AS median_ae, round(rmse, 4) AS rmse, round(p90, 4) AS p90, round(p95, 4) AS p95, n_top, round(top_share, 8) AS top_share,
       round(mae_q1, 4) AS mae_q1, round(mae_q2, 4) AS mae_q2, round(mae_q3, 4) AS mae_q3, round(mae_q4, 4) AS mae_q4 FROM b JOIN t ON b.family IS NOT DISTINCT FROM t.family JOIN q ON b.family IS NOT DISTINCT FROM q.family""")
def residual_decomposition(spark, d):
    found = ag.residual_decomposition(predictions(spark, d).withColumn("family", F.nullif("family", F.lit("N"))), ["family"])
    return rounded(rounded(found, 4, "bias", "mae", "median_ae", "rmse", "p90", "p95", *[f"mae_q{b}" for b in (1, 2, 3, 4)]), 8, "top_share")


@query("AG9", f"""WITH {PREDICTIONS}, k AS (SELECT family, abs(prediction - target) AS ae, row_number() OVER (PARTITION BY family ORDER BY abs(prediction - target) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rk,
  count(*) OVER (PARTITION BY family) AS m FROM preds)
SELECT family, count(*) FILTER (rk <= ceil(0.2 * m)) AS n_top, round(sum(ae) FILTER (rk <= ceil(0.2 * m)) / sum(ae), 8) AS share FROM k GROUP BY 1""")
def top_share(spark, d):
    return rounded(ag.top_share(ag.residuals(predictions(spark, d)), ["family"], "abs_err", 0.2), 8, "share")


@query("AG10", f"""WITH {PREDICTIONS} SELECT family, sub, round(avg(abs(prediction - target)), 4) AS mae, round(sqrt(avg((prediction - target) ** 2)), 4) AS rmse,
round(1 - sum((prediction - target) ** 2) / (var_pop(target) * count(target)), 6) AS r2 FROM preds GROUP BY 1, 2""")
def parity(spark, d):
    return rounded(rounded(ag.parity(predictions(spark, d), ["family", "sub"]), 4, "mae", "rmse"), 6, "r2")


@query("AG11", f"""WITH {RUNS} SELECT family, n, '[' || string_agg(round(mae)::BIGINT::VARCHAR, ',' ORDER BY seed) || ']' AS series FROM runs GROUP BY 1, 2""")
def ordered_list(spark, d):
    whole = runs(spark, d).withColumn("mae", F.round("mae").cast("long"))
    return ag.ordered_list(whole, ["family", "n"], "seed", "mae")


@query("AG12", "SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT md5(text)) AS n_texts FROM documents GROUP BY 1")
def distinct_counts(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct(F.md5("text")).alias("n_texts"))


@query("AG13", f"""WITH {HISTORIES}, l AS (SELECT run, min(loss) AS best_loss FROM hist GROUP BY 1)
SELECT run, best_loss, min(epoch) FILTER (loss = best_loss)::INTEGER AS best_epoch, count(*) FILTER (loss = best_loss) = 1 AS "unique" FROM hist JOIN l USING (run) GROUP BY 1, 2""")
def best_epoch(spark, d):
    return ag.best_epoch(histories(spark, d), ["run"])


@query("AG14", f"""WITH {HISTORIES}, r AS (SELECT grp, run, arg_min(loss, epoch) AS f, arg_max(loss, epoch) AS z, min(loss) AS b, arg_min(epoch, (loss, epoch)) AS be, max(epoch) AS le FROM hist GROUP BY 1, 2)
SELECT grp, count(*) AS runs, round(median(b / f), 8) AS median_rel, round(median(z - b), 8) AS median_gap, count(*) FILTER (be = le) AS boundary_hits, round(stddev_samp(be), 8) AS sd_best_epoch FROM r GROUP BY 1""")
def learning_dynamics(spark, d):
    return rounded(ag.learning_dynamics(histories(spark, d), ["run"], ["grp"]), 8, "median_rel", "median_gap", "sd_best_epoch")


@query("AG15", f"""WITH {RUNS}, g AS (SELECT family, n, avg(mae) AS m FROM runs GROUP BY 1, 2), x AS (SELECT family, m - zero_shot AS delta, 100 * (m - zero_shot) / zero_shot AS percent FROM g JOIN zero USING (family))
SELECT family, round(min(delta), 4) AS min_delta, round(max(delta), 4) AS max_delta, round(min(percent), 6) AS min_percent, round(max(percent), 6) AS max_percent, count(*) FILTER (delta > 0) AS n_positive, count(*) AS n FROM x GROUP BY 1""")
def sign_range(spark, d):
    mean = runs(spark, d).groupBy("family", "n").agg(F.avg("mae").alias("m")).join(F.broadcast(baselines(spark, d)), "family")
    delta = mean.withColumn("delta", F.col("m") - F.col("zero_shot")).withColumn("percent", 100 * F.col("delta") / F.col("zero_shot"))
    return rounded(rounded(ag.sign_range(delta, ["family"], "delta", "percent"), 4, "min_delta", "max_delta"), 6, "min_percent", "max_percent")


CODES = ["empty_text", "wrong_length", "short", "no_lang", "bad_source"]


@query("AG16", """WITH c AS (SELECT unnest(list_filter([CASE WHEN text = '' THEN 'empty_text' END, CASE WHEN n_chars <> length(text) THEN 'wrong_length' END, CASE WHEN length(text) < 100 THEN 'short' END,
  CASE WHEN lang IS NULL THEN 'no_lang' END, CASE WHEN NOT regexp_full_match(source, 'src[0-9]+') THEN 'bad_source' END], lambda x: x IS NOT NULL)) AS code FROM documents)
SELECT l.code, count(c.code) AS n FROM (SELECT unnest(['empty_text', 'wrong_length', 'short', 'no_lang', 'bad_source']) AS code) l LEFT JOIN c ON l.code = c.code GROUP BY 1""")
def code_histogram(spark, d):
    tests = [F.col("text") == "", F.col("n_chars") != F.length("text"), F.length("text") < 100, F.col("lang").isNull(), ~F.col("source").rlike("^src[0-9]+$")]
    coded = documents(spark, d).select(F.array_compact(F.array(*[F.when(t, c) for t, c in zip(tests, CODES, strict=True)])).alias("codes"))
    return ag.code_histogram(coded, CODES)


@query("AG17", f"""WITH {PREDICTIONS}, m AS (SELECT avg(ae) FILTER (family = 'A') AS a, avg(ae) FILTER (family = 'R') AS b, avg(ae) FILTER (family = 'A' AND sub = 'O') AS ka, avg(ae) FILTER (family = 'R' AND sub = 'O') AS kb
  FROM (SELECT *, abs(prediction - target) AS ae FROM preds))
SELECT scenario, round(x, 4) AS mean_first, round(y, 4) AS mean_second, round(z, 8) AS ratio, round(w, 4) AS difference FROM (
  SELECT 'all' AS scenario, a AS x, b AS y, b / a AS z, b - a AS w FROM m UNION ALL SELECT 'kept', ka, kb, kb / ka, kb - ka FROM m
  UNION ALL SELECT 'change', ka - a, kb - b, kb / ka - b / a, kb - ka - b + a FROM m)""")
def arm_scenarios(spark, d):
    found = ag.arm_scenarios(ag.residuals(predictions(spark, d)), "family", "A", "R", "abs_err", F.col("sub") == "O")
    return rounded(rounded(found, 4, "mean_first", "mean_second", "difference"), 8, "ratio")


@query("AG18", """WITH s AS (SELECT lang, n_chars > 5000 AS long, CASE ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT lang, count(*) AS n_all, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
count(*) FILTER (split IN ('train', 'val')) AS n_pool, count(*) FILTER (long) AS n_flagged FROM s GROUP BY 1""")
def split_summary(spark, d):
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("doc_id"))), 1, 8), 16, 10).cast("long") % 10
    split = F.when(bucket == 8, "val").when(bucket == 9, "test").otherwise("train")
    return ag.split_summary(documents(spark, d).withColumn("split", split).withColumn("long", F.col("n_chars") > 5000), "lang", "split", "long")


@query("AG19", """SELECT key, count(*) AS n, count(value) AS n_values FROM (SELECT unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events) GROUP BY 1""")
def key_profile(spark, d):
    return ag.key_profile(table(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("props")), "props")


@query("AG20", """SELECT sha256(string_agg(md5(c_name) || '  ' || c_name, chr(10) ORDER BY md5(c_name) || '  ' || c_name)) AS digest, count(*) AS n FROM customer""")
def aggregate_digest(spark, d):
    return ag.aggregate_digest(table(spark, d, "customer").select("c_name", F.md5("c_name").alias("digest")), "c_name", "digest")


@query("AG21", """WITH e AS (SELECT user_id % 5 AS grp, user_id, event_type, avg(value) AS err FROM events GROUP BY 1, 2, 3), b AS (SELECT user_id, median(value) AS base FROM events GROUP BY 1),
m AS (SELECT grp, user_id, avg(err) AS me, max(base) AS base FROM e JOIN b USING (user_id) GROUP BY 1, 2) SELECT grp, count(*) AS items, round(avg((me < base)::INT), 8) AS share_improved FROM m GROUP BY 1""")
def seed_mean_gain(spark, d):
    events = table(spark, d, "events")
    err = events.groupBy((F.col("user_id") % 5).alias("grp"), "user_id", "event_type").agg(F.avg("value").alias("err"))
    base = events.groupBy("user_id").agg(F.median("value").alias("base"))
    return rounded(ag.seed_mean_gain(err.join(base, "user_id"), ["grp"], "user_id", "err", "base"), 8, "share_improved")
