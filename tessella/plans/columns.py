"""Projection and filter queries (PJ, FL)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import normalize as nz
from tessella.operators import aggregates as ag
from tessella.operators import sets
from tessella.plans.aggregates import rounded
from tessella.plans.base import HISTORIES, PREDICTIONS, RUNS, baselines, documents, histories, predictions, query, runs, table

WORDS = "string_split(lower(p_name || ' ' || p_type), ' ')"


def symbols(spark, d):
    """Parts as records: the letters that their words begin with are their elements."""
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    letters = F.transform(words, lambda w: F.upper(F.substring(w, 1, 1)))
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice", letters.alias("elements"))


SYMBOLS = f"syms AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, p_retailprice, list_transform({WORDS}, lambda w: upper(w[1:1])) AS elements FROM part)"


@query("PJ1", """SELECT doc_id, CASE WHEN l IN ('en', 'es') THEN 'train' WHEN l = 'de' THEN 'val' WHEN l = 'fr' THEN 'test' END AS split FROM (SELECT doc_id, lower(trim(lang)) AS l FROM documents)""")
def canonical_split(spark, d):
    labels = F.element_at(F.create_map(*[F.lit(x) for x in ("en", " Train", "es", "TR ", "de", "dev", "fr", "Holdout")]), F.col("lang"))
    return documents(spark, d).select("doc_id", nz.canonical_split(labels).alias("split"))


@query("PJ2", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN round(value) ELSE NULL END AS target FROM events""")
def target(spark, d):
    kind = F.col("event_id") % 6
    text = F.when(kind == 0, F.col("value").cast("string")).when(kind == 1, " NaN ").when(kind == 2, "none").when(kind == 3, "inf")
    text = text.when(kind == 4, F.round("value").cast("string")).otherwise("a number")
    return table(spark, d, "events").select("event_id", nz.target(text).alias("target"))


@query("PJ3", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_retailprice ELSE p_size::DOUBLE END AS target,
  CASE WHEN p_size % 3 = 2 THEN 'size' ELSE 'price' END AS used FROM part""")
def picked_target(spark, d):
    kind = F.col("p_size") % 3
    fields = F.when(kind == 0, F.create_map(F.lit("price"), F.lit("na"), F.lit("size"), F.col("p_size").cast("string")))
    fields = fields.when(kind == 1, F.create_map(F.lit("price"), F.col("p_retailprice").cast("string"))).otherwise(F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    value, used = nz.picked_target(fields, ["price", "size"])
    return table(spark, d, "part").select("p_partkey", value.alias("target"), used.alias("used"))


@query("PJ4", """SELECT CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE doc_id::VARCHAR END AS id, count(*) AS n FROM documents GROUP BY 1""")
def first_id(spark, d):
    kind = F.col("doc_id") % 3
    ids = [F.when(kind == 0, F.concat(F.lit(" "), F.col("lang"))).otherwise(""), F.when(kind == 1, F.col("source")), F.col("doc_id")]
    return documents(spark, d).select(nz.first_id(*ids).alias("id")).filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))


@query("PJ5", "SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM part")
def safe_id(spark, d):
    return table(spark, d, "part").select("p_partkey", nz.safe_id(F.concat("p_name", F.lit("/"), "p_type")).alias("safe"))


@query("PJ6", "SELECT c_custkey, 'POSCAR-' || replace(c_name, '#', '_') || '.vasp' AS filename, replace(c_name, '#', '_') AS id FROM customer")
def structure_file(spark, d):
    named = table(spark, d, "customer").select("c_custkey", nz.structure_file(F.col("c_name")).alias("filename"))
    return named.withColumn("id", nz.id_of_file(F.concat(F.lit("folder/"), "filename")))


@query("PJ7", f"""WITH {SYMBOLS}, e AS (SELECT p_partkey, unnest(elements) AS s FROM syms), c AS (SELECT p_partkey, s, count(*) AS n FROM e GROUP BY 1, 2)
SELECT p_partkey, string_agg(s || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY CASE s WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END, s) AS formula FROM c GROUP BY 1""")
def hill_formula(spark, d):
    return symbols(spark, d).select("p_partkey", nz.hill_formula(F.col("elements")).alias("formula"))


@query("PJ8", f"""WITH {SYMBOLS} SELECT p_partkey, len(elements)::INTEGER AS n_atoms, array_to_string(elements, ';') AS elements, array_to_string(list_sort(list_distinct(elements)), ';') AS unique_elements FROM syms""")
def element_stats(spark, d):
    return symbols(spark, d).select("p_partkey", *[c.alias(n) for n, c in nz.element_stats(F.col("elements")).items()])


@query("PJ9", f"""WITH {SYMBOLS}, f AS (SELECT p_partkey, list_contains(elements, 'W') AS o, list_contains(elements, 'S') AS n FROM syms)
SELECT p_partkey, o AS "has_O", n AS "has_N", o AS is_oxide, n AND NOT o AS is_nitride, o AND n AS is_oxynitride FROM f""")
def family_flags(spark, d):
    return symbols(spark, d).select("p_partkey", *[c.alias(n) for n, c in nz.family_flags(F.col("elements"), "W", "S").items()])


@query("PJ10", """SELECT doc_id, (CASE WHEN quality IS NULL THEN 0 ELSE 1 END + CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS filled FROM documents LEFT JOIN labels USING (doc_id)""")
def filled_fields(spark, d):
    joined = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", nz.filled_fields(["quality", "text", "lang"]).alias("filled"))


@query("PJ11", f"WITH {PREDICTIONS} SELECT family, sub, round(avg(prediction - target), 4) AS err, round(avg(abs(prediction - target)), 4) AS abs_err, round(avg((prediction - target) ** 2), 0) AS sq_err FROM preds GROUP BY 1, 2")
def residuals(spark, d):
    found = ag.residuals(predictions(spark, d)).groupBy("family", "sub").agg(*[F.avg(c).alias(c) for c in ("err", "abs_err", "sq_err")])
    return rounded(rounded(found, 4, "err", "abs_err"), 0, "sq_err")


@query("PJ12", f"""WITH {RUNS} SELECT family, n, seed, round(mae - zero_shot, 4) AS delta_adapt, round(100 * (mae - zero_shot) / zero_shot, 6) AS percent_adapt, round(zero_shot - mae, 4) AS transfer_gain FROM runs JOIN zero USING (family)""")
def effect_sizes(spark, d):
    joined = runs(spark, d).join(F.broadcast(baselines(spark, d)), "family")
    sizes = joined.select("family", "n", "seed", *[c.alias(k) for k, c in nz.effect_sizes(F.col("mae"), F.col("zero_shot")).items()])
    return rounded(rounded(sizes, 4, "delta_adapt", "transfer_gain"), 6, "percent_adapt")


@query("PJ13", f"""WITH {HISTORIES} SELECT run, epoch::INTEGER AS epoch, round(CASE WHEN abs(f) < 1e-12 THEN 0 ELSE 100 * (1 - loss / f) END, 6) AS reduction FROM (SELECT *, first_value(loss) OVER (PARTITION BY run ORDER BY epoch) AS f FROM hist)""")
def relative_reduction(spark, d):
    first = F.first_value("loss").over(Window.partitionBy("run").orderBy("epoch"))
    found = histories(spark, d).withColumn("f", first)
    return rounded(found.select("run", "epoch", F.when(F.abs("f") < 1e-12, 0.0).otherwise(100 * (1 - F.col("loss") / F.col("f"))).alias("reduction")), 6, "reduction")


@query("PJ14", f"""WITH {RUNS} SELECT family, n, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS sd FROM runs GROUP BY 1, 2""")
def seed_mean(spark, d):
    wide = ag.seed_columns(runs(spark, d), ["family", "n"], "seed", list(range(5)), "mae")
    values = F.array_compact(F.array(*[f"seed_{s}" for s in range(5)]))
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    spread = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    sd = F.when(F.size(values) > 1, F.sqrt(spread / (F.size(values) - 1)))
    return rounded(wide.select("family", "n", mean.alias("mean"), sd.alias("sd")), 4, "mean", "sd")


@query("PJ15", "SELECT l_returnflag, printf('%.1f', avg(l_quantity)) AS mean_text, count(DISTINCT l_linestatus) || '/' || 2 AS share_text FROM lineitem GROUP BY 1")
def display_text(spark, d):
    found = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.countDistinct("l_linestatus").alias("k"))
    return found.select("l_returnflag", F.format_string("%.1f", "m").alias("mean_text"), F.format_string("%d/2", "k").alias("share_text"))


@query("PJ16", "SELECT doc_id, 'hashed' AS method, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS name FROM documents")
def constant_and_lookup(spark, d):
    names = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    return documents(spark, d).select("doc_id", F.lit("hashed").alias("method"), F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("other")).alias("name"))


@query("PJ17", "SELECT lower(trim(c_mktsegment)) AS family, c_custkey::INTEGER AS n FROM customer")
def normal_keys(spark, d):
    family, n = nz.normal_keys(F.concat(F.lit("  "), F.upper("c_mktsegment")), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select(family.alias("family"), n.alias("n"))


@query("PJ18", r"""SELECT doc_id, trim(regexp_replace(substr(text, greatest(0, p - 1 - 180) + 1, p + 6 + 180 - greatest(0, p - 1 - 180)), '\s+', ' ', 'g')) AS snippet
FROM (SELECT doc_id, text, strpos(text, 'icense') AS p FROM documents) WHERE p > 0""")
def snippet(spark, d):
    at = F.locate("icense", F.col("text"))
    found = documents(spark, d).filter(at > 0)
    return found.select("doc_id", nz.snippet(F.col("text"), at - 1, at + 6).alias("snippet"))


@query("PJ19", "SELECT doc_id, 'occ_' || substr(sha256(source || chr(0) || doc_id::VARCHAR || chr(0) || lang), 1, 24) AS content_id FROM documents")
def content_id(spark, d):
    return documents(spark, d).select("doc_id", nz.content_id("occ_", F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("content_id"))


@query("PJ20", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS row_hash FROM nation""")
def row_hash(spark, d):
    nation = table(spark, d, "nation")
    return nation.select("n_nationkey", nz.row_hash(nation.columns).alias("row_hash"))


@query("PJ21", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'mirror/' || substr(url, 9) ELSE url END AS moved FROM pages")
def moved_path(spark, d):
    return table(spark, d, "pages").select("page_id", nz.moved_path(F.col("url"), "https://", "mirror/").alias("moved"))


@query("PJ22", """WITH t AS (SELECT p_size AS n, CASE WHEN p_size * 0.1 - floor(p_size * 0.1) = 0.5 THEN (2 * round(p_size * 0.1 / 2))::INTEGER ELSE round(p_size * 0.1)::INTEGER END AS r FROM part)
SELECT DISTINCT n, CASE WHEN greatest(5, r) >= n THEN greatest(1, n // 5) ELSE greatest(5, r) END::INTEGER AS n_val FROM t""")
def validation_size(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("n")).distinct().withColumn("n_val", nz.validation_size(F.col("n")))


@query("PJ23", "WITH m AS (SELECT p_type, avg(p_retailprice) AS a FROM part GROUP BY 1) SELECT p_type, max(p_retailprice) AS high, min(p_retailprice) AS low, round(avg(abs(p_retailprice - a)), 6) AS mad FROM part JOIN m USING (p_type) GROUP BY 1")
def range_summary(spark, d):
    mean = F.avg("p_retailprice").over(Window.partitionBy("p_type"))
    found = table(spark, d, "part").withColumn("a", mean).groupBy("p_type").agg(F.max("p_retailprice").alias("high"), F.min("p_retailprice").alias("low"), F.avg(F.abs(F.col("p_retailprice") - F.col("a"))).alias("mad"))
    return rounded(found, 6, "mad")


@query("PJ24", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / (1 + exp(-x)), 8) + 0.0) AS activated FROM embeddings")
def silu(spark, d):
    activated = F.transform("embedding", lambda x: F.round(nz.silu(x.cast("double")), 8) + F.lit(0.0))
    return table(spark, d, "embeddings").select("vec_id", activated.alias("activated"))


@query("FL1", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def equal_rows(spark, d):
    orders = table(spark, d, "orders")
    least = orders.agg(F.min("o_orderpriority")).scalar()
    return orders.filter(sets.equals({"o_orderstatus": "F", "o_orderpriority": least})).select("o_orderkey")


@query("FL2", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def labelled(spark, d):
    return documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left").dropna(subset=["quality", "toxic"]).select("doc_id", "quality")


@query("FL3", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def members(spark, d):
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return documents(spark, d).filter(F.col("lang").isin("de", "fr")).join(good, "doc_id", "left_semi").select("doc_id")


@query("FL4", "SELECT page_id FROM pages WHERE regexp_matches(url, '[0-9]{2,}')")
def matching(spark, d):
    return table(spark, d, "pages").filter(F.col("url").rlike("[0-9]{2,}")).select("page_id")


@query("FL5", f"WITH {SYMBOLS} SELECT p_partkey FROM syms WHERE list_contains(elements, 'W') AND NOT list_contains(elements, 'S')")
def pure_oxides(spark, d):
    flags = nz.family_flags(F.col("elements"), "W", "S")
    return symbols(spark, d).filter(flags["is_oxide"] & ~flags["is_oxynitride"]).select("p_partkey")


@query("FL6", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 25")
def first_rows(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").limit(25).select("event_id", "value")


@query("FL7", """SELECT 'value' AS "column", count(*) AS n FROM events WHERE event_id % 7 = 0 OR value IS NULL""")
def not_finite(spark, d):
    rows = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).withColumn("fine", F.lit(1.0))
    return sets.not_finite(rows, ["value", "fine"])
