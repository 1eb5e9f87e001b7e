"""Queries on file lists, manifests, schemas and run states (SC9, SK7, SK9, DQ1, DQ12, OR)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import normalize as nz
from tessella.operators import aggregates as ag
from tessella.operators import quality as dq
from tessella.operators import sets
from tessella.operators.storage import shared_dir
from tessella.plans.aggregates import TIES, rounded
from tessella.plans.base import PREDICTIONS, documents, predictions, query, runs, table
from tessella.sources import archives


@query("SC9", "SELECT replace(c_name, '#', '_') AS id, c_acctbal AS target FROM customer WHERE c_custkey % 10 <> 0")
def structure_list(spark, d):
    """A list of files and targets in which every tenth target is no number."""
    line = F.concat_ws(",", nz.structure_file(F.col("c_name")), F.when(F.col("c_custkey") % 10 == 0, "target").otherwise(F.col("c_acctbal").cast("string")))
    cells = F.split(line, ",")
    rows = table(spark, d, "customer").select(nz.id_of_file(cells[0]).alias("id"), cells[1].try_cast("double").alias("target"))
    return rows.filter("target is not null")


@query("SK7", "SELECT '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation")
def report_lines(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("| "), "n_name", F.lit(" | "), "n_regionkey", F.lit(" |")).alias("line"))


@query("SK8", "SELECT doc_id || '.txt' AS name, octet_length(encode(text)) AS size, sha256(text) AS sha256, true AS same FROM documents")
def written_files(spark, d):
    """Every document as a file, in the manifest of the write and as read and hashed again."""
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    docs = documents(spark, d).select(F.concat(F.col("doc_id"), F.lit(".txt")).alias("name"), "text")
    manifest = archives.write_files(docs, "name", "text", path)
    again = archives.files_of(spark, path).select("name", F.col("sha256").alias("found"))
    return manifest.join(again, "name", "left").select("name", "size", "sha256", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("same"))


@query("SK9", "SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) || '  doc/' || doc_id AS line FROM documents")
def manifest(spark, d):
    return documents(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.concat(F.sha2("text", 256), F.lit("  doc/"), "doc_id").alias("line"))


@query("DQ1", "SELECT unnest(['missing:split', 'missing:target']) AS fault")
def schema_faults(spark, d):
    faults = dq.schema_faults(documents(spark, d), ["doc_id", "text", "split", "target"])
    return spark.createDataFrame([(f,) for f in faults], "fault string")


@query("DQ12", f"WITH {PREDICTIONS} SELECT count(DISTINCT family || sub) AS n, 0::BIGINT AS n_faults FROM preds")
def double_computation(spark, d):
    """R2 by the variance of the targets, and again from the targets' own mean, must agree in every group."""
    rows = predictions(spark, d)
    first = ag.parity(rows, ["family", "sub"]).select("family", "sub", "r2")
    mean = rows.groupBy("family", "sub").agg(F.avg("target").alias("m"))
    gap, off = F.col("prediction") - F.col("target"), F.col("target") - F.col("m")
    second = rows.join(mean, ["family", "sub"]).groupBy("family", "sub").agg((1 - F.sum(gap * gap) / F.sum(off * off)).alias("r2"))
    faults = dq.recomputed(first, second, ["family", "sub"], ["r2"]).agg(F.count("*").alias("n_faults"))
    return first.agg(F.count("*").alias("n")).join(faults, F.lit(True))


@query("OR2", "SELECT family, seed, 'missing' AS gap FROM (SELECT DISTINCT c_mktsegment AS family FROM customer), (VALUES (3::BIGINT), (4)) t(seed)")
def missing_runs(spark, d):
    """Runs that a grid asks for and the finished ones lack."""
    done = runs(spark, d).filter("seed < 3")
    return sets.grid_gaps(done, {"family": done.select("family"), "seed": list(range(5))})


@query("OR4", f"""WITH {PREDICTIONS}, b AS (SELECT family, abs(prediction - target) AS e, (row_number() OVER (PARTITION BY family ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 64 AS b FROM preds),
m AS (SELECT family, b, avg(e) AS m, sum(e) AS s, count(*) AS n FROM b GROUP BY 1, 2) SELECT family, round(avg(m), 4) AS mean_of_batches, round(sum(s) / sum(n), 4) AS mean_of_rows, count(*) AS batches FROM m GROUP BY 1""")
def batch_means(spark, d):
    found = ag.batch_means(ag.residuals(predictions(spark, d)), ["family"], "abs_err", TIES, 64)
    return rounded(found, 4, "mean_of_batches", "mean_of_rows")
