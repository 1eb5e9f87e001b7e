"""Splits, samples, bootstrap and permutation, all by hash draws that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import distribution as ds
from tessella.operators import lookups
from tessella.operators.ranking import draw_rank, hash_draw, ranked

#: Draws have 32 bits; rows are ranked within so many ranges of them, and the ranges' sizes are added up.
RANGES = 4096


def spread_rank(rows: DataFrame, draw: Column, tie: str) -> DataFrame:
    """Adds rank, from 1, in the order of a 32-bit draw: no task holds more than a range of it, and the only global window runs over the ranges."""
    ranged = rows.withColumn("_draw", draw).withColumn("_range", F.shiftright("_draw", 20))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")  # at most RANGES rows
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_draw", tie))
    return ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn("rank", F.col("_before") + own).drop("_draw", "_range", "_before")


def generated_split(rows: DataFrame, item: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(item, split) of the distinct items: shares of the shuffled order, rounded half to even, the rest for testing."""
    if not (0 < train < 1 and 0 <= val < 1 and train + val <= 1):
        raise ValueError("shares must lie between 0 and 1 and sum to at most 1")
    ranked = spread_rank(rows.select(item).distinct(), hash_draw(seed, F.col(item).cast("string")), item)
    total = rows.select(F.countDistinct(item).alias("_n"))
    joined = ranked.join(F.broadcast(total), F.lit(True))  # one row
    n_train, n_val = F.bround(F.col("_n") * F.lit(train)), F.bround(F.col("_n") * F.lit(val))
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return joined.select(item, split.alias("split"))


SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}


def settled_split(rows: DataFrame, item: str, policy: str = "exclude") -> tuple[DataFrame, DataFrame]:
    """(splits, conflicts): items of one split keep it; those of several are left out, or take the first of train, val, test."""
    if policy not in ("exclude", "first"):
        raise ValueError(policy)
    order = F.element_at(F.create_map(*[F.lit(x) for kv in SPLIT_ORDER.items() for x in kv]), F.col("split"))
    found = rows.groupBy(item).agg(F.min_by("split", order).alias("split"), F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits"), F.countDistinct("split").alias("_n"))
    splits = found.filter("_n = 1") if policy == "exclude" else found
    return splits.select(item, "split"), found.filter("_n > 1").select(item, "splits")


def inferred_split_column(rows: DataFrame, candidates: dict[str, Column]) -> str | None:
    """The first candidate that names a split in every row; one job decides."""
    full = rows.agg(*[F.bool_and(c.isNotNull()).alias(name) for name, c in candidates.items()]).first()
    return next((name for name in candidates if full[name]), None)


def split_source(file: DataFrame | None, inferred: DataFrame | None, generate) -> tuple[str, DataFrame]:
    """The first of: a split file, splits inferred from records, generated ones (generate, or None if not wanted)."""
    for name, found in (("file", file), ("inferred", inferred)):
        if found is not None:
            return name, found
    if generate is None:
        raise ValueError("no split source, and generating one is not allowed")
    return "generated", generate()


def budget_subset(pool: DataFrame, item: str, seed: str, n: int, n_val: int) -> DataFrame:
    """(item, role): n items of the pool in its shuffled order, the first n_val for validation; smaller budgets are prefixes of larger ones."""
    ranked = spread_rank(pool.select(item).distinct(), hash_draw(seed, F.col(item).cast("string")), item)
    return ranked.filter(F.col("rank") <= n).select(item, F.when(F.col("rank") <= n_val, "val").otherwise("train").alias("role"))


def balanced(rows: DataFrame, label: str, item: str, seed: str) -> DataFrame:
    """As many rows of each label as the rarest has, drawn without replacement, with their draw_rank."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    found = draw_rank(rows, [label], item, seed)
    return found.join(F.broadcast(sizes), F.col("draw_rank") <= F.col("_least")).drop("_least")  # one row


def numbered(values: DataFrame, arm: str, order: str) -> DataFrame:
    """(arm, k, value, n): the values of each arm numbered from 0 in the order of a number that is no tie; ranged, not sorted in one task."""
    found = ranked(values.select(F.col(arm).alias("arm"), "value", order), ["arm"], order, [])
    return found.select("arm", "value", (F.col("_rank") - 1).alias("k"), F.col("_n").alias("n"))


def draws(spark: SparkSession, values: DataFrame, reps: int, seed: str) -> DataFrame:
    """(arm, rep, value): for each arm and replicate as many values as the arm has, with replacement.

    Draws are made where the replicates are and looked up in the arms' values, which each task holds a share of. Their
    number is not known to the planner, which would send all of them to every executor but for the hint. Every draw is
    shuffled; for sums, correlations and medians of many draws lookups makes them without that.
    """
    sizes = values.groupBy("arm").agg(F.max("n").alias("n"))
    grid = spark.range(reps).select(F.col("id").alias("rep")).join(F.broadcast(sizes), F.lit(True))  # a row for each arm
    drawn = grid.select("arm", "rep", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    k = hash_draw(seed, F.col("arm").cast("string"), F.col("rep").cast("string"), F.col("j").cast("string")) % F.col("n")
    return drawn.select("arm", "rep", k.alias("k")).join(values.select("arm", "k", "value").hint("shuffle_hash"), ["arm", "k"]).select("arm", "rep", "value")


def replicate_means(values: DataFrame, reps: int, seed: str, statistic: str = "mean") -> DataFrame:
    """(arm, rep, stat) of values that numbered() has made: the mean or median of each replicate of draws(), which are made where the values are and never become rows."""
    if statistic == "median":
        return lookups.drawn_medians(values, "value", reps, seed)
    return lookups.drawn_sums(values, "value", reps, seed).select("arm", "rep", F.when(F.col("n") > 0, F.try_divide("s", "n")).alias("stat"))


def interval(rows: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """The 2.5 and 97.5 percentiles of the finite values, their deviation and number; a group without any is left out."""
    fine = rows.filter(F.col(stat).isNotNull() & ~F.isnan(stat) & (F.abs(stat) != float("inf")))
    ends = ds.quantiles(fine, keys, stat, {"ci_low": 0.025, "ci_high": 0.975})
    spread = fine.groupBy(*keys).agg(F.stddev_samp(stat).alias("se"), F.count("*").alias("reps"))
    return ds.beside(ends, spread, keys).select(*keys, "ci_low", "ci_high", "se", "reps")


def arm_contrasts(stats: DataFrame) -> DataFrame:
    """(rep, ratio, difference) of the last arm by name against the first, replicate by replicate; a zero denominator gives no ratio."""
    ends = stats.groupBy("rep").agg(F.min_by("stat", "arm").alias("a"), F.max_by("stat", "arm").alias("b"))
    return ends.select("rep", F.when(F.col("a") != 0, F.col("b") / F.col("a")).alias("ratio"), (F.col("b") - F.col("a")).alias("difference"))


def correlations(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlation by group, over the rows that have both values."""
    both = rows.select(*keys, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ds.average_ranks(ds.average_ranks(both, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def decision(rows: DataFrame) -> DataFrame:
    """Adds passes: a positive effect whose interval leaves out 0 and whose q is below 0.01."""
    return rows.withColumn("passes", (F.col("effect") > 0) & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)) & (F.col("q") < 0.01))


def materiality(scenarios: DataFrame, key: str, base: str, other: str) -> DataFrame:
    """For each key whether sign, or what the interval says, changes from one scenario to another."""
    says = F.when(F.col("ci_low") > 0, "above").when(F.col("ci_high") < 0, "below").otherwise("open")
    marked = scenarios.withColumn("says", says).withColumn("sign", F.signum("effect"))
    a = marked.filter(F.col("scenario") == base).select(key, F.col("sign").alias("s0"), F.col("says").alias("c0"))
    b = marked.filter(F.col("scenario") == other).select(key, F.col("sign").alias("s1"), F.col("says").alias("c1"))
    return a.join(b, key).select(key, (F.col("s0") != F.col("s1")).alias("sign_changes"), (F.col("c0") != F.col("c1")).alias("category_changes"))
