"""Ranks, bands, buckets and keyed choices; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.distribution import beside, counted, cumulated, cuts, least_from, quantiles, upto

#: Ranges of a value that are ranked apart: a task holds one range of one group.
RANGES = 64


def range_bounds(rows: DataFrame, *values: str | Column) -> list[list[float]]:
    """For each value the bounds of its ranges, from one pass: approximate quantiles over all rows, ascending."""
    at = ", ".join(str(i / RANGES) for i in range(1, RANGES))
    kept = rows.select(*[(v if isinstance(v, Column) else F.col(v)).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    found = kept.agg(*[F.expr(f"percentile_approx(v{i}, array({at}), {40 * RANGES})") for i in range(len(values))]).first()
    return [sorted(set(q or [])) for q in found]


def ranked(rows: DataFrame, keys: list[str], value: str | Column, ties: list[str], descending: bool = False, bounds: list[float] | None = None, parts: int | None = None) -> DataFrame:
    """Adds _rank, from 1, in the order of value (nulls as the least), then ties, within each group, and _n, the rows of the group.

    Bounds, which are range_bounds() if not given, part the value into ranges; rows are ranked within a range and the
    sizes of the ranges before it are added. For values of which none is common, such as draws; where one may be, the
    functions of distribution work on counts. parts: how many partitions rank the ranges, if not left to the session.
    """
    kept = rows.withColumn("_value", value if isinstance(value, Column) else F.col(value))
    bounds = range_bounds(rows, value)[0] if bounds is None else bounds

    def range_of(low: int, high: int) -> Column:
        """How many of the bounds from low to high are less than the value, and low."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("_real") > bounds[middle], range_of(middle + 1, high)).otherwise(range_of(low, middle))

    kept = kept.withColumn("_real", F.col("_value").cast("double"))
    number = F.when(F.col("_value").isNull(), -1).otherwise(range_of(0, len(bounds)))
    kept = kept.withColumn("_range", -number if descending else number)
    order = Window.partitionBy(*keys).orderBy("_range")
    sizes = kept.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))  # a row for each group and range
    sizes = sizes.select(*keys, "_range", (F.sum("_size").over(order) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(*keys)).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(F.desc("_value") if descending else F.asc("_value"), *ties))
    there = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    kept = kept.repartition(parts, *keys, "_range") if parts else kept
    joined = kept.withColumn("_own", own).join(sizes.withColumnsRenamed({k: f"_of_{k}" for k in keys}).withColumnRenamed("_range", "_at"), [F.col("_range") == F.col("_at"), *there])
    return joined.withColumn("_rank", F.col("_before") + F.col("_own")).drop("_value", "_real", "_range", "_at", "_before", "_own", *[f"_of_{k}" for k in keys])


def best_of_key(rows: DataFrame, key: str, quality: list[str], ordinal: str) -> DataFrame:
    """One row for each key: the greatest quality (column by column), of equals the first seen."""
    order = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(q) for q in quality], F.asc(ordinal))
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def duplicate_report(rows: DataFrame, key: str, quality: list[str], ordinal: str) -> DataFrame:
    """For keys with several rows: how many are extra, which is kept, which were seen, and whether qualities are tied."""
    q = F.struct(*quality)
    found = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(ordinal)).alias("seen"), F.min(q).alias("_low"), F.max(q).alias("_high"),
        F.max_by(ordinal, F.struct(*quality, (-F.col(ordinal)).alias("_first"))).alias("kept"),
    )
    return found.filter("n > 1").select(key, (F.col("n") - 1).alias("extra"), "kept", F.array_join("seen", ",").alias("seen"), (F.col("_low") == F.col("_high")).alias("tied"))


def bands(rows: DataFrame, keys: list[str], value: str, tie: str, fraction: float = 0.20) -> DataFrame:
    """Adds band: the fraction (its ceiling) of greatest values is hard, of least ones easy, the rest middle.

    Only the two rows at the bounds are looked for; all others are compared with them. Nulls are the least value.
    """
    size = F.ceil(F.lit(fraction) * F.col("n_all"))
    marked = beside(rows, cuts(rows, keys, value, tie, {"_easy": size, "_rest": F.col("n_all") - size}), keys, "left")
    band = F.when(upto(value, tie, F.col("_easy")), "easy").when(~upto(value, tie, F.col("_rest")), "hard").otherwise("middle")
    return marked.withColumn("band", band).drop("_easy", "_rest")


def quantile_buckets(rows: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Adds bucket, from 1: bounds are interpolated quantiles and belong to the bucket below; null keys are a group."""
    names = {f"_q{i}": p for i, p in enumerate(at)}
    bucket = F.lit(len(at) + 1)
    for i in reversed(range(len(at))):
        bucket = F.when(F.col(value) <= F.col(f"_q{i}"), i + 1).otherwise(bucket)
    return beside(rows, quantiles(rows, keys, value, names), keys).withColumn("bucket", bucket).drop(*names)


def top_of_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def hash_draw(seed: str, *parts: Column) -> Column:
    """32 bits of the md5 of seed and parts: a draw that any SQL engine repeats."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 8), 16, 10).cast("long")


def draw_rank(rows: DataFrame, keys: list[str], item: str, seed: str) -> DataFrame:
    found = ranked(rows, keys, hash_draw(seed, F.col(item).cast("string")), [item])
    return found.withColumn("draw_rank", F.col("_rank").cast("int")).drop("_rank", "_n")


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str) -> DataFrame:
    """Adds q within each family of tests; p that is null or not finite stays out and has no q.

    Equal p have equal q, so the steps are taken over distinct p: the least of p times the tests over its rank, from here
    up, within ranges of p and then over the ranges.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    found = cumulated(counted(tests.filter(ok), family, p), family, ["n"])
    raw = F.col("value") * F.col("n_all") / (F.col("n_below") + F.col("n"))
    stepped = least_from(found.withColumn("_raw", raw), family, "_raw", "_least")
    adjusted = stepped.select(*[F.col(k).alias(f"_of_{k}") for k in family], F.col("value").alias("_p"), F.least(F.lit(1.0), "_least").alias("q"))
    there = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in family]
    return tests.join(adjusted, [F.col(p) == F.col("_p"), *there], "left").drop("_p", *[f"_of_{k}" for k in family])


def accepted_spans(spans: Column) -> Column:
    """Of an array of (start, end, priority, ...) the leftmost, longest, first-ranked spans that do not overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["priority"].alias("priority"), s.alias("span"))))
    none = F.slice(F.transform(ordered, lambda o: o["span"]), 1, 0)
    state = F.struct(none.alias("kept"), F.lit(-1).cast("int").alias("upto"))

    def step(s: Column, o: Column) -> Column:
        fits = o["start"] >= s["upto"]
        return F.struct(
            F.when(fits, F.concat(s["kept"], F.array(o["span"]))).otherwise(s["kept"]).alias("kept"), F.when(fits, (-o["less"]).cast("int")).otherwise(s["upto"]).alias("upto")
        )

    return F.aggregate(ordered, state, step)["kept"]
