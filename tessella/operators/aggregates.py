"""Roll-ups of runs, residuals and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import distribution as ds
from tessella.operators.ranking import ranked


def group_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sample deviation of a value by group; the deviation of one run is null."""
    return runs.groupBy(*keys).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def value_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def multiplicities(rows: DataFrame, keys: list[str], split: str | None = None, values: list[str] | None = None) -> DataFrame:
    """Keys that stand more than once and how often, in all and within each named value of split."""
    parts = [F.count_if(F.col(split) == v).alias(f"in_{v}") for v in values or []] if split else []
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *parts).filter("n > 1")


def subtotals(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner) with the total of each outer and of all under the label `all`; null keys stay apart as `none`."""
    named = rows.select(*[F.coalesce(F.col(c), F.lit("none")).alias(c) for c in (outer, inner)])
    rolled = named.rollup(outer, inner).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return rolled.select(F.when(F.col("level") == 3, "all").otherwise(F.col(outer)).alias(outer), F.when(F.col("level") >= 1, "all").otherwise(F.col(inner)).alias(inner), "n")


def seed_columns(runs: DataFrame, keys: list[str], seed: str, seeds: list[int], value: str) -> DataFrame:
    """One column for each seed; the seeds are given, so no job looks for them."""
    wide = runs.groupBy(*keys).pivot(seed, seeds).agg(F.avg(value))
    return wide.select(*keys, *[F.col(str(s)).alias(f"seed_{s}") for s in seeds])


def against_baseline(runs: DataFrame, keys: list[str], value: str, baseline: str) -> DataFrame:
    """How many runs of a group are worse than the baseline, and which share is better."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.count_if(F.col(value) > F.col(baseline)).alias("worse"), F.avg((F.col(value) < F.col(baseline)).cast("int")).alias("share_better")
    )


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, a column for each; groups without a value are left out."""
    return ds.quantiles(rows, keys, value, {f"q{round(100 * p)}": p for p in at})


def residuals(rows: DataFrame) -> DataFrame:
    """Adds err (prediction less target), abs_err and sq_err."""
    err = F.col("prediction") - F.col("target")
    return rows.withColumns({"err": err, "abs_err": F.abs(err), "sq_err": err * err})


def top_share(rows: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """Size and share of the sum of the top fraction of each group (its ceiling of rows); ties at its end are alike. Nulls stay out."""
    found = ds.cumulated(ds.counted(rows, keys, value).filter("value is not null"), keys, ["n"])
    return found.groupBy(*keys).agg(*[c.alias(n) for n, c in ds.top_columns(fraction).items()])


def residual_decomposition(rows: DataFrame, keys: list[str], fraction: float = 0.10) -> DataFrame:
    """Bias, median and mean absolute error, root mean square, upper quantiles, share of the worst part, and the mean absolute error in each quartile of the target.

    The quartiles are closed on the right at interpolated bounds. Counts of distinct errors give quantiles and the worst
    part; counts and error sums of distinct targets the quartiles' bounds and means. Null keys are a group; rows without
    an error count in n alone.
    """
    r = residuals(rows).select(*keys, "target", "err", "abs_err", "sq_err")
    base = r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("err").alias("bias"), F.avg("abs_err").alias("mae"), F.sqrt(F.avg("sq_err")).alias("rmse"))
    errors = ds.cumulated(ds.counted(r, keys, "abs_err").filter("value is not null"), keys, ["n"])
    upper = dict(zip(("median_ae", "p90", "p95"), ds.quantile_columns([0.5, 0.9, 0.95]), strict=True)) | ds.top_columns(fraction)
    worst = errors.groupBy(*keys).agg(*[c.alias(n) for n, c in upper.items()])
    sums = r.filter("target is not null").groupBy(*keys, F.col("target").alias("value")).agg(F.count("*").alias("n"), F.sum("abs_err").alias("_sum"), F.count("abs_err").alias("_with"))
    targets = ds.cumulated(sums, keys, ["n"])
    bounds = targets.groupBy(*keys).agg(F.array(*ds.quantile_columns([0.25, 0.5, 0.75])).alias("_t"))
    bucket = F.when(F.col("value") <= F.col("_t")[0], 1).when(F.col("value") <= F.col("_t")[1], 2).when(F.col("value") <= F.col("_t")[2], 3).otherwise(4)
    means = [(F.sum(F.when(F.col("_b") == b, F.col("_sum"))) / F.sum(F.when(F.col("_b") == b, F.col("_with")))).alias(f"mae_q{b}") for b in (1, 2, 3, 4)]
    by_quartile = ds.beside(sums, bounds, keys).withColumn("_b", bucket).groupBy(*keys).agg(*means)
    joined = ds.beside(ds.beside(base, worst, keys, "left"), by_quartile, keys, "left")
    return joined.select(*keys, "n", "bias", "mae", "median_ae", "rmse", "p90", "p95", "n_top", F.col("share").alias("top_share"), *[f"mae_q{b}" for b in (1, 2, 3, 4)])


def parity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute error, root mean square and R2, which is null where all targets are one."""
    r = residuals(rows)
    spread = F.var_pop("target") * F.count("target")
    return r.groupBy(*keys).agg(
        F.avg("abs_err").alias("mae"), F.sqrt(F.avg("sq_err")).alias("rmse"), F.when(spread > 0, 1 - F.sum("sq_err") / spread).alias("r2")
    )


def ordered_list(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The values of a group in the order of another column, as JSON text."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*keys).agg(F.to_json(F.transform(pairs, lambda p: p[value])).alias("series"))


def best_epoch(histories: DataFrame, keys: list[str], epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Least loss of each run, the first epoch that has it, and whether only one has."""
    least = histories.groupBy(*keys).agg(F.min(loss).alias("best_loss"), F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"))
    at = histories.join(least, keys).groupBy(*keys).agg(F.count_if(F.col(loss) == F.col("best_loss")).alias("n_best"))
    return least.join(at, keys).select(*keys, "best_loss", "best_epoch", (F.col("n_best") == 1).alias("unique"))


def learning_dynamics(histories: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """By group: the medians of best over first loss and of final less best, how many runs are best at their last epoch, and the deviation of the best epoch.

    A first loss of zero gives what IEEE division gives: NaN, which is the greatest, where the best is zero too, else infinity.
    """
    run = histories.groupBy(*group, *keys).agg(
        F.min_by("loss", "epoch").alias("first"), F.max_by("loss", "epoch").alias("final"), F.min("loss").alias("best"),
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.max("epoch").alias("last_epoch"),
    )
    relative = F.when(F.col("first") == 0, F.col("best") * float("inf")).otherwise(F.try_divide("best", "first"))
    return run.groupBy(*group).agg(
        F.count("*").alias("runs"), F.median(relative).alias("median_rel"), F.median(F.col("final") - F.col("best")).alias("median_gap"),
        F.count_if(F.col("best_epoch") == F.col("last_epoch")).alias("boundary_hits"), F.stddev_samp("best_epoch").alias("sd_best_epoch"),
    )


def sign_range(rows: DataFrame, keys: list[str], delta: str, percent: str) -> DataFrame:
    """Ranges of a difference and of its percentage, and how many differences are positive."""
    return rows.groupBy(*keys).agg(
        F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"), F.min(percent).alias("min_percent"), F.max(percent).alias("max_percent"),
        F.count_if(F.col(delta) > 0).alias("n_positive"), F.count("*").alias("n"),
    )


def code_histogram(coded: DataFrame, codes: list[str]) -> DataFrame:
    """How many rows have each of the codes in their list `codes`; codes that none has count 0."""
    listed = coded.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    found = coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return listed.join(found, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def arm_scenarios(rows: DataFrame, arm: str, first: str, second: str, value: str, kept: Column) -> DataFrame:
    """Means of two arms with their ratio and difference, for all rows, for the kept ones, and what keeping changes."""
    def means(mark: Column) -> list[Column]:
        return [F.avg(F.when(mark & (F.col(arm) == a), F.col(value))) for a in (first, second)]

    one = rows.agg(*[m.alias(f"{s}_{a}") for s, mark in (("all", F.lit(True)), ("kept", kept)) for m, a in zip(means(mark), "ab", strict=True)])
    rows_ = [F.struct(F.lit(s).alias("scenario"), F.col(f"{s}_a").alias("mean_first"), F.col(f"{s}_b").alias("mean_second"), (F.col(f"{s}_b") / F.col(f"{s}_a")).alias("ratio"), (F.col(f"{s}_b") - F.col(f"{s}_a")).alias("difference")) for s in ("all", "kept")]
    change = F.struct(
        F.lit("change").alias("scenario"), (F.col("kept_a") - F.col("all_a")).alias("mean_first"), (F.col("kept_b") - F.col("all_b")).alias("mean_second"),
        (F.col("kept_b") / F.col("kept_a") - F.col("all_b") / F.col("all_a")).alias("ratio"), (F.col("kept_b") - F.col("kept_a") - F.col("all_b") + F.col("all_a")).alias("difference"),
    )
    return one.select(F.inline(F.array(*rows_, change)))


def split_summary(rows: DataFrame, family: str, split: str, flag: str) -> DataFrame:
    """Counts of all, train, val, test, pool (train and val) and flagged rows by family, in one pass."""
    return rows.groupBy(family).agg(
        F.count("*").alias("n_all"), *[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in ("train", "val", "test")],
        F.count_if(F.col(split).isin("train", "val")).alias("n_pool"), F.count_if(flag).alias("n_flagged"),
    )


def key_profile(records: DataFrame, column: str) -> DataFrame:
    """In how many records each key of a map stands, and in how many with a value."""
    return records.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


def aggregate_digest(rows: DataFrame, path: str, digest: str) -> DataFrame:
    """One sha256 over a small table of (path, digest) in the order of the paths; a manifest, not a data table."""
    lines = F.array_sort(F.collect_list(F.concat_ws("  ", F.col(digest), F.col(path))))
    return rows.agg(F.sha2(F.concat_ws("\n", lines), 256).alias("digest"), F.count("*").alias("n"))


def seed_mean_gain(rows: DataFrame, keys: list[str], item: str, error: str, baseline: str) -> DataFrame:
    """Each item's error averaged over the seeds, and the share of items for which it is below the baseline."""
    mean = rows.groupBy(*keys, item).agg(F.avg(error).alias("mean_error"), F.max(baseline).alias("baseline"))
    return mean.groupBy(*keys).agg(F.count("*").alias("items"), F.avg((F.col("mean_error") < F.col("baseline")).cast("int")).alias("share_improved"))


def batch_means(rows: DataFrame, keys: list[str], value: str, order: list[str], size: int) -> DataFrame:
    """The mean of the means of batches in the order given, beside the mean of the rows: they differ where the last batch is short."""
    batch = F.floor((F.col("_rank") - 1) / size)
    means = ranked(rows, keys, order[0], order[1:]).withColumn("_batch", batch).groupBy(*keys, "_batch").agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return means.groupBy(*keys).agg(F.avg("_m").alias("mean_of_batches"), (F.sum("_s") / F.sum("_n")).alias("mean_of_rows"), F.count("*").alias("batches"))
