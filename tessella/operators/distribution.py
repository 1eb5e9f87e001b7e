"""Order statistics by group, from counts of distinct values.

Rows are counted by group and value first, so a value that most rows hold is one row afterwards. The distinct values of
a group are parted into ranges, cumulated within each range and moved on by the sums of the ranges before it; no task
orders a whole group. Quantiles, ranks, shares, areas and selections are then read from the cumulated counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A group's distinct values are parted into two to this power of ranges.
LEVELS = 6


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, which has the keys too; null keys meet null keys."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)  # one row
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], how).drop(*[f"_of_{k}" for k in keys])


def counted(rows: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """(keys, value, n): how many rows of a group have a value; nulls count as one value."""
    return rows.select(*keys, (value if isinstance(value, Column) else F.col(value)).alias("value")).groupBy(*keys, "value").agg(F.count("*").alias("n"))


def means(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean): how many rows a group has, and the mean of its values in double precision, whatever the order of the rows.

    Values are split into two whole multiples of powers of two that are so large, by the group's size and greatest value,
    that sums of either are exact. Groups with values beyond 1e200, or none beyond 1e-200, are averaged as they come.
    """
    size = F.abs(value).cast("double")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("_known"), F.max(size).alias("_most"))
    bits = F.ceil(F.log2(F.col("_known") + 1.0))
    scaled = sizes.withColumn("_bits", bits).withColumn("_unit", F.when(F.col("_most").between(1e-200, 1e200), F.pow(F.lit(2.0), F.floor(F.log2("_most")) + 2 + F.col("_bits") - 52)))
    every = beside(rows.select(*keys, F.col(value).cast("double").alias("_v")), scaled.select(*keys, "_unit", "_bits"), keys)
    high = F.rint(F.col("_v") / F.col("_unit"))
    small = F.col("_unit") * F.pow(F.lit(2.0), F.col("_bits") - 52)
    low = F.rint((F.col("_v") - high * F.col("_unit")) / small)
    sums = every.groupBy(*keys).agg(F.sum(high).alias("_high"), F.sum(low).alias("_low"), F.avg("_v").alias("_plain"))
    total = F.col("_high") * F.col("_unit") + F.col("_low") * small
    return beside(scaled, sums, keys).select(*keys, "n", F.when(F.col("_unit").isNull(), F.col("_plain")).otherwise(total / F.col("_known")).alias("mean"))


def cumulated(counts: DataFrame, keys: list[str], weights: list[str], levels: int = LEVELS) -> DataFrame:
    """counts, with one row for each (keys, value), with range and for each weight w: w_below, its sum over the smaller values of the group, and w_all.

    Nulls are the least value, NaN the greatest. range rises with the value; a group has two to the power of levels at
    most, with about as many distinct values in each.
    """
    parts = 1 << levels
    at = ", ".join(str(i / parts) for i in range(1, parts))
    real = F.col("value").cast("double")
    bounds = counts.groupBy(*keys).agg(F.expr(f"percentile_approx(cast(value as double), array({at}), {20 * parts})").alias("_bounds"))

    def step(pos: Column, half: Column) -> Column:
        return F.when(F.element_at("_bounds", pos + half) < real, pos + half).otherwise(pos)

    number = F.when(F.col("_bounds").isNull() | F.col("value").isNull(), 0).otherwise(F.aggregate(F.array(*[F.lit(1 << s) for s in reversed(range(levels))]), F.lit(0), step))
    ranged = beside(counts, bounds, keys).withColumn("range", number).drop("_bounds")
    sizes = ranged.groupBy(*keys, "range").agg(*[F.sum(w).alias(w) for w in weights])
    order, whole = Window.partitionBy(*keys).orderBy("range"), Window.partitionBy(*keys)  # a row for each range
    sizes = sizes.select(*keys, "range", *[(F.sum(w).over(order) - F.col(w)).alias(f"_{w}_before") for w in weights], *[F.sum(w).over(whole).alias(f"{w}_all") for w in weights])
    own = Window.partitionBy(*keys, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({f"{w}_below": F.coalesce(F.sum(w).over(own), F.lit(0)) for w in weights})
    return beside(summed, sizes, [*keys, "range"]).withColumns({f"{w}_below": F.col(f"{w}_below") + F.col(f"_{w}_before") for w in weights}).drop(*[f"_{w}_before" for w in weights])


def quantile_columns(at: list[float]) -> list[Column]:
    """Aggregates over the groups of cumulated() with weight n: exact quantiles, interpolated between neighbours."""
    out = []
    for p in at:
        place = (F.col("n_all") - 1) * F.lit(p)
        low, high = (F.max(F.when((F.col("n_below") <= f(place)) & (f(place) < F.col("n_below") + F.col("n")), F.col("value"))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        out.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high))
    return out


def quantiles(rows: DataFrame, keys: list[str], value: str | Column, at: dict[str, float]) -> DataFrame:
    """(keys, a column for each named quantile) of the values that are not null; groups without one are left out."""
    found = cumulated(counted(rows, keys, value).filter("value is not null"), keys, ["n"])
    return found.groupBy(*keys).agg(*[q.alias(name) for name, q in zip(at, quantile_columns(list(at.values())), strict=True)])


def top_columns(fraction: float) -> dict[str, Column]:
    """Aggregates over the groups of cumulated(): how many rows the top fraction has (its ceiling), and which share of the sum."""
    size = F.ceil(F.lit(fraction) * F.col("n_all"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), size - (F.col("n_all") - F.col("n_below") - F.col("n"))))
    return {"n_top": F.max(size), "share": F.sum(F.col("value") * taken) / F.sum(F.col("value") * F.col("n"))}


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the rank of the value within the group, from 1, tied values sharing the mean of theirs; a null has none."""
    found = cumulated(counted(rows, keys, value).filter("value is not null"), keys, ["n"])
    ranks = found.select(*keys, F.col("value").alias("_value"), (F.col("n_below") + (F.col("n") + 1) / 2.0).alias(name))
    there = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = rows.join(ranks.withColumnsRenamed({k: f"_of_{k}" for k in keys}), [F.col(value) == F.col("_value"), *there], "left")
    return joined.drop("_value", *[f"_of_{k}" for k in keys])


def cuts(rows: DataFrame, keys: list[str], value: str, tie: str, places: dict[str, Column]) -> DataFrame:
    """(keys, for each named place the row there, as (value, tie)): order by value, then by tie, from 1.

    places are formed from n_all; a place of 0 has nulls and stands before all rows. Only the rows that have the value
    of a place are looked at for their ties, and those are counted in the same way.
    """
    found = cumulated(counted(rows, keys, value), keys, ["n"])
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("_cut"), p.cast("long").alias("_place")) for c, p in places.items()]))
    at = found.select(*keys, "value", "n", "n_below", named.alias("_at")).select(*keys, F.col("value").alias("_value"), "n", "n_below", "_at._cut", "_at._place")
    at = at.filter((F.col("n_below") < F.col("_place")) & (F.col("_place") <= F.col("n_below") + F.col("n"))).withColumn("_nth", F.col("_place") - F.col("n_below"))
    there = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    of = at.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_value", "_cut", "_nth")
    bound = rows.select(*keys, value, F.col(tie).alias("_tie")).join(of, [F.col(value).eqNullSafe(F.col("_value")), *there])
    ties = cumulated(bound.groupBy(*keys, "_cut", "_nth", F.col("_value").alias("_at"), F.col("_tie").alias("value")).agg(F.count("*").alias("n")), [*keys, "_cut", "_nth", "_at"], ["n"])
    nth = ties.filter((F.col("n_below") < F.col("_nth")) & (F.col("_nth") <= F.col("n_below") + F.col("n")))
    row = F.struct(F.col("_at").alias("value"), F.col("value").alias("tie"))
    return nth.groupBy(*keys).agg(*[F.max(F.when(F.col("_cut") == c, row)).alias(c) for c in places])


def upto(value: str, tie: str, row: Column) -> Column:
    """Whether a row stands at or before another one, given as (value, tie); null is the least value, and nothing stands before no row."""
    smaller = (F.col(value).isNull() & row["value"].isNotNull()) | F.coalesce(F.col(value) < row["value"], F.lit(False))
    return row.isNotNull() & (smaller | (F.col(value).eqNullSafe(row["value"]) & (F.col(tie) <= row["tie"])))


def least_from(found: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """found, rows of cumulated(), with the least of a column over this value and all greater ones of the group.

    Within a range by a window, over the ranges by their leasts: no window holds a whole group.
    """
    leasts = found.groupBy(*keys, "range").agg(F.min(value).alias("_least"))
    after = Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = leasts.select(*keys, "range", F.min("_least").over(after).alias("_carried"))
    own = Window.partitionBy(*keys, "range").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    return beside(found.withColumn("_own", F.min(value).over(own)), carried, [*keys, "range"]).withColumn(name, F.least("_own", "_carried")).drop("_own", "_carried")
