"""Set algebra, completeness of grids and keyed merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tagged_union(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.withColumn(tag, F.lit(name)) for name, t in tables.items()])


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given, which makes the choice repeatable."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def set_algebra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of both sets, of what they share, of their union and differences, and how they relate, in one join."""
    a = left.select(F.col(key).alias("k")).distinct().withColumn("_l", F.lit(1))
    b = right.select(F.col(key).alias("k")).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, "k", "full_outer").agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"), F.count("*").alias("n_union")
    )
    return both.select(
        "*", (F.col("n_left") - F.col("n_both")).alias("n_left_only"), (F.col("n_right") - F.col("n_both")).alias("n_right_only"),
        (F.col("n_both") == 0).alias("disjoint"), (F.col("n_both") == F.col("n_left")).alias("left_within"), (F.col("n_union") == F.col("n_both")).alias("equal"),
    )


def grid_gaps(rows: DataFrame, dims: dict[str, list | DataFrame]) -> DataFrame:
    """Cells of the cross product of the values that no row has, and cells of rows outside it. Values are listed, or the only column of a table."""
    spark = rows.sparkSession
    grid = None
    for name, values in dims.items():
        listed = values.distinct().toDF(name) if isinstance(values, DataFrame) else spark.createDataFrame([(v,) for v in values], [name])
        one = listed.select(F.col(name).cast(rows.schema[name].dataType))
        grid = one if grid is None else grid.crossJoin(one)  # as many rows as the listed values make
    found = rows.select(*dims).distinct()
    missing = grid.join(found, list(dims), "left_anti").withColumn("gap", F.lit("missing"))
    extra = found.join(grid, list(dims), "left_anti").withColumn("gap", F.lit("extra"))
    return missing.unionByName(extra)


def last_writer(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key, from the last table that has it."""
    ranked = reduce(DataFrame.unionByName, [t.withColumn("_turn", F.lit(i)) for i, t in enumerate(tables)])
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_turn")))).filter("_n = 1").drop("_n", "_turn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def equals(where: dict[str, str]) -> Column:
    """Rows whose columns equal all the texts given."""
    return reduce(lambda a, b: a & b, [F.col(c).cast("string") == v for c, v in where.items()], F.lit(True))


def not_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n) of the numeric columns with null, NaN or infinite values."""
    bad = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias("n")) for c in columns]
    return rows.agg(F.array(*bad).alias("_b")).select(F.inline("_b")).filter("n > 0")
