"""Audits: each returns the rows that break a rule, or a verdict beside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema_faults(rows: DataFrame, required: list[str], exact: bool = False) -> list[str]:
    """Columns that are missing, and with exact also a differing order or further columns."""
    faults = [f"missing:{c}" for c in required if c not in rows.columns]
    return faults + ["header differs"] if exact and not faults and rows.columns != required else faults


def coded(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds codes: the names of the rules that hold for a row; a rule that is null does not."""
    return rows.withColumn("codes", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()])))


def verdicts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds status and failed: PASS where every named check holds, else FAIL and the names of those that don't, joined by commas."""
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])), ",")
    return rows.withColumn("failed", failed).withColumn("status", F.when(F.col("failed") == "", "PASS").otherwise("FAIL"))


def close(a: Column, b: Column, relative: float = 1e-10, absolute: float | Column = 1e-12) -> Column:
    """Whether two numbers agree within the greater tolerance; two nulls agree."""
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), absolute if isinstance(absolute, Column) else F.lit(absolute))
    return F.coalesce(near, a.isNull() & b.isNull())


def recomputed(supplied: DataFrame, computed: DataFrame, keys: list[str], values: list[str], relative: float = 1e-10, absolute: float = 1e-12) -> DataFrame:
    """Rows of either table that have no partner, or whose values differ: keys, and the names of the values that do."""
    a = supplied.select(*keys, F.struct(*values).alias("_a"))
    b = computed.select(*keys, F.struct(*values).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    differs = F.array_join(F.array_compact(F.array(*[F.when(~close(F.col(f"_a.{v}"), F.col(f"_b.{v}"), relative, absolute), F.lit(v)) for v in values])), ",")
    fault = F.when(F.col("_a").isNull(), "not supplied").when(F.col("_b").isNull(), "not computed").otherwise(differs)
    return joined.select(*keys, fault.alias("fault")).filter("fault <> ''")


def matches_display(actual: Column, displayed: Column) -> Column:
    """Whether a number is what is displayed, within half a unit of the last decimal place shown; other texts must be equal.

    The last place follows from the decimals and the exponent of the text. Whole numbers, and those shown in tens or
    hundreds, allow no more than 1e-10 of the value, or 1e-12.
    """
    number = r"^\s*[+-]?[0-9]*\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\s*$"
    shown, value = displayed.try_cast("double"), actual.try_cast("double")
    power = F.coalesce(F.nullif(F.regexp_extract(displayed, number, 2), F.lit("")).cast("int"), F.lit(0))
    last = power - F.length(F.regexp_extract(displayed, number, 1))
    half = F.when(last < 0, F.lit(0.5) * F.pow(F.lit(10.0), last)).otherwise(0.0)
    near = close(value, shown, absolute=F.greatest(half, F.lit(1e-12)))
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(actual == displayed, True).when(shown.isNotNull() & value.isNotNull(), finite & near).otherwise(F.trim(actual) == F.trim(displayed))


def json_at(text: Column, pointer: str) -> Column:
    """The value that an RFC 6901 pointer names in JSON text, as text; null if there is none."""
    if pointer == "":
        return text
    if not pointer.startswith("/"):
        raise ValueError(f"not a pointer: {pointer}")
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer[1:].split("/")]
    out = text
    for s in steps:
        by_key = F.get_json_object(out, "$['" + s.replace("'", "\\'") + "']")
        out = F.when(out.rlike(r"^\s*\["), F.get_json_object(out, f"$[{int(s)}]")).otherwise(by_key) if s.isdigit() else by_key
    return out


def only_cell(rows: DataFrame, where: Column, column: str) -> DataFrame:
    """One row: the cell of the single row that meets the condition; none or several are an error."""
    n = F.count("*")
    return rows.filter(where).agg(F.when(n == 1, F.first(F.col(column).cast("string"))).otherwise(F.raise_error(F.concat(F.lit("rows that match: "), n)).cast("string")).alias("value"))


def constant(rows: DataFrame, column: str, expected_rows: int) -> DataFrame:
    """One row: the value that a column has in each of the expected number of rows; other numbers and several values are errors."""
    n, text = F.count("*"), F.col(column).cast("string")
    one = (F.countDistinct(text) + F.max(text.isNull().cast("int"))) == 1
    fault = F.when(n != expected_rows, F.concat(F.lit(f"expected {expected_rows} rows, found "), n)).otherwise(f"{column} is not constant")
    return rows.agg(F.when((n == expected_rows) & one, F.min(text)).otherwise(F.raise_error(fault).cast("string")).alias("value"))


def row_count(rows: DataFrame) -> DataFrame:
    """One row: how many rows there are, as text."""
    return rows.agg(F.count("*").cast("string").alias("value"))


def cell_difference(rows: DataFrame, where: Column, left: str, right: str) -> DataFrame:
    """One row: left less right in the single row that meets the condition; none or several are an error."""
    return only_cell(rows.withColumn("_difference", F.col(left).cast("double") - F.col(right).cast("double")), where, "_difference")


def array_length(text: Column, pointer: str) -> Column:
    """How many elements the array has that a pointer names in JSON text; null where there is none."""
    return F.json_array_length(json_at(text, pointer))


#: What a finished run of the protocol has.
RUN = {"epochs": 50, "batch_size": 16, "learning_rate": 1e-4, "groups": ("fc", "gcn_layers.3"), "parameters": 330241}


def run_checks(expected: dict = RUN) -> dict[str, Column]:
    """The seventeen named checks of a run, over a frame of its recorded and recomputed values; for verdicts().

    Columns: train_epochs, val_epochs, epochs, batch_size, learning_rate, best_epoch and val_best and mae with their
    recorded_ namesakes, prediction_ids, test_ids, fixed_ids (arrays), n_finite, size, n_train, n_val, n_test, n_shared,
    seed, recorded_seed, groups (array), parameters.
    """
    c = F.col
    n = F.size("prediction_ids")
    return {
        "history_lengths": (c("train_epochs") == expected["epochs"]) & (c("val_epochs") == expected["epochs"]),
        "summary_epochs": c("epochs") == expected["epochs"],
        "batch_size": c("batch_size") == expected["batch_size"],
        "learning_rate": close(c("learning_rate"), F.lit(expected["learning_rate"]), 0.0, 1e-12),
        "best_epoch_matches": c("recorded_best_epoch") == c("best_epoch"),
        "best_val_matches": close(c("recorded_val_best"), c("val_best"), 0.0, 1e-10),
        "mae_matches": close(c("recorded_mae"), c("mae"), 0.0, 1e-10),
        "prediction_count": n == c("n_test"),
        "prediction_ids_unique": F.size(F.array_distinct("prediction_ids")) == n,
        "prediction_ids_match_split": c("prediction_ids") == c("test_ids"),
        "fixed_test_ids": c("test_ids") == c("fixed_ids"),
        "all_predictions_finite": c("n_finite") == n,
        "split_counts": (c("n_train") + c("n_val") == c("size")) & (F.size("test_ids") == c("n_test")),
        "splits_disjoint": c("n_shared") == 0,
        "config_seed": c("recorded_seed") == c("seed"),
        "unfrozen_groups": c("groups") == F.array(*[F.lit(g) for g in expected["groups"]]),
        "trainable_parameter_count": c("parameters") == expected["parameters"],
    }


def contained(path: str, root: str) -> bool:
    """Whether a relative or absolute path stays within a root after its dots are followed."""
    import posixpath

    full = posixpath.normpath(posixpath.join(root, path))
    base = posixpath.normpath(root)
    return full == base or full.startswith(base.rstrip("/") + "/")


def drift(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: how many values two authorities share, how many differ at all, and by how much at most."""
    joined = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys)
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("_a") != F.col("_b")).alias("n_differ"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest"))


def table_digest(rows: DataFrame) -> DataFrame:
    """One row: the number of rows and a digest that does not depend on their order, for comparing two runs."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))
