"""Writers. Tables are written by the executors; only report tables of a stated size are rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tessella.operators.sets import upsert

#: Rows that a report table may have, if its caller names no other number.
REPORT_ROWS = 1000


def _some(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("nothing to write")
    return rows


def write_csv(rows: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """The columns given, in their order, with a header; an empty table, and an existing path unless told so, are errors."""
    _some(rows).select(*columns).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, lineSep="\n", emptyValue="")


def without_nan(rows: DataFrame) -> DataFrame:
    """NaN and infinities made null, so that JSON can hold the rows."""
    fine = {f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)) for f in rows.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return rows.withColumns(fine) if fine else rows


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): each row with its keys in alphabetical order."""
    return without_nan(rows).select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    json_rows(rows).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_parquet(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def updated_table(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A summary table with the rows of new in place of those that have their keys, in order."""
    return upsert(old, new, keys).orderBy(*order)


def _report(rows: DataFrame, most: int) -> list[list[str]]:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report table has at most {most} rows")
    return [["" if v is None else str(v) for v in r] for r in found]


def markdown_table(rows: DataFrame, most: int = REPORT_ROWS) -> str:
    lines = [rows.columns, ["---"] * len(rows.columns), *_report(rows, most)]
    return "\n".join("| " + " | ".join(v.replace("|", "\\|") for v in line) + " |" for line in lines)


def latex_rows(rows: DataFrame, most: int = REPORT_ROWS) -> str:
    return "\n".join(" & ".join(v.replace("_", "\\_").replace("%", "\\%").replace("&", "\\&") for v in line) + r" \\" for line in _report(rows, most))
