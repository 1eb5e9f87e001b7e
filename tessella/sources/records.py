"""Readers of records, split maps, runs, histories and sectioned text. All return DataFrames and read on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions.normalize import canonical_split

#: Columns that may hold the id and the split, in order of preference.
ID_COLUMNS = ("jid", "id", "material_id")
SPLIT_COLUMNS = ("split", "dataset_split", "subset", "partition", "set")
#: Keys of an entry of a split file's list that may name the split, and keys that mark a file of lists by split.
ENTRY_SPLITS = ("split", "dataset_split", "subset")
SPLIT_KEYS = ("train", "val", "valid", "validation", "test")
#: Keys of a list's entry that may hold its id, keys under which lists stand, beginnings of keys that are ids.
ENTRY_IDS = ("jid", "id", "jid_id", "file_id", "name")
LIST_KEYS = ("ids", "jids", "data", "entries", "samples")
ID_STARTS = ("JVASP-", "jid")
RUN_PATH = r"protocol_([^/]+)/([^/]+)/N(\d+)_seed(\d+)(?:/|$)"


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a top-level JSON array (or of one object for each line of several), with a stated schema; malformed text is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def _refused(what: str, value: Column) -> Column:
    """An error that names the value, as a text column."""
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(value, F.lit("null")))).cast("string")


def _needed(found: Column, what: str, value: Column) -> Column:
    """The text found; where there is none, an error."""
    return F.when(found.isNotNull() & (found != ""), found).otherwise(_refused(what, value))


def read_split_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(id, split) of a headed text table, whatever of the known names its columns have, in any case.

    Splits are canonical; a row without an id or with an unknown split is an error. Of an id's rows the last counts.
    """
    rows = spark.read.csv(path, header=True, sep=sep).withColumn("_at", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()))
    found = {c.lower(): c for c in reversed(rows.columns)}

    def pick(names: tuple[str, ...]) -> Column:
        name = next((found[n] for n in names if n in found), None)
        if name is None:
            raise ValueError(f"{path}: none of the columns {names}")
        return F.col(f"`{name}`")

    split = pick(SPLIT_COLUMNS)
    item = _needed(F.trim(pick(ID_COLUMNS)), "no id beside split", split)
    checked = rows.select(item.alias("id"), _needed(canonical_split(split), "unknown split", split).alias("split"), "_at")
    return checked.groupBy("id").agg(F.max_by("split", "_at").alias("split"))


def split_entries(text: Column) -> Column:
    """(id, split) entries of a split file's JSON, in its order: {split: [ids]}, {id: split} or [{id, split}].

    Splits are canonical. Of lists by split, those under unknown labels are left out; elsewhere an unknown split, a
    missing id or another form of JSON is an error.
    """

    def entry(item: Column, split: Column) -> Column:
        return F.struct(item.alias("id"), split.alias("split"))

    named = F.map_entries(F.from_json(text, "map<string,string>"))
    nothing = F.array().cast("array<struct<id:string,split:string>>")

    def listed(e: Column) -> Column:
        split = canonical_split(e["key"])
        ids = F.from_json(F.when(F.ltrim(e["value"]).startswith("["), e["value"]), "array<string>")
        wrong = F.array(entry(_refused("no list of ids", e["value"]), split))
        return F.when(split.isNull(), nothing).when(ids.isNull(), wrong).otherwise(F.transform(ids, lambda i: entry(i, split)))

    def stated(e: Column) -> Column:
        return entry(e["key"], _needed(canonical_split(e["value"]), "unknown split", e["value"]))

    def row(r: Column) -> Column:
        def first(keys: tuple[str, ...]) -> Column:
            return F.coalesce(*[F.nullif(F.try_element_at(r, F.lit(k)), F.lit("")) for k in keys])

        item, split = F.trim(first(ID_COLUMNS)), first(ENTRY_SPLITS)
        return entry(_needed(item, "no id beside split", split), _needed(canonical_split(split), "unknown split", split))

    rows = F.transform(F.from_json(text, "array<map<string,string>>"), row)
    by_split = F.exists(named, lambda e: F.lower(e["key"]).isin(*SPLIT_KEYS))
    body = F.ltrim(text)
    wrong = F.array(entry(_refused("neither an object nor a list", text), F.lit("")))
    of_object = F.when(by_split, F.flatten(F.transform(named, listed))).otherwise(F.transform(named, stated))
    found = F.when(body.startswith("["), rows).when(body.startswith("{"), of_object)
    return F.coalesce(found, F.when(text.isNotNull(), wrong))


def last_entries(rows: DataFrame, entries: Column) -> DataFrame:
    """(id, split): of an id's entries the last one counts."""
    long = rows.select(F.posexplode(entries).alias("ordinal", "entry"))
    return long.groupBy(F.col("entry.id").alias("id")).agg(F.max_by("entry.split", "ordinal").alias("split"))


def _entry_id(item: Column) -> Column:
    """The id of an entry of a list: itself, one of an object's keys, or what stands first in a list."""

    def keyed(t: Column) -> Column:
        return F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in ENTRY_IDS])

    first = F.get(F.from_json(F.when(item.startswith("["), item), "array<string>"), F.lit(0))
    of_list = F.when(first.startswith("{"), keyed(first)).when(~first.startswith("["), first)
    found = F.when(item.startswith("{"), keyed(item)).when(item.startswith("["), of_list).otherwise(item)
    return F.when(found.isNotNull(), found).otherwise(_refused("no id in", item))


def ids_of(text: Column, depth: int = 2) -> Column:
    """The ids in a JSON value: a list of entries, an object whose keys are ids, or one with such values under known keys, which are joined.

    Entries may be texts, numbers, objects with an id or lists that begin with one; an entry without an id and any other
    value are errors, as are known keys within known keys beyond the depth. Null gives no ids. Texts that begin with a
    bracket count as JSON.
    """
    body = F.trim(text)
    nothing = F.array().cast("array<string>")
    keys = F.json_object_keys(F.when(body.startswith("{"), body))
    are_ids = F.exists(keys, lambda k: k.startswith(ID_STARTS[0]) | k.startswith(ID_STARTS[1]))
    listed = F.transform(F.from_json(F.when(body.startswith("["), body), "array<string>"), _entry_id)
    if depth:
        inner = F.concat(*[ids_of(F.get_json_object(body, f"$.{k}"), depth - 1) for k in LIST_KEYS])
    else:
        known = F.exists(keys, lambda k: k.isin(*LIST_KEYS))
        inner = F.when(known, F.array(_refused("nested too deep", body))).otherwise(nothing)
    found = F.when(body.isNull() | (body == "null"), nothing).when(body.startswith("["), listed)
    return found.when(are_ids, keys).when(body.startswith("{"), inner).otherwise(F.array(_refused("no list of ids", body)))


def run_keys(path: Column) -> dict[str, Column]:
    """protocol, family, n and seed from the path of a run's file; null where the path is none."""
    part = lambda i: F.nullif(F.regexp_extract(path, RUN_PATH, i), F.lit(""))
    return {"protocol": part(1), "family": part(2), "n": part(3).cast("int"), "seed": part(4).cast("int")}


def read_runs(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """The JSON summaries under a glob, with the run's keys from their paths."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumns(run_keys(F.col("path"))).filter("seed is not null")


def history_losses(text: Column) -> Column:
    """The losses of a history's JSON: an array of numbers, or of arrays whose first element is the loss; an empty row is an error."""
    rows = F.from_json(text, "array<array<double>>")
    numbers = F.from_json(text, "array<double>")
    first = F.transform(rows, lambda r: F.when(F.size(r) > 0, F.get(r, F.lit(0))).otherwise(F.raise_error(F.lit("empty history row")).cast("double")))
    return F.when(F.exists(F.coalesce(rows, F.array()), lambda r: r.isNotNull()), first).otherwise(numbers)


def contiguous(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Whether the index of each group runs from 0 to its size less one without gap or repeat."""
    ok = (F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.countDistinct(index) == F.count("*"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), ok.alias("contiguous"))


def embedding_rows(metadata: DataFrame, matrix: DataFrame, source: str, families: list[str]) -> DataFrame:
    """The metadata of one source beside the matrix's rows: metadata columns and x, joined on embedding_index.

    matrix: (embedding_index, x). An error, when the result is read, if the source has no rows, its indices do not run from 0 without gap or
    repeat, the matrix has another number of rows, or a family is unknown.
    """
    own = metadata.filter(F.col("embedding_source") == source).withColumn("embedding_index", F.col("embedding_index").cast("long"))
    of_rows = own.agg(
        F.count("*").alias("n"), F.min("embedding_index").alias("low"), F.max("embedding_index").alias("high"), F.countDistinct("embedding_index").alias("kinds"),
        F.count_if(~F.col("family").isin(families) | F.col("family").isNull()).alias("odd"),
    )
    n = F.col("n")
    fault = F.when(n == 0, "no rows of the source").when((F.col("low") != 0) | (F.col("high") != n - 1) | (F.col("kinds") != n), "indices are not contiguous")
    fault = fault.when(F.col("m") != n, "the matrix has another number of rows").when(F.col("odd") > 0, "unknown family")
    checked = of_rows.join(matrix.agg(F.count("*").alias("m")), F.lit(True))  # one row
    checked = checked.select(F.when(fault.isNull(), 1).otherwise(F.raise_error(fault).cast("int")).alias("_ok"))
    failed = checked.filter("_ok = 0").select(F.lit(None).cast("long").alias("embedding_index"))  # no row, or the error
    return own.join(matrix, "embedding_index").unionByName(failed, allowMissingColumns=True)


def read_structure_list(spark: SparkSession, path: str) -> DataFrame:
    """(filename, target) of a headerless list; a line whose target is no number, such as a header, is left out."""
    rows = spark.read.schema("filename string, target string").csv(path)
    return rows.select(F.trim("filename").alias("filename"), F.trim("target").try_cast("double").alias("target")).filter("target is not null")


def sections(text: Column, mark: str = "## ") -> Column:
    """The sections (title, body) of a text whose headings begin lines with the mark; what stands before the first is left out."""
    pieces = F.split(F.concat(F.lit("\n"), text), "\n" + mark)
    split = F.transform(pieces, lambda p: F.split(p, "\n", 2))
    return F.transform(F.slice(split, 2, 1 << 30), lambda p: F.struct(F.trim(p[0]).alias("title"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("body")))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.inline(sections(F.col("value"))))


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a glob."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
