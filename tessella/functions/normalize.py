"""Column functions that normalise labels, targets, ids, element lists and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The split labels that ingest takes, and those of the benchmark tool.
INGEST_SPLITS = {
    "train": "train", "training": "train", "tr": "train",
    "val": "val", "valid": "val", "validation": "val", "dev": "val",
    "test": "test", "te": "test", "holdout": "test",
}
BENCHMARK_SPLITS = {
    "train": "train", "training": "train", "trn": "train",
    "val": "val", "valid": "val", "validation": "val", "dev": "val",
    "test": "test", "testing": "test", "tst": "test",
}
#: Texts that mean a missing target.
NO_TARGET = ("", "na", "nan", "none", "null")


def canonical_split(label: Column, known: dict[str, str] | None = None, strict: bool = False) -> Column:
    """The split that a label names after trimming and lower-casing; others are null, or an error if strict."""
    pairs = F.create_map(*[F.lit(x) for kv in (known or INGEST_SPLITS).items() for x in kv])
    found = F.try_element_at(pairs, F.lower(F.trim(label)))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown split label: "), F.coalesce(label, F.lit("null"))))) if strict else found


def target(text: Column) -> Column:
    """The finite number that a text gives; missing marks, other texts, NaN and infinities are null."""
    clean = F.lower(F.trim(text.cast("string")))
    number = F.when(~clean.isin(*NO_TARGET), clean.try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def picked_target(fields: Column, aliases: list[str]) -> tuple[Column, Column]:
    """(target, alias used) from a map: the first alias that is a key decides, even if its value gives no target."""
    value = F.lit(None).cast("double")
    used = F.lit(None).cast("string")
    for alias in reversed(aliases):
        there = F.map_contains_key(fields, alias)
        value = F.when(there, target(F.try_element_at(fields, F.lit(alias)))).otherwise(value)
        used = F.when(there, F.lit(alias)).otherwise(used)
    return value, used


def first_id(*ids: Column) -> Column:
    """The first id that is neither null nor empty, trimmed; null if none is left."""
    found = F.coalesce(*[F.nullif(i.cast("string"), F.lit("")) for i in ids])
    return F.nullif(F.trim(found), F.lit(""))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def structure_file(item: Column) -> Column:
    return F.concat(F.lit("POSCAR-"), safe_id(item), F.lit(".vasp"))


def id_of_file(name: Column) -> Column:
    """The id in the name of a structure file; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^(?:.*/)?POSCAR-(.+)\.vasp$", 1), F.lit(""))


def hill_formula(elements: Column) -> Column:
    """Symbols with their counts, carbon first, then hydrogen, then by alphabet; a count of one is left out."""
    def with_count(s: Column) -> Column:
        n = F.size(F.filter(elements, lambda e: e == s))
        return F.concat(s, F.when(n > 1, n.cast("string")).otherwise(""))

    kinds = F.array_sort(F.array_distinct(F.array_compact(elements)))
    first = F.filter(F.array(F.lit("C"), F.lit("H")), lambda s: F.array_contains(kinds, s))
    return F.array_join(F.transform(F.concat(first, F.array_except(kinds, first)), with_count), "")


def element_stats(elements: Column) -> dict[str, Column]:
    return {"n_atoms": F.size(elements), "elements": F.array_join(elements, ";"), "unique_elements": F.array_join(F.array_sort(F.array_distinct(elements)), ";")}


def family_flags(elements: Column, oxygen: str = "O", nitrogen: str = "N") -> dict[str, Column]:
    """has_O, has_N and three families: oxides hold oxygen, nitrides nitrogen without oxygen, oxynitrides both."""
    o, n = F.array_contains(elements, oxygen), F.array_contains(elements, nitrogen)
    return {"has_O": o, "has_N": n, "is_oxide": o, "is_nitride": n & ~o, "is_oxynitride": o & n}


def filled_fields(columns: list[str]) -> Column:
    """How many of the columns are neither null nor blank."""
    filled = [(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).cast("int") for c in columns]
    total = F.lit(0)
    for f in filled:
        total = total + F.coalesce(f, F.lit(0))
    return total


def effect_sizes(tuned: Column, zero_shot: Column) -> dict[str, Column]:
    """delta and percent are positive where tuning hurts; gain is positive where it helps."""
    return {"delta_adapt": tuned - zero_shot, "percent_adapt": 100 * (tuned - zero_shot) / zero_shot, "transfer_gain": zero_shot - tuned}


def validation_size(n: Column) -> Column:
    """Rows set aside of n: a tenth, rounded half to even, at least five; where that takes all, a fifth, at least one."""
    tenth = F.greatest(F.lit(5), F.bround(n * F.lit(0.1)).cast("int"))
    return F.when(tenth >= n, F.greatest(F.lit(1), F.floor(n / 5).cast("int"))).otherwise(tenth)


def snippet(text: Column, start: Column, end: Column, width: int = 180) -> Column:
    """The text from width characters before start to width after end (places from 0), blanks collapsed."""
    low = F.greatest(F.lit(0), start - width)
    return F.trim(F.regexp_replace(F.substring(text, low + 1, end + width - low), r"\s+", " "))


def content_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))


def row_hash(columns: list[str]) -> Column:
    """The sha256 of a row's JSON, keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def moved_path(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def normal_keys(family: Column, *numbers: Column) -> list[Column]:
    return [F.lower(F.trim(family)), *[n.cast("int") for n in numbers]]
