"""Scans of prose and JSON for terms, headings and links."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranking import accepted_spans
from tessella.operators.storage import settled

_NO_SPANS = "cast(array() as array<struct<start:int,end:int,priority:int,term:string,found:string>>)"


def term_spans(text: Column, terms, plain: Column | None = None) -> Column:
    """(start, end, priority, term, found) of every match of the terms' patterns as whole words, any case; places from 0.

    Patterns come in order of priority. Matches of one pattern do not overlap, so their places follow from the pieces
    between them. A pattern is only tried on a text that holds one of its fixed words.
    """
    every, plain = [], _folded(text) if plain is None else plain
    for rank, (term, pattern) in enumerate(terms):
        regex = f"(?iU)(?<!\\w)(?:{pattern})(?!\\w)"
        found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        pieces = F.split(text, regex)
        state = F.struct(F.lit(0).alias("at"), F.expr(_NO_SPANS).alias("spans"))

        zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("0"), found.alias("1"))
        spans = F.aggregate(zipped, state, _placing(rank, term))["spans"]
        words = fixed_words(pattern)
        every.append(F.when(_any_of(plain, words), spans).otherwise(F.expr(_NO_SPANS)) if words else spans)
    return F.concat(*every)


def _folded(text: Column) -> Column:
    """Lower case as patterns that ignore case see it: three letters that lower() does not make plain match a plain one.

    Those are rare, and translate() looks every letter up, so it is only called where they stand.
    """
    return F.when(text.rlike("[\u017f\u0131\u0130]"), F.lower(F.translate(text, "\u017f\u0131\u0130", "sii"))).otherwise(F.lower(text))


def _any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))  # plain letters; one expression, however many words


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern, also where all of it is one group."""
    if pattern.startswith("(?:") and pattern.endswith(")"):
        depth = [pattern[: i + 1].count("(") - pattern[: i + 1].count(")") for i in range(len(pattern))]
        if min(depth[:-1]) > 0:
            return _branches(pattern[3:-1])
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def fixed_words(pattern: str) -> list[str]:
    """Words in lower case of which every match holds at least one, from the parts of each alternative that are neither optional nor choices; none if an alternative has none."""
    found = []
    for branch in _branches(pattern):
        bare = re.sub(r"\[[^\]]*\][*+?]?|\\.", " ", branch)
        while (less := re.sub(r"\([^()]*\)[*+?]?", " ", bare)) != bare:
            bare = less
        words = re.findall("[a-z]{3,}", re.sub(r"\w[*?]|\{[^}]*\}", " ", bare).lower())
        if not words:
            return []
        found.append(max(words, key=len))
    return found


def _placing(rank: int, term: str):
    """Moves past a piece and a match, and notes where the match stands."""

    def place(s: Column, z: Column) -> Column:
        start = s["at"] + F.length(z["0"])
        end = start + F.length(z["1"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("priority"), F.lit(term).alias("term"), z["1"].alias("found"))
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

    return place


#: The hyphens and blanks that may join the words of a term, and the terms with their patterns, in order of priority.
H = r"[ \t\u00a0\-\u2010-\u2015]+"
TERMS = (
    ("ood_penalty", rf"OOD{H}penalt(?:y|ies)"),
    ("out_of_distribution", rf"out{H}of{H}distribution"),
    ("in_distribution", rf"in{H}distribution"),
    ("oxide_pretrained", rf"oxide{H}pre[-\u2010-\u2015]?train(?:ed|ing)"),
    ("oxide_pretrained", rf"pre[-\u2010-\u2015]?train(?:ed|ing){H}(?:(?:primarily|exclusively){H})?(?:on|using){H}(?:the{H})?oxides?"),
    ("source_domain", rf"source{H}domain"),
    ("target_domain", rf"target{H}domain"),
    ("domain_gap", rf"domain{H}gap"),
    ("distribution_shift", rf"distribution{H}shift"),
    ("domain_shift", rf"domain{H}shift"),
    ("transfer_benefit", rf"transfer{H}benefit"),
    ("transfer_gain", rf"transfer{H}gain"),
    ("adaptation_onset", rf"adaptation{H}onset"),
    ("genuine_adaptation", rf"genuine{H}adaptation"),
    ("no_parameter_updates", rf"no{H}parameter{H}updates?"),
    ("byte_identity", rf"byte{H}identit(?:y|ical)"),
    ("zero_shot_state", rf"zero[-\u2010-\u2015]?shot{H}state"),
    ("checkpoint_pinned", rf"(?:pinned|does{H}not{H}move)"),
    ("inert", r"inert(?:ness)?"),
    ("causal_language", r"(?:explain(?:s|ed|ing|ation)?|caus(?:e|es|ed|ing|al|ally|ality)|driv(?:e|es|en|ing)|mechanis(?:m|ms|tic|tically))"),
    ("significance_language", r"signific(?:ant|antly|ance)"),
    ("robustness_language", r"robust(?:ness|ly)?"),
    ("generalization_language", r"generali[sz](?:e|es|ed|ing|ation|ability|able)"),
    ("ood", r"OOD"),
)


def term_matches(rows: DataFrame, text: str, terms=TERMS) -> DataFrame:
    """A row for each accepted match of the terms (name, pattern): leftmost first, of those the longest, then the pattern's place in the list."""
    keys = [c for c in rows.columns if c != text]
    lines = rows.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    words = [fixed_words(pattern) for _, pattern in terms]
    some = lines.filter(_any_of(_folded(F.col("line")), sorted({w for ws in words for w in ws}))) if all(words) else lines
    # within a function over one struct the line is folded once, and an outer generator does not ask for its spans twice
    both = F.array(F.struct(F.col("line").alias("line"), _folded(F.col("line")).alias("plain")))
    found = F.transform(both, lambda z: accepted_spans(term_spans(z["line"], terms, z["plain"])))[0]
    spans = some.select(*keys, (F.col("line_no") + 1).alias("line_no"), F.inline_outer(found)).filter("start is not null")
    return spans.select(*keys, "line_no", "start", "end", "term", "found")


def cell_units(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, source, text): the cells of the columns as units of text, each with the column as its source."""
    cells = F.array(*[F.struct(F.lit(f"csv:{c}").alias("source"), F.col(c).cast("string").alias("text")) for c in sorted(columns)])
    return rows.select(*keys, F.inline(cells)).filter("text is not null")


def leaf_units(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, source, text): the leaves of JSON texts as units of text, each with its pointer as its source."""
    return json_leaves(rows.select(*keys, json), json).select(*keys, F.concat(F.lit("json-pointer:"), "pointer").alias("source"), F.col("value").alias("text"))


def json_leaves(rows: DataFrame, text: str) -> DataFrame:
    """A row (other columns, pointer, value) for each text, number and boolean in JSON objects and arrays, however deep.

    Types tell a leaf, so a text that looks like JSON within JSON is a text. Keys with `~` or `/` are escaped, nulls are
    left out, and a text that is no JSON stands for itself. One level a round; what is left to open is kept between
    rounds, so the rows are read once.
    """
    keys = [c for c in rows.columns if c != text]
    nested = F.to_json("_v").rlike(r"^[{\[]")  # texts are quoted there
    parsed = rows.filter(F.col(text).isNotNull()).select(*keys, F.lit("").alias("_at"), F.try_parse_json(text).alias("_v"), F.col(text).alias("_own"))
    out = parsed.filter("_v is null").select(*keys, F.col("_at").alias("pointer"), F.col("_own").alias("value"))
    level = parsed.filter("_v is not null").drop("_own")
    escaped = F.replace(F.replace("_key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    while True:
        out = out.unionByName(level.filter(~nested & ~F.is_variant_null("_v")).select(*keys, F.col("_at").alias("pointer"), F.try_variant_get("_v", "$", "string").alias("value")))
        left = settled(level.filter(nested))
        if left.isEmpty():
            return out
        opened = left.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_key", "_child"))
        level = opened.select(*keys, F.concat("_at", F.lit("/"), F.coalesce(escaped, F.col("_pos").cast("string"))).alias("_at"), F.col("_child").alias("_v"))


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def selected_lines(text: Column, first: int, last: int, token: str | None = None) -> Column:
    """(line_no, line) of the lines from first to last (from 1) that hold the token, without the rules of tables."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    wanted = F.filter(lines, lambda e: e["line_no"].between(first, last) & ~e["line"].rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*$"))
    return F.filter(wanted, lambda e: e["line"].contains(token)) if token else wanted


def link_targets(text: Column) -> Column:
    """Local targets of the links in Markdown or HTML, without what follows `#`: no scheme, not within the page."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)\bhref\s*=\s*[\"']([^\"'\s]*)[\"']"), F.lit(1)))
    bare = F.transform(found, lambda t: F.regexp_replace(F.split_part(t, F.lit("#"), F.lit(1)), r"^<|>$", ""))
    return F.filter(bare, lambda t: (t != "") & ~t.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:)"))


def heading_order(text: Column, pattern: str = r"(?m)^#+ (S[0-9]+)") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
