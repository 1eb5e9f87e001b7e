"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its five-word shingles (a shorter line is one token: all of it). Tokens are ordered by rarity, and
two lines that are similar enough share a token among the first few of each (prefix filter) at places that still allow
enough overlap (positional filter), and are of like size (length filter). What is left is verified by the exact Jaccard
similarity of the sets. A line goes if an earlier line is equal or similar: the lines that share a token are first held
against the earliest of them, which settles groups of copies in linear time, and only those that it does not settle
against all others.

Most lines share no token with any other, or only a phrase. A prefix filter in the order of the tokens' hashes, which
needs no counts and asks for several common tokens, screens those out before. All tokens of the lines that are left are counted exactly; those that only one line has come
first in its order, so only the others travel back to it, and a line whose lonely tokens fill its prefix is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh, stored, table

SHINGLE = 5
#: Jaccard similarity from which a later line goes, as a fraction.
SIMILAR = (4, 5)
#: Lines whose ids are broadcast at most: some 80 bytes each.
BROADCAST_ROWS = 1_000_000
_LAST = 9223372036854775807
_BLANKS = " \t\x0b\f\r"
#: How many of a line's first tokens must stand in other lines too, for the screen to keep it; lines of few tokens need fewer.
MEETINGS = 3
#: The low bits of a token that give way to the size of its line in the screen; larger sizes count as the largest.
_SIZE_BITS = 16
#: More than an array has.
_REST = 1 << 30


def _odd(text: Column) -> Column:
    """Whether the text has other blanks within a line than single spaces."""
    return text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\f")


def _bare(line: Column, odd: Column) -> Column:
    """The line without blanks at its ends; where there are none but spaces, by the trim that is much faster."""
    return F.when(odd, F.trim(line, F.lit(_BLANKS))).otherwise(F.trim(line))


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc, doc_hash, line_no, line): the lines that are not blank, their words joined by one space; line_no from 0."""
    text = F.col("text").cast("string")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("doc_hash"), _odd(text).alias("odd"), text.alias("text"))
    rows = marked.select("doc", "doc_hash", "odd", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bare = _bare(F.col("line"), F.col("odd"))
    clean = F.when(F.col("odd") & _odd(bare), F.regexp_replace(bare, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(bare)
    return rows.filter(bare != "").select("doc", "doc_hash", "line_no", clean.alias("line"))


def _place() -> Column:
    """Where a line stands, as one number; null ids come last."""
    return F.coalesce(F.col("doc"), F.lit(_LAST)).cast("decimal(38,0)") * F.lit(4294967296).cast("decimal(11,0)") + F.col("line_no")


def _long(lines: DataFrame) -> DataFrame:
    """The lines of SHINGLE words or more."""
    return lines.filter(F.octet_length(F.substring_index("line", " ", SHINGLE - 1)) < F.octet_length("line"))


def tokens(line: Column) -> Column:
    """The hashes of the shingles of a line of SHINGLE words or more, each once and in order."""

    def bound(value: Column, use) -> Column:  # evaluates value once
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def shingles(h: Column) -> Column:
        return F.transform(F.slice(h, SHINGLE, _REST), lambda last, i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE - 1)], last))

    return F.sort_array(F.array_distinct(bound(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), shingles)))


def _needed(m: Column) -> Column:
    """Of how many tokens a similar line must at least share one of the first."""
    a, b = SIMILAR
    return (m - F.floor((m * a + b - 1) / b) + 1).cast("int")


def _may_match(m1: Column, p1: Column, m2: Column, p2: Column) -> Column:
    """Length and positional filter for tokens at places p1 and p2 (from 0) of lines of m1 and m2 tokens."""
    a, b = SIMILAR
    fits = F.least(m1, m2) * b >= F.greatest(m1, m2) * a
    return fits & ((1 + F.least(m1 - p1, m2 - p2) - 1) * (a + b) >= (m1 + m2) * a)


def screened(lines: DataFrame) -> DataFrame:
    """(id): the lines that, in the order of the tokens' hashes, share some of their first tokens with other lines of like size.

    Two similar lines have the least MEETINGS of their common tokens, or all of fewer, among the first of each, if both
    show MEETINGS - 1 tokens more than one common token would take. So a line goes on only if so many of its rows meet
    rows of others; a line that shares a phrase by chance seldom does. Copies of a line may count a meeting twice, which
    keeps lines rather than losing any. Two tokens of one line that agree in all bits above the size would count as one
    meeting; like a clash of two lines' ids, that is left to chance.

    A row is the line's id and one number: the token, with the line's size in its low bits. Tokens of a single line go
    first, by a window that needs no order. Within a token the rows left stand in the order of size, so a line of like
    size is there if and only if one stands beside it.
    """
    a, b = SIMILAR
    most = (1 << _SIZE_BITS) - 1
    sets = _long(lines).select("id", tokens(F.col("line")).alias("toks")).withColumn("m", F.size("toks"))
    index = sets.select("id", "m", F.explode_outer(F.slice("toks", F.lit(1), _needed(F.col("m")) + (MEETINGS - 1))).alias("tok"))
    key = F.col("tok").bitwiseAND(F.lit(~most)).bitwiseOR(F.least("m", F.lit(most)).cast("long"))
    bucket = F.shiftright("key", _SIZE_BITS)
    alike = Window.partitionBy(bucket)
    rows = index.select("id", key.alias("key")).repartition(bucket)
    rows = rows.select("id", "key", F.min("id").over(alike).alias("least"), F.max("id").over(alike).alias("most")).filter("least < most")
    beside = alike.orderBy("key", "id")
    met = rows.select("id", "key", *[f(c).over(beside).alias(n + c) for f, n in ((F.lag, "before_"), (F.lead, "after_")) for c in ("id", "key")])
    size, before, after = (F.col(c).bitwiseAND(F.lit(most)) for c in ("key", "before_key", "after_key"))
    found = ((F.col("before_id") != F.col("id")) & (before * b >= size * a)) | ((F.col("after_id") != F.col("id")) & (size * b >= after * a))
    meetings = met.filter(found).groupBy("id").agg(F.count("*").alias("n"), F.max(size).alias("m"))
    return meetings.filter(F.col("n") >= F.least(F.lit(MEETINGS), F.ceil(F.col("m") * a / b))).select("id")


def shared_tokens(lines: DataFrame, able: DataFrame) -> DataFrame:
    """(key, place, m, toks) of the able lines that may match: m tokens in all, and in toks those that other able lines have too, rarest first.

    lines: (line, doc, line_no, id), copies included; able: (key, id, place).
    """
    own = able.withColumnRenamed("id", "able_id")
    first = (F.col("id") == F.col("able_id")) & (_place() - F.col("place") == 0)  # no key, so places are reckoned for able lines only
    sets = _long(lines).join(own, first).select("key", tokens(F.col("line")).alias("toks"))
    # outer: else the planner would compute the tokens a second time, to leave out lines that have none
    rows = sets.select("key", F.size("toks").alias("m"), F.explode_outer("toks").alias("tok"))
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("tok"))).filter("n > 1")
    ordered = counted.groupBy("key").agg(F.max("m").alias("m"), F.sort_array(F.collect_set(F.struct("n", "tok"))).alias("toks"))
    matching = ordered.filter(F.col("m") - F.size("toks") < _needed(F.col("m")))
    return matching.join(able.select("key", "place"), "key").select("key", "place", "m", F.col("toks.tok").alias("toks"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key): the later lines of the pairs (key, key0) whose sets are similar enough."""
    a, b = SIMILAR
    later = sets.select("key", F.col("m").alias("m1"), F.col("toks").alias("s1"))
    earlier = sets.select(F.col("key").alias("key0"), F.col("m").alias("m0"), F.col("toks").alias("s0"))
    both = pairs.join(earlier, "key0").join(later, "key")
    shared = F.size(F.array_intersect("s1", "s0"))
    return both.filter(shared * b >= (F.col("m1") + F.col("m0") - shared) * a).select("key").distinct()


def _side(rows: DataFrame, name: str, broadcast_rows: int) -> DataFrame:
    """The rows, written; broadcast in the next join if there are no more than the checked number of them, else shuffled."""
    rows = stored(rows, name)
    return F.broadcast(rows) if rows.count() <= broadcast_rows else rows


def similar_lines(lines: DataFrame, firsts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(place, id) of the lines that resemble an earlier one.

    lines: (line, doc, line_no, id), copies included; firsts: (id, place) of the earliest copy of each.
    """
    passed = _side(screened(lines), "lines-screened", broadcast_rows)
    able = firsts.join(passed, "id", "left_semi").select("id", "place", F.monotonically_increasing_id().alias("key"))
    able = _side(able, "lines-able", broadcast_rows)
    sets = stored(shared_tokens(lines, able), "line-sets")
    lonely = F.col("m") - F.size("toks")
    prefix = F.posexplode(F.slice("toks", F.lit(1), _needed(F.col("m")) - lonely)).alias("at", "tok")
    index = sets.select("key", "place", "m", lonely.alias("lonely"), prefix).select("key", "place", "m", (F.col("lonely") + F.col("at")).alias("pos"), "tok")
    index = stored(index, "line-index")
    heads = index.groupBy("tok").agg(F.min(F.struct("place", "key", "m", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = index.join(heads.select("tok", "first"), "tok").filter(F.col("first.place") < F.col("place"))
    near = met.filter(_may_match(F.col("m"), F.col("pos"), F.col("first.m"), F.col("first.pos")))
    settled = stored(_verified(near.select("key", F.col("first.key").alias("key0")).distinct(), sets), "lines-settled")
    open_ = met.join(settled, "key", "left_anti").select("tok", "place", "key", "m", "pos", F.col("first.key").alias("held"))
    other = index.select(F.col("tok").alias("tok0"), *[F.col(c).alias(f"{c}0") for c in ("place", "key", "m", "pos")])
    meets = (F.col("tok") == F.col("tok0")) & (F.col("place0") < F.col("place")) & (F.col("key0") != F.col("held"))
    rest = open_.join(other, meets & _may_match(F.col("m"), F.col("pos"), F.col("m0"), F.col("pos0"))).select("key", "key0").distinct()
    return able.join(settled.unionByName(_verified(rest, sets)).distinct(), "key").select("place", "id")


def removed_lines(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc, doc_hash, line_no) of every line that goes."""
    rows = _line_rows(docs).withColumn("id", F.xxhash64("line"))
    rows = stored(rows.select("doc", "doc_hash", "line_no", "line", "id", F.xxhash64(F.lit(1), "line").alias("id2")), "lines")
    slim = rows.drop("line")
    firsts = stored(slim.groupBy("id", "id2").agg(F.min(_place()).alias("place"), F.count("*").alias("n")), "lines-first")
    gone = similar_lines(rows.select("line", "doc", "line_no", "id"), firsts.select("id", "place"), broadcast_rows)
    gone = gone.select("id", F.col("place").alias("first_place"), F.lit(True).alias("gone"))
    gone = _side(gone, "lines-gone", broadcast_rows)
    marked = firsts.withColumnRenamed("place", "first_place").join(gone, ["id", "first_place"], "left")
    marked = marked.filter((F.col("n") > 1) | F.col("gone")).select("id", "id2", "first_place", "gone")
    both = slim.join(_side(marked, "lines-marked", broadcast_rows), ["id", "id2"])
    return both.filter((_place() > F.col("first_place")) | F.col("gone")).select("doc", "doc_hash", "line_no")


def removed_by_document(docs: DataFrame) -> DataFrame:
    """(doc, doc_hash, removed): the numbers of the lines that go, ascending, of the documents that lose any."""
    return removed_lines(docs).groupBy("doc", "doc_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines taken out of their texts that equal or resemble an earlier line, and n_chars, where there is one, set anew.

    Lines stand in the order of doc_id (null last), then of the text; of rows that repeat a doc_id the lines at one
    number stand at one place, and neither of them goes for the other. Blank lines stay. Null and empty texts stay as
    they are, every row stays; further columns are kept, whatever their names. Of equal lines (ties) the one at the
    first place stays. A long text is worked off in time linear in its lines; it must fit into a row several times over.
    An empty table gives an empty result.
    """
    doc, own_hash, removed = fresh(docs, "doc", "hash", "removed")
    gone = removed_by_document(docs).select(F.col("doc").alias(doc), F.col("doc_hash").alias(own_hash), F.col("removed").alias(removed))
    own = F.xxhash64(F.col("text").cast("string"))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (own == F.col(own_hash)), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    kept = F.get(F.transform(F.array(lines), lambda ls: F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n")), F.lit(0))
    out = joined.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        anew = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(anew))
    return out.select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): per row of docs its lines that are not blank, and the numbers of those that go, joined by commas.

    Nulls, ties, repeated rows, long texts and empty tables are as in dedup_lines(); further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")  # all but the lines of spaces alone
    n_lines = F.when(_odd(text), F.size(F.filter(filled, lambda x: F.trim(x, F.lit(_BLANKS)) != ""))).otherwise(F.size(filled)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("doc_hash"), n_lines.alias("n_lines"))
    gone = removed_by_document(docs)
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc"]) & (rows["doc_hash"] == gone["doc_hash"]), "left")
    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return joined.select("doc_id", "n_lines", n_removed.alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def line_sql(docs: str = "documents") -> str:
    """The rows of op1 in SQL, from the named table with distinct doc_ids."""
    a, b = SIMILAR
    shingle = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(SHINGLE))
    return f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {docs}),
raw AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS l FROM split),
occurrences AS (SELECT doc_id, line_no, trim(regexp_replace(l, '[ \\t\\x0B\\f\\r]+', ' ', 'g')) AS line FROM raw),
rows_ AS (SELECT doc_id, line_no, line, coalesce(doc_id, {_LAST})::HUGEINT * 4294967296 + line_no AS place FROM occurrences WHERE line <> ''),
firsts AS (SELECT line, min(place) AS place, row_number() OVER () AS id FROM rows_ GROUP BY line),
words AS (SELECT id, place, string_split(line, ' ') AS ws FROM firsts),
sets AS (SELECT id, place, list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: {shingle})) AS s FROM words WHERE len(ws) >= {SHINGLE}),
toks AS (SELECT id, place, len(s) AS m, unnest(s) AS t FROM sets),
shared AS (
  SELECT x.id, any_value(x.m) AS m1, any_value(y.m) AS m0, count(*) AS n FROM toks x JOIN toks y ON x.t = y.t AND y.place < x.place
  WHERE least(x.m, y.m) * {b} >= greatest(x.m, y.m) * {a} GROUP BY x.id, y.id
),
gone AS (SELECT DISTINCT id FROM shared WHERE n * {b} >= (m1 + m0 - n) * {a}),
marked AS (SELECT r.doc_id, r.line_no FROM rows_ r JOIN firsts f USING (line) WHERE r.place > f.place OR f.id IN (SELECT id FROM gone)),
counts AS (SELECT doc_id, count(*) AS n_lines FROM rows_ GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM {docs} d LEFT JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id LEFT JOIN lost l ON d.doc_id IS NOT DISTINCT FROM l.doc_id"""
