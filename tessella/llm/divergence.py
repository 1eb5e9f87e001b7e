"""How far the sources of each language stand apart in their words: an exact audit of all pairs of sources.

A pair's distance is a sum over all kept terms, most of which at least one of the two lacks. By inclusion and exclusion
over the supports only the terms of both are looked at one by one: a histogram of a source's counts prices all its terms
against the other's price of nothing, the terms of neither come to a constant, and a join of postings corrects what
terms of both have been priced at. Postings are joined within blocks of terms and tiles of sources, so no task holds
more than a block, and a term that all sources share makes no rows for its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored, table
from tessella.llm.words import WIDE, Tally, bytes_of, counted, pieces, runs, wide

#: A language keeps the terms that so many of its documents hold.
MIN_DOCS = 30
#: Terms reported for each source.
TOP_TERMS = 50
#: Added to every count.
PRIOR = 5
#: The whole of a price.
UNIT = 1_000_000_000
#: Postings in a block of terms, about, and sources in a tile.
BLOCK_POSTINGS = 1 << 16
TILE_SOURCES = 256
#: Terms of a block that are laid out at once.
_TERMS_AT_ONCE = 2048
_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTS = "lang string, lo string, hi string, value long"


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in a source, and the documents that hold it, of the rows (lang, source, text)."""
    tally = Tally(["lang", "source", "term"], ["n", "docs"])
    for batch in batches:
        langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
        lang_of, source_of = (np.asarray(x.indices) for x in (langs, sources))
        data, begins = bytes_of(batch.column(2))
        last, seen = -1, set()  # of a text that comes in pieces
        for part, starts, rows in pieces(data, begins, lambda x: ~WIDE[x]):
            words, at = runs(part, starts, wide)
            if not len(words):
                continue
            terms, code = words.dictionary, np.asarray(words.indices)
            (row, term), n = counted(rows[at], code)
            docs = np.ones(len(n), np.int64)
            if len(rows) == 1:
                texts = terms.to_pylist()
                seen = seen if last == rows[0] else set()
                docs = np.array([texts[t] not in seen for t in term], np.int64)
                seen.update(texts)
            last = rows[-1]
            (lang, source, term_), docs = counted(lang_of[row], source_of[row], term, weights=docs)
            _, n = counted(lang_of[row], source_of[row], term, weights=n)
            yield from tally.add(pa.table({
                "lang": langs.dictionary.take(pa.array(lang)), "source": sources.dictionary.take(pa.array(source)),
                "term": terms.take(pa.array(term_)).cast(pa.string()), "n": n, "docs": docs,
            }))
    yield from tally.rest()


def _price(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / total) in exact arithmetic; 0 if there is no term at all."""
    exact = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)"), total.cast("decimal(19,0)"))
    return F.when(total > 0, 1 + exact).otherwise(F.lit(0)).cast("long")


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, opens) of the kept terms; opens marks one row of each term of a language."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(_term_counts, _COUNTS).repartition("lang", "term")
    summed = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source
    held = summed.withColumn("all_docs", F.sum("docs").over(term)).filter(F.col("all_docs") >= min_docs)
    return held.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), (F.col("source") == F.min("source").over(term)).alias("opens"))


def sources_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, terms, support, total, lang_total, zero): a row for each source of a language, also one without terms.

    terms: kept by the language; support: those that the source has; totals: counts with priors; zero: the price of none.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.count("*").alias("support"), F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("opens").alias("terms"))
    full = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    prior = PRIOR * F.col("terms")
    priced = full.select("lang", "source", "terms", "support", (F.col("n") + prior).alias("total"), (F.col("lang_n") + prior).alias("lang_total"))
    return priced.withColumn("zero", _price(F.lit(0), F.col("total")))


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms of each source cost against the other sources of a tile that have none of them, and what the terms of neither cost.

    A source's histogram is sorted by price, so a tile is priced by sums up to a place in it.
    """
    for batch in batches:
        for r in batch.to_pylist():
            hist = sorted(((x["price"], x["terms"]) for x in r["hist"] or []))
            price, n = (np.array([x[i] for x in hist], np.int64) for i in (0, 1))
            terms_to, cost_to = (np.concatenate(([0], np.cumsum(x))) for x in (n, n * price))
            others = [x for x in r["others"] if x["source"] != r["source"]]
            zero, support = (np.array([x[k] for x in others], np.int64) for k in ("zero", "support"))
            at = np.searchsorted(price, zero)
            value = zero * terms_to[at] - cost_to[at] + (cost_to[-1] - cost_to[at]) - zero * (terms_to[-1] - terms_to[at])
            names = [x["source"] for x in others]
            first = np.array([r["source"].encode() < x.encode() for x in names], bool)
            value += np.where(first, (r["terms"] - r["support"] - support) * np.abs(r["zero"] - zero), 0)
            lo, hi = ([a if f == want else b for a, b, f in zip([r["source"]] * len(names), names, first, strict=True)] for want in (True, False))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([r["lang"]] * len(names), pa.string()), "lo": pa.array(lo, pa.string()), "hi": pa.array(hi, pa.string()), "value": value})


def _shared(block: pa.Table) -> pa.Table:
    """What the terms that two sources of the block's tiles share cost beyond what one-sided prices and constants say."""
    names = block["source"].combine_chunks().dictionary_encode()
    order = np.argsort(np.array([x.encode() for x in names.dictionary.to_pylist()], object))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    source, term = place[np.asarray(names.indices)], np.asarray(block["term"].combine_chunks().dictionary_encode().indices)
    price, zeros = np.asarray(block["price"]), np.zeros(len(order), np.int64)
    zeros[source] = np.asarray(block["zero"])
    tile = np.zeros(len(order), np.int64)
    tile[source] = np.asarray(block["tile"])
    left, right = block["i"][0].as_py(), block["j"][0].as_py()
    value, met = (np.zeros((len(order), len(order)), np.int64) for _ in range(2))
    for low in range(0, int(term.max()) + 1, _TERMS_AT_ONCE):
        own = (term >= low) & (term < low + _TERMS_AT_ONCE)
        prices = np.full((min(_TERMS_AT_ONCE, int(term.max()) + 1 - low), len(order)), -1, np.int64)
        prices[term[own] - low, source[own]] = price[own]
        for s in range(len(order)):
            mine = prices[prices[:, s] >= 0]
            there, a = mine[:, s + 1 :] >= 0, mine[:, s, None]
            b, zero = mine[:, s + 1 :], zeros[s + 1 :]
            beyond = np.abs(a - b) - np.abs(a - zero) - np.abs(b - zeros[s]) + np.abs(zeros[s] - zero)
            value[s, s + 1 :] += np.where(there, beyond, 0).sum(0)
            met[s, s + 1 :] += there.sum(0)
    met[(tile[:, None] == tile[None, :]) != (left == right)] = 0  # two tiles: only pairs across them
    lo, hi = np.nonzero(met)
    ordered = names.dictionary.take(pa.array(order))
    return pa.table({"lang": pa.array([block["lang"][0].as_py()] * len(lo), pa.string()), "lo": ordered.take(pa.array(lo)), "hi": ordered.take(pa.array(hi)), "value": value[lo, hi]})


def _pairs(kept: DataFrame, groups: DataFrame, block_postings: int, tile_sources: int) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways."""
    largest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0  # two numbers reach the driver
    tiles, blocks = -(-largest // tile_sources) or 1, -(-kept.count() // block_postings) or 1
    groups = groups.withColumn("tile", F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int"))
    priced = kept.join(groups, ["lang", "source"]).withColumn("price", _price(F.col("n"), F.col("total")))
    hist = priced.groupBy("lang", "source", "price").agg(F.count("*").alias("terms"))  # at most the root of twice the count
    hist = hist.groupBy("lang", "source").agg(F.collect_list(F.struct("price", "terms")).alias("hist"))
    others = groups.groupBy("lang", "tile").agg(F.collect_list(F.struct("source", "zero", "support")).alias("others"))
    each = groups.drop("tile").join(hist, ["lang", "source"], "left").join(others, "lang")
    single = each.select("lang", "source", "terms", "support", "zero", "hist", "others").mapInArrow(_one_sided, _PARTS)
    meets = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda u: F.struct(F.least(u, F.col("tile")).alias("i"), F.greatest(u, F.col("tile")).alias("j")))
    placed = priced.select("lang", "source", "term", "price", "zero", "tile", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), F.explode(meets).alias("at"))
    spread = placed.select("lang", "source", "term", "price", "zero", "tile", "block", "at.i", "at.j")
    double = spread.groupBy("lang", "block", "i", "j").applyInArrow(_shared, _PARTS)
    summed = single.unionByName(double).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    ways = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("lo", "hi"), ("hi", "lo"))])
    return summed.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_postings: int = BLOCK_POSTINGS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each two sources of a language are apart, and each source's own terms.

    Part pair: the sum over all kept terms of the difference of their prices in the two sources, every other source of
    the language ranked. Part term: the terms that the source uses more than its language does, by the difference, the
    first so many. Null lang, source and text are empty ones; texts without a term still make their source appear, as do
    languages that keep no term (distances 0). Very long texts are read in pieces, repeated rows count apart, ties go to
    the item that is smaller in UTF-8, an empty table gives no rows, and other columns of docs do not matter.
    """
    kept = stored(postings(docs, min_docs), "divergence-postings")
    groups = stored(sources_of(docs, kept), "divergence-sources")
    pairs = _pairs(kept, groups, block_postings, tile_sources).withColumn("part", F.lit("pair"))
    own = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        (_price(F.col("n"), F.col("total")) - _price(F.col("lang_n"), F.col("lang_total"))).alias("value"), F.lit("term").alias("part"),
    ).filter("value > 0")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    first = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; see divergence()."""
    return divergence(table(spark, sf_dir, "documents"))


def divergence_sql(docs: str = "documents", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    """The rows of op11 in SQL, every pair term by term."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM {docs}
), w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
keep AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= {min_docs}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM keep GROUP BY 1),
own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN keep USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN own USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n,
         1 + ({UNIT}::HUGEINT * (coalesce(o.n, 0) + {PRIOR})) // (t.total + {PRIOR} * v.v) AS p,
         1 + ({UNIT}::HUGEINT * (k.lang_n + {PRIOR})) // (v.lang_total + {PRIOR} * v.v) AS q
  FROM totals t JOIN v USING (lang) JOIN keep k USING (lang) LEFT JOIN own o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term
), far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
