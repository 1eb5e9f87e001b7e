"""Mixing sources to target weights, by temperature.

A source's share of all tokens is raised to an exponent and the results are normalised: exponent 1 keeps the natural mix,
0 makes all sources equal. The exponent is found by bisection so that the mix meets a target entropy, or as low as a
limit on repetition allows. The weights are then realised in blocks. Each source's documents are dealt to as many blocks
as the whole mix has, every block takes whole epochs and of the last one the documents that come first in the block's own
permutation until its share of the budget is spent; what a block overspends on its last document another saves. A block
never holds more than its share of a source, so no source, however large, is ordered in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored, table
from tessella.operators.distribution import cumulated

#: Share of the way from the natural mix's entropy to that of equal sources that the mix goes.
ENTROPY_GAIN = 0.5
#: A source is repeated at most so often.
MAX_REPEATS = 4.0
#: Tokens in a block of the mix, about.
BLOCK_TOKENS = 250_000
#: Sources whose weights are broadcast at most, some 100 bytes each; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: A document counts as so many parts where a share ends within it.
PARTS = 1 << 20
#: Halvings of the exponent's interval.
STEPS = 50
_NO_SOURCE = ""


def tokens_of(text: Column) -> Column:
    """Words between spaces, as a long; null and blank texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def _hashed(*parts: Column) -> Column:
    """The first 40 bits of the md5 of the parts, as a long that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 10), 16, 10).cast("long")


def temperature(totals: DataFrame, gain: float = ENTROPY_GAIN, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, tokens, exponent, weight) of rows (source, tokens); sources without tokens have weight 0.

    The greatest exponent at which the entropy is at least gain of the way from the natural to the equal mix, or a
    greater one if a source would otherwise be repeated more than max_repeats times to give as many tokens as there are.
    One row holds the list of the sources, which are categories and few, and all halvings are one expression over it.
    """
    listed = totals.filter("tokens > 0").agg(F.array_sort(F.collect_list("tokens")).alias("sizes"), F.sum("tokens").alias("total"))
    shares = listed.select(F.transform("sizes", lambda n: n / F.col("total")).alias("shares"), "total")

    def normal(a: Column) -> Column:
        return F.aggregate("shares", F.lit(0.0), lambda s, x: s + F.pow(x, a))

    def entropy(a: Column) -> Column:
        z = normal(a)
        return F.aggregate("shares", F.lit(0.0), lambda s, x: s - F.pow(x, a) / z * F.log(F.pow(x, a) / z))

    def repeats(a: Column) -> Column:  # the smallest share is repeated most
        least = F.array_min("shares")
        return F.pow(least, a) / normal(a) / least

    aim = entropy(F.lit(1.0)) + gain * (F.log(F.size("shares").cast("double")) - entropy(F.lit(1.0)))

    def bisect(keeps_high) -> Column:
        def halve(s, _):
            middle = (s["low"] + s["high"]) / 2
            high = keeps_high(middle)
            return F.struct(F.when(high, s["low"]).otherwise(middle).alias("low"), F.when(high, middle).otherwise(s["high"]).alias("high"))

        start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["high"]

    targets = shares.withColumn("aim", aim)
    exponents = targets.select(
        "shares", "total",
        F.greatest(bisect(lambda a: entropy(a) < F.col("aim")), bisect(lambda a: repeats(a) <= max_repeats)).alias("exact"),
    ).select("shares", "total", F.round("exact", 9).alias("exponent"))
    weights = exponents.select("exponent", F.col("total").alias("all_tokens"), normal(F.col("exponent")).alias("normal"))
    joined = totals.join(F.broadcast(weights), F.lit(True), "left")  # one row
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all_tokens"), F.col("exponent")) / F.col("normal")).otherwise(0.0)
    return joined.select("source", "tokens", F.coalesce("all_tokens", F.lit(0)).alias("all_tokens"), F.coalesce("exponent", F.lit(1.0)).alias("exponent"), weight.alias("weight"))


def _carried(placed: DataFrame) -> DataFrame:
    """(_source, _home, _over) of the blocks that take the document in which their share of a source ends.

    The parts of these documents within the shares are added up from the longest document to the shortest, and one is
    taken whenever the sum passes a whole number: so the tokens of those taken exceed the parts by one document at most.
    Parts are whole numbers of PARTS, and the sums run within ranges of the order and then over the ranges, so that no
    window holds all blocks of a source.
    """
    part = F.floor(F.col("_left") / F.col("_tokens") * PARTS).cast("long")
    place = (F.lit(1 << 31) - F.col("_tokens")) * F.lit(1 << 32) + F.col("_home")  # by falling length, then block
    ends = placed.filter("_left > 0 and _left < _tokens").select("_source", "_home", part.alias("part"), place.alias("value"))
    summed = cumulated(ends, ["_source"], ["part"])  # a row for each block, not for each document
    wholes = [F.floor((x + (PARTS - 1)) / PARTS) for x in (F.col("part_below"), F.col("part_below") + F.col("part"))]
    return summed.filter(wholes[1] > wholes[0]).select("_source", "_home", F.lit(True).alias("_over"))


def mix(
    docs: DataFrame, gain: float = ENTROPY_GAIN, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS,
    tokens: str | None = None, tie: str | None = None,
) -> DataFrame:
    """docs as the mix shows them, with mix_epoch (from 0), mix_block and mix_order (place within the block, from 1).

    As many tokens as docs have are shared out by weight. A source that gets r times its tokens stands there whole
    floor(r) times, and for the rest every block takes, in the order of its permutation, the documents that end before
    the block's share is spent. Of the documents that the shares end in, so many are taken, spread over all lengths, that
    a source gets its tokens and at most its longest document more. Epochs of one document lie in different blocks where there are several. Null
    sources are one source, documents without a token are left out, repeated rows count apart and are ordered together;
    an empty table gives an empty result. Columns of docs named like the new ones are replaced, all others kept, whatever
    their names. A long text goes whole into a block. Ties in a permutation go by the id's text, then the text's hash. tokens and tie name
    columns that hold the number of tokens and the md5 of the text, where they are known.
    """
    names = [c for c in docs.columns if c not in ("mix_epoch", "mix_block", "mix_order")]
    count = F.col(tokens) if tokens else tokens_of(F.col("text").cast("string"))
    mark = F.col(tie) if tie else F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    source = F.coalesce(F.col("source").cast("string"), F.lit(_NO_SOURCE))
    totals = docs.select(count.alias("tokens"), source.alias("source")).filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    weights = temperature(totals, gain, max_repeats).select(
        F.col("source").alias("_source"), (F.col("weight") * F.col("all_tokens") / F.col("tokens")).alias("_repeats"),
        F.greatest(F.lit(1), F.ceil(F.col("all_tokens") / block_tokens)).cast("long").alias("_blocks"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")  # so that no name of theirs meets one of these
    rows = docs.select(row, key.alias("_key"), count.alias("_tokens"), source.alias("_source"), mark.alias("_mark"), _hashed(F.lit("mix"), key).alias("_draw"))
    key = F.col("_key")
    few = stored(weights, "mix-weights")
    dealt = rows.join(F.broadcast(few) if few.count() <= BROADCAST_SOURCES else few, "_source").withColumn("_home", F.col("_draw") % F.col("_blocks")).filter("_tokens > 0")
    permuted = Window.partitionBy("_source", "_home").orderBy("_draw", key, "_mark").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_source", "_home")
    fraction = F.col("_repeats") - F.floor("_repeats")
    placed = dealt.withColumn("_left", fraction * F.sum("_tokens").over(whole) - F.coalesce(F.sum("_tokens").over(permuted), F.lit(0)))
    over = _carried(placed).toDF("_of", "_at", "_over")  # a row for each source and block at most
    placed = placed.join(over, (F.col("_source") == F.col("_of")) & (F.col("_home") == F.col("_at")), "left")
    spent = (F.col("_left") >= F.col("_tokens")) | ((F.col("_left") > 0) & F.col("_over").isNotNull())
    counted = placed.withColumn("_times", F.floor("_repeats").cast("int") + spent.cast("int")).filter("_times > 0")
    shown = counted.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    shown = shown.withColumn("mix_block", (F.col("_home") + F.col("mix_epoch") * F.greatest(F.lit(1), F.floor(F.col("_blocks") / 4))) % F.col("_blocks"))
    order = Window.partitionBy("mix_block").orderBy(_hashed(F.lit("order"), F.col("mix_epoch").cast("string"), key), key, "mix_epoch", "_mark")
    return shown.withColumn("mix_order", F.row_number().over(order)).select("_row.*", "mix_epoch", "mix_block", "mix_order")


def op2_mixing(spark: SparkSession, sf_dir: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, n_tokens, and the place of each showing in the mix."""
    text = F.col("text").cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", tokens_of(text).alias("n_tokens"), F.md5(F.coalesce(text, F.lit(""))).alias("mark"))
    mixed = mix(stored(docs, "mixing"), tokens="n_tokens", tie="mark", block_tokens=block_tokens)
    return mixed.select("doc_id", "source", "n_tokens", "mix_epoch", "mix_block", F.col("mix_order").cast("long").alias("mix_order"))


def mixing_sql(docs: str = "documents", block_tokens: int = BLOCK_TOKENS) -> str:
    """The rows of op2 in SQL, from the named table."""
    return f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, text, coalesce(source, '') AS src,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n
  FROM {docs}
), d AS (SELECT * FROM counted WHERE n > 0),
t AS (SELECT src, sum(n)::DOUBLE AS n FROM d GROUP BY src),
s AS (SELECT src, n, n / (SELECT sum(n) FROM t) AS p FROM t),
base AS (SELECT -sum(p * ln(p)) + {ENTROPY_GAIN} * (ln(count(*)) + sum(p * ln(p))) AS aim, min(p) AS least FROM s),
halved(i, lo, hi, rlo, rhi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
         CASE WHEN e < aim THEN lo ELSE (lo + hi) / 2 END, CASE WHEN e < aim THEN (lo + hi) / 2 ELSE hi END,
         CASE WHEN r <= {MAX_REPEATS} THEN rlo ELSE (rlo + rhi) / 2 END, CASE WHEN r <= {MAX_REPEATS} THEN (rlo + rhi) / 2 ELSE rhi END
  FROM (
    SELECT h.i, h.lo, h.hi, h.rlo, h.rhi, b.aim,
           (SELECT ln(sum(pow(p, (h.lo + h.hi) / 2))) - sum(pow(p, (h.lo + h.hi) / 2) * ln(pow(p, (h.lo + h.hi) / 2))) / sum(pow(p, (h.lo + h.hi) / 2)) FROM s) AS e,
           (SELECT pow(min(p), (h.rlo + h.rhi) / 2) / sum(pow(p, (h.rlo + h.rhi) / 2)) / min(p) FROM s) AS r
    FROM halved h, base b WHERE h.i < {STEPS}
  )
), a AS (SELECT round(greatest(hi, rhi), 9) AS a FROM halved WHERE i = {STEPS}),
w AS (
  SELECT src, pow(p, a) / (SELECT sum(pow(p, a)) FROM s, a) * (SELECT sum(n) FROM t) / n AS r,
         greatest(1, ceil((SELECT sum(n) FROM t) / {block_tokens}))::BIGINT AS blocks
  FROM s, a
), dealt AS (
  SELECT d.*, r, blocks, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 10))::BIGINT AS draw
  FROM d JOIN w USING (src)
), homes AS (SELECT *, draw % blocks AS home FROM dealt),
spent AS (
  SELECT *, (r - floor(r)) * sum(n) OVER (PARTITION BY src, home)
            - coalesce(sum(n) OVER (PARTITION BY src, home ORDER BY draw, coalesce(doc_id::VARCHAR, 'null'), md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM homes
), ends AS (SELECT src, home, n, floor(left_over / n * {PARTS})::BIGINT AS part FROM spent WHERE left_over > 0 AND left_over < n),
summed AS (SELECT src, home, part, sum(part) OVER (PARTITION BY src ORDER BY n DESC, home) AS upto FROM ends),
carried AS (SELECT src, home FROM summed WHERE (upto + {PARTS - 1}) // {PARTS} > (upto - part + {PARTS - 1}) // {PARTS}),
more AS (SELECT s.*, left_over >= s.n OR (left_over > 0 AND c.src IS NOT NULL) AS more FROM spent s LEFT JOIN carried c ON s.src = c.src AND s.home = c.home),
shown AS (
  SELECT *, unnest(range(floor(r)::BIGINT + more::BIGINT)) AS mix_epoch FROM more
), placed AS (SELECT *, (home + mix_epoch * greatest(1, blocks // 4)) % blocks AS mix_block FROM shown)
SELECT doc_id, source, n::BIGINT AS n_tokens, mix_epoch::INTEGER AS mix_epoch, mix_block::BIGINT AS mix_block,
       row_number() OVER (PARTITION BY mix_block ORDER BY ('0x' || substr(md5('order:' || mix_epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 10))::BIGINT,
                          coalesce(doc_id::VARCHAR, 'null'), mix_epoch, md5(text))::BIGINT AS mix_order
FROM placed"""
