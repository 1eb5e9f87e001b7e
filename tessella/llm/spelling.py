"""Groups of spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters share it, whatever the order, and
one letter more, less or another changes it by a value that depends on the letters alone. For each letter of a word the key
without it is laid out: where it equals another word's key, that word has a letter less; where it equals another key
without a letter, one letter is exchanged. So two equi-joins on keys find all words that may be near, with a row for each
letter of a word, and only those are compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import settle, stored, table
from tessella.llm.words import Tally, bytes_of, counted, latin, pieces, runs

#: Words have so many code points and occurrences at least.
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form occurs so many times as often as the word at least.
RATIO = 5
#: One of so many (document, run) loses a letter.
ONE_IN = 199
#: Letters count by this power of their code point, modulo a prime: words that only seem near are compared and dropped.
POWER = 5
MODULUS = (1 << 61) - 1


def _word_counts(min_length: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(["word"], ["n"])
        for batch in batches:
            before = [zlib.crc32(f"{x}:".encode()) for x in batch.column(0).to_pylist()]
            data, begins = bytes_of(batch.column(1))
            for part, starts, rows in pieces(data, begins, lambda x: ~latin(x) & (x < 128)):
                found, at = runs(part, starts, latin)
                terms = found.dictionary.cast(pa.string())
                size = np.asarray(pc.utf8_length(terms))
                code = np.asarray(found.indices)
                own = size[code] >= min_length
                if not own.any():
                    continue
                (row, term), n = counted(rows[at[own]], code[own])
                spelt = found.dictionary.to_pylist()
                hashed = np.fromiter(map(zlib.crc32, map(spelt.__getitem__, term.tolist()), map(before.__getitem__, row.tolist())), np.int64, len(row))
                hit = hashed % one_in == 0
                (kept,), total = counted(term[~hit], weights=n[~hit])
                words, times = [terms.take(pa.array(kept))], [total]
                shorter = [x[: h % len(x)] + x[h % len(x) + 1 :] for x, h in zip((spelt[t].decode() for t in term[hit].tolist()), hashed[hit].tolist(), strict=True)]
                long_enough = np.array([len(x) >= min_length for x in shorter], bool)
                words.append(pa.array([x for x, y in zip(shorter, long_enough, strict=True) if y], pa.string()))
                times.append(n[hit][long_enough])
                yield from tally.add(pa.table({"word": pa.concat_arrays(words), "n": np.concatenate(times)}))
        yield from tally.rest()

    return run


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """(word, n) of the words of all texts that are long and frequent enough, after the deletions that crc32 draws."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_word_counts(min_length, one_in), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")  # the code point of the first letter
    return code * code * code * code * code


def keyed(words: DataFrame) -> DataFrame:
    """words with size, key and less: the key, and for each distinct letter the key without it."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    key = F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: (s + _value(c)) % MODULUS)
    known = words.withColumn("letters", letters).withColumn("key", key)
    less = F.transform(F.array_distinct("letters"), lambda c: F.pmod(F.col("key") - _value(c), F.lit(MODULUS)))
    return known.select("word", "n", F.size("letters").alias("size"), "key", less.alias("less"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words that one letter more, less or exchanged tells apart, once.

    words: rows (word, n) without repeats. Words of one key, which differ in order alone, are never near.
    """
    known = stored(keyed(words), "spelling-keys")
    less = known.select("word", "n", "size", "key", F.explode("less").alias("at"))
    other = known.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("size").alias("b_size"), F.col("key").alias("at"))
    removed = less.join(other, "at").filter(F.col("size") == F.col("b_size") + 1)
    changed = less.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("size").alias("b_size"), F.col("key").alias("b_key"), "at")
    exchanged = less.join(changed, "at").filter((F.col("word") < F.col("b")) & (F.col("size") == F.col("b_size")) & (F.col("key") != F.col("b_key")))
    columns = [F.col("word").alias("a"), F.col("n").alias("a_n"), "b", "b_n"]
    both = removed.select(*columns).unionByName(exchanged.select(*columns))
    return both.filter(F.levenshtein("a", "b", 1) == 1).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: the last of the chain of forms. Every round doubles the steps taken."""
    now = settle(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ahead = settle(now.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved, now = ahead.filter("_moved").limit(1).count(), ahead.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, one_in: int = ONE_IN) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts, and the commoner words that they may be misspelt from.

    A word's form is its near word that occurs most, ties to the smaller one in code-point order, if that occurs ratio
    times as often; its root is the last of the forms that follow one from another. Null and empty texts have no words; a
    null doc_id is drawn as "null"; repeated rows count apart. Very long texts are read in pieces, very long words are
    words. An empty table gives no rows, and other columns of docs do not matter.
    """
    words = stored(vocabulary(docs, min_length, min_count, one_in), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-pairs")
    ways = pairs.select("a", "b", "b_n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = ways.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    formed = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    formed = stored(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "form_n"), "spelling-forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of all documents; see spelling_variants()."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def spelling_sql(docs: str = "documents", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, one_in: int = ONE_IN) -> str:
    """The rows of op13 in SQL: crc32 byte by byte, and near words by the words that one deletion leaves."""
    return f"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), found AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM {docs}
), counted AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM found WHERE length(run) >= {min_length} GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, bytes
), changed AS (
  SELECT CASE WHEN h % {one_in} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {min_length} GROUP BY 1 HAVING sum(n) >= {min_count}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS left_over FROM places),
removed AS (SELECT DISTINCT l.word AS a, l.n AS a_n, w.word AS b, w.n AS b_n FROM less l JOIN words w ON l.left_over = w.word),
near AS (
  SELECT a, b, b_n FROM removed UNION ALL SELECT b, a, a_n FROM removed
  UNION ALL SELECT x.word, y.word, y.n FROM less x JOIN less y ON x.left_over = y.left_over AND x.i = y.i AND x.word <> y.word
), best AS (SELECT a AS word, count(*) AS n_near, max(b_n) AS form_n, arg_min(b, (-b_n, encode(b))) AS form FROM near GROUP BY 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= {ratio} * w.n THEN b.form END AS form, CASE WHEN b.form_n >= {ratio} * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain(word, upto) AS (
  SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.upto = f.word WHERE f.form IS NOT NULL
), last AS (SELECT c.word, c.upto AS root FROM chain c JOIN formed f ON c.upto = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM formed f JOIN last l USING (word)"""
