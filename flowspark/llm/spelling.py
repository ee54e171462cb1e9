"""Spelling variants by permuterm rotations, in DataFrame functions.

1. `vocabulary`: words of the whole corpus with their counts, combined before the shuffle.
2. `rotations`: of a word w, marked by a terminator, the rotations that end in one of its letters are listed with that
   letter skipped, and all rotations of w itself in full. Two words that differ by one replaced letter share a listed
   prefix; a word from which a letter was deleted is itself the prefix that the other word lists. So both kinds of
   neighbours stand together once the rotations are sorted, and no pair has to be tried.
3. Groups of equal prefixes are scanned in sorted order, one window over each: a group holds the words that fit one
   pattern with one free letter, at most one for each letter of the alphabet, and the word without the letter. Every
   member emits how many neighbours it has there and the best of them, not a row for each.
4. A word's neighbours over all its groups are counted, its form is the best of them; roots follow forms by doubling
   joins. A form has at least `RATIO` times the count of its word, so chains are as short as the log of the counts.

A neighbour by replacement differs at one place, so it is met in one group. A letter deleted from a stretch of equal
letters gives the same word at each of them: only the first of the stretch meets the shorter word.

Defined cases: a null text has no words; a null `doc_id` deletes no letter; repeated rows count each; of neighbours with
equal counts the smallest in code-point order is the form; an empty table, or one without frequent words, gives an empty
table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.periods import CRC_TABLE, crc32_sql
from flowspark.llm.shared import LOWER, UPPER, ready, whole, written
from flowspark.plans.scale import lookup_join

LETTERS = r"[^A-Za-zÀ-ÿ]+"
EDIT = 199          # one in so many words of a document loses a letter
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
END = "\u0001"      # the terminator, no letter


def edited_words(documents: DataFrame, text: str = "text", edit: int | None = EDIT) -> DataFrame:
    """`(word)`: every word of the texts, A-Z lowered, some with a letter deleted by a hash of document and word."""
    runs = F.split(F.translate(whole(text), UPPER, LOWER), LETTERS)
    words = documents.select(F.col("doc_id").cast("string").alias("d"), F.explode(runs).alias("w")).where("w <> ''")
    if edit is None:
        return words.select(F.col("w").alias("word"))
    hashed = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return words.withColumn("h", hashed).select(F.when(F.col("h") % edit == 0, cut).otherwise(F.col("w")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """`(word, n)` of the words that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """`(prefix, word, n, skips, first)`: `skips` tells whether a letter was skipped, `first` whether it begins a stretch of equal
    letters."""
    size = F.length("word")
    cuts = F.sequence(F.lit(0), size)

    def letter(at: Column) -> Column:
        return F.substring("word", at + 1, F.lit(1))

    def turned(at: Column, skip: int) -> Column:
        return F.concat(F.substring("word", at + 1 + skip, size), F.lit(END), F.substring("word", F.lit(1), at))

    skipped = F.transform(F.slice(cuts, F.lit(1), size), lambda i: F.struct(
        turned(i, 1).alias("prefix"), F.lit(True).alias("skips"), ((i == 0) | (letter(i) != letter(i - 1))).alias("first")))
    full = F.transform(cuts, lambda i: F.struct(turned(i, 0).alias("prefix"), F.lit(False).alias("skips"), F.lit(False).alias("first")))
    return words.select("word", "n", F.explode(F.concat(skipped, full)).alias("r")).select("r.prefix", "word", "n", "r.skips", "r.first")


def neighbours(words: DataFrame) -> DataFrame:
    """`(word, n, n_near, near_n, near)`: number of words at distance one, count and text of the best, null without any."""
    own = F.struct((-F.col("n")).alias("down"), F.col("word").alias("word"))
    # skipping members first, best first; the group's own word, if any, comes last
    group = Window.partitionBy("prefix").orderBy(F.col("skips").desc(), F.col("n").desc(), "word")
    all_of = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = rotations(words).select(
        "word", "n", "skips", "first",
        F.sum(F.col("skips").cast("int")).over(all_of).alias("skipping"), F.sum(F.col("first").cast("int")).over(all_of).alias("firsts"),
        F.min(F.when(~F.col("skips"), own)).over(all_of).alias("bare"), F.min(F.when(F.col("first"), own)).over(all_of).alias("best_first"),
        F.nth_value(F.when(F.col("skips"), own), 1).over(all_of).alias("one"), F.nth_value(F.when(F.col("skips"), own), 2).over(all_of).alias("two"))
    beside = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))  # best other skipping member
    meets = F.col("first") & F.col("bare").isNotNull()
    near = F.when(~F.col("skips"), F.col("best_first")).otherwise(F.least(beside, F.when(meets, F.col("bare"))))
    count = F.when(~F.col("skips"), F.col("firsts")).otherwise(F.col("skipping") - 1 + meets.cast("int"))
    met = scanned.select("word", "n", count.alias("k"), near.alias("near")).where("k > 0")
    none = words.select("word", "n", F.lit(0).alias("k"), F.lit(None).cast(met.schema["near"].dataType).alias("near"))
    return met.unionByName(none).groupBy("word").agg(
        F.first("n").alias("n"), F.sum("k").cast("long").alias("n_near"), F.min("near").alias("near")).select(
        "word", "n", "n_near", (-F.col("near.down")).alias("near_n"), F.col("near.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """`(word, root)` of `forms (word, form)`: forms followed to the last, twice as far in each round."""
    links = written(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = lookup_join(links, further, ["root"], "left")
        links = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("moved")


def variants(documents: DataFrame, text: str = "text", edit: int | None = EDIT, ratio: int = RATIO) -> DataFrame:
    """Per word: `form`, `root`, `n`, `n_near`, `form_n`."""
    ready(documents.sparkSession)
    words = written(vocabulary(edited_words(documents, text, edit)), "spelling-words")
    near = neighbours(words)
    strong = F.col("near_n") >= ratio * F.col("n")
    formed = written(near.select("word", F.when(strong, F.col("near")).alias("form"), "n", "n_near",
                                 F.when(strong, F.col("near_n")).alias("form_n")), "spelling-forms")
    last = roots(formed.where("form IS NOT NULL"))
    joined = lookup_join(formed, last, ["word"], "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT w, n, {crc32_sql("x")} AS h FROM (SELECT w, n, hex(encode(doc_id || ':' || w)) AS x FROM counted), crc),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM less x JOIN less y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM less x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM less x JOIN words y ON x.a || x.b = y.word),
counts AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
best AS (SELECT word, near, near_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS r FROM pairs) WHERE r = 1),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN counts USING (word) LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM formed UNION ALL
  SELECT k.word, k.next, f.form FROM walk k JOIN formed f ON k.next = f.word)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON f.word = k.word AND k.next IS NULL
"""
