"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated 3-word windows). Texts
that fail the base rules go. The others form vectors of transformed statistics; per language and source a minimum
covariance determinant (MCD) estimate of centre and scatter is fitted, and a text whose Mahalanobis distance is too
large is rejected.

* Vector: log of characters per word; log1p of symbols per word; log1p of repeated lines per 100 words; square root of
  the repeated words' share; log of words.
* A start per group: medians and median deviations (with a floor for statistics that hardly vary) standardise the
  vectors. Then `STEPS` concentration steps: mean and covariance of the `KEEP` share of the group with the smallest
  distances, new distances from them; every step lowers the determinant. Quantiles come from mergeable sketches, means
  and products from partial sums, so a group with a third of all rows is combined before it is shuffled.
* Distances of a group that spreads more than its estimate says are scaled down until their median is the chi-square
  median; then they are compared with the cutoff, the 0.9999 quantile of chi-square with five degrees of freedom. The
  floors are such that half of the words repeated, or a repeated line to 16 words, is beyond it by itself in a group
  where nothing repeats.
* Groups of fewer than `LEAST` texts take the estimate of their language, languages below that the one of all texts.

Defined cases: a null text has no words and fails the base rules; a null language or source is a group value like any
other; repeated rows are judged alike; an empty table gives an empty table; only the named columns are read. The
3-word windows of a text are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.shared import BLANKS, ready, whole, written

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: name of a statistic: floor of its scale
FLOORS = {"u_length": 0.03, "u_symbols": 0.04, "u_lines": 0.35, "u_repeats": 0.13, "u_words": 0.5}
KEEP, STEPS, LEAST = 0.75, 3, 200
CHI_MEDIAN = 4.351  # median of chi-square with five degrees of freedom
CUTOFF = 25.745  # its 0.9999 quantile
ACCURACY = 2000


def _count_of(text: Column, characters: str) -> Column:
    """How often single-byte characters occur in a text."""
    total = F.lit(0)
    for c in characters:
        total = total + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return total


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more. `words` is a column, not an expression: it is used often."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.lit("\x00"), F.get(words, i + 1), F.lit("\x00"), F.get(words, i + 2)))

    def positions(g):
        # windows sorted by hash and place: a window repeats when a neighbour in this order has its hash
        ordered = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hits = F.transform(F.array(ordered), lambda s: F.transform(F.filter(s, lambda x, j: (
            F.get(s, j - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"]))[0]
        return F.sort_array(hits)

    def covered(at):
        # a window covers its three words, less those the next repeated window covers too
        return F.transform(F.array(at), lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))[0]

    def of(g):
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(positions(g)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(F.transform(F.array(grams), of)[0]).cast("long")


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: `doc_id, lang, source` and the base counts."""
    docs = documents.select("doc_id", "lang", "source", whole(text).alias("_text"))
    trimmed = F.btrim("_text", F.lit(BLANK_CHARS))
    split = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS)))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANK_CHARS)) != "")
    return split.select(
        "doc_id", "lang", "source", F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - _count_of(F.col("_text"), BLANK_CHARS)).cast("long").alias("word_chars"),
        _count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda own: F.size(own) - F.size(F.array_distinct(own)))[0].cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """`stats` with the transformed statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "u_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "u_symbols": F.log1p(F.col("n_symbols") / n),
        "u_lines": F.log1p(100 * F.col("n_dup_lines") / n), "u_repeats": F.sqrt(F.col("n_repeat_words") / n), "u_words": F.log(n)})


def _keyed(df: DataFrame, level: int | None = None) -> DataFrame:
    """Group key `g` of a level, or of the row's own `level`: 2 language and source, 1 language, 0 all."""
    at = F.col("level") if level is None else F.lit(level)
    parts = {"level": at, "lang": F.when(at >= 1, F.col("lang")), "source": F.when(at >= 2, F.col("source"))}
    return df.withColumn("g", F.to_json(F.struct(*[p.alias(k) for k, p in parts.items()]), {"ignoreNullFields": "false"}))


def _medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy("g").agg(*[F.percentile_approx(c, 0.5, ACCURACY).alias(f"m_{c}") for c in columns])


def _inverse_root(sums: DataFrame, d: int) -> DataFrame:
    """Mean and inverse Cholesky factor per group from counts, sums `s_i` and products `p_i_j`."""
    cov = sums.select("g", *[(F.col(f"s_{i}") / F.col("n")).alias(f"mu_{i}") for i in range(d)], *[
        (F.col(f"p_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * F.col(f"s_{j}") / F.col("n") ).alias(f"c_{i}_{j}")
        for i in range(d) for j in range(i + 1)])
    # no statistic varies less than its floor: larger diagonals keep the matrix positive
    cov = cov.withColumns({f"c_{i}_{i}": F.greatest(F.col(f"c_{i}_{i}"), F.lit(1.0)) for i in range(d)})
    for j in range(d):
        done = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        cov = cov.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - done, F.lit(1e-6))))
        cov = cov.withColumns({f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0)))
                               / F.col(f"l_{j}_{j}") for i in range(j + 1, d)}) if j + 1 < d else cov
    for i in range(d):
        cov = cov.withColumn(f"w_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
        cov = cov.withColumns({f"w_{i}_{j}": -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0))
                               / F.col(f"l_{i}_{i}") for j in range(i)}) if i else cov
    return cov.select("g", *[f"mu_{i}" for i in range(d)], *[f"w_{i}_{j}" for i in range(d) for j in range(i + 1)])


def _distance(d: int) -> Column:
    total = F.lit(0.0)
    for i in range(d):
        part = sum(((F.col(f"z_{j}") - F.col(f"mu_{j}")) * F.col(f"w_{i}_{j}") for j in range(i + 1)), F.lit(0.0))
        total = total + part * part
    return total


def estimates(rows: DataFrame) -> DataFrame:
    """Per group: medians, scales, MCD centre, inverse root of the scatter, and the factor that puts the median right."""
    names, d = list(FLOORS), len(FLOORS)
    middle = _medians(rows, names)
    middle = written(middle, "medians")
    spread = _medians(rows.join(middle, "g").select("g", *[F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names]),
                      names).withColumnsRenamed({f"m_{c}": f"v_{c}" for c in names})
    start = written(middle.join(spread, "g").select("g", *[f"m_{c}" for c in names], *[
        F.greatest(F.lit(floor), 1.4826 * F.col(f"v_{c}")).alias(f"s_{c}") for c, floor in FLOORS.items()]), "start")
    z = rows.join(start, "g").select(
        "g", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(f"z_{i}") for i, c in enumerate(names)])
    z = written(z, "standardised")
    zs = [f"z_{i}" for i in range(d)]
    far = z.withColumn("far", sum((F.col(c) * F.col(c) for c in zs), F.lit(0.0)))
    for step in range(STEPS):
        bound = written(far.groupBy("g").agg(F.percentile_approx("far", KEEP, ACCURACY).alias("bound")), f"bound{step}")
        near = far.join(bound, "g").where("far <= bound")
        sums = near.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(zs)], *[
            F.sum(F.col(zs[i]) * F.col(zs[j])).alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)])
        model = written(_inverse_root(sums, d), f"scatter{step}")
        far = z.join(model, "g").withColumn("far", _distance(d)).select("g", *zs, "far")
    scale = far.groupBy("g").agg(F.greatest(F.percentile_approx("far", 0.5, ACCURACY) / CHI_MEDIAN, F.lit(1.0)).alias("scale"))
    return start.join(model, "g").join(scale, "g")


def judged(documents: DataFrame, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """Per row: base counts, `base_failed`, `distance` (null where the base rules fail) and `kept`."""
    ready(documents.sparkSession)
    stats = written(statistics(documents, text), "statistics")
    vector = vectors(stats).where(~F.col("base_failed")).select("lang", "source", *FLOORS)
    counts = written(vector.groupBy("lang", "source").count(), "groups")
    by_lang = counts.groupBy("lang").agg(F.sum("count").alias("in_lang")).withColumnRenamed("lang", "_lang")
    level = counts.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "lang", "source", F.when(F.col("count") >= LEAST, 2).when(F.col("in_lang") >= LEAST, 1).otherwise(0).alias("level"))
    levels = written(_keyed(level, 2).select(F.col("g").alias("pair"), "level"), "levels")
    used = sorted(r["level"] for r in levels.select("level").distinct().collect())
    result = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if not used:
        return stats.select(*result, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    # every text counts in each level in use: a small group's language is estimated with it
    model = written(estimates(_keyed(vector.withColumn("level", F.explode(F.array(*map(F.lit, used)))))), "model")
    names = list(FLOORS)
    rows = _keyed(vectors(stats), 2).withColumnRenamed("g", "pair").join(levels, "pair", "left")
    placed = _keyed(rows).join(model, "g", "left").withColumns(
        {f"z_{i}": (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for i, c in enumerate(names)})
    scored = placed.withColumn("distance", F.when(F.col("base_failed"), None).otherwise(_distance(len(names)) / F.col("scale")))
    return scored.select(*result, "distance", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"))
