"""Mixing sources to target weights by temperature, in DataFrame functions alone.

1. A source's share is its part of all tokens (words between blanks) of the corpus, from one partial aggregate.
2. Its weight is share ^ exponent, normalised. The exponent is bisected until the weights' entropy meets the target
   (a fraction of the entropy of equal weights, reached by lowering the exponent) while no source is repeated more
   often than the limit (met by raising it again; the limit wins). A pass over the sources' shares evaluates the
   midpoints of five bisection levels at once; the driver only sees sums, so the number of sources is free.
3. The weights are realised against a token budget (all tokens, unless given): a source gets weight * budget tokens,
   that is so many whole passes over its documents and a rest. Its documents are dealt to blocks by a hash and
   permuted inside them by the same hash; the rest takes documents in that order, block by block, as long as their
   start lies below the rest's tokens. Running sums are taken per block and then over the blocks' totals, so a
   source with a third of all rows is as many windows as it has blocks.

The permutation is by MD5 of seed, id, and text, so it is the same on every run and in every engine.

Defined cases: a null source is a source of its own; a null or blank text has no tokens, its document goes with the
whole passes and with the rest where its place lies below the budget; a source without tokens has weight 0 and each
document of it stays once; repeated rows are tied in the permutation and share their place (all of them go or stay);
one source alone has weight 1; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.shared import free_name, ready, whole, words, written
from flowspark.plans.scale import lookup_join

ENTROPY = 0.97  # of the entropy of equal weights
REPEATS = 4.0  # passes over a source at most
SEED = "mix-1"
BLOCK_TOKENS = 100_000
LEVELS, PASSES = 5, 8


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shares(counted: DataFrame, source: str = "source") -> DataFrame:
    """`(source, tokens, n_docs, share)`; one row per source."""
    sums = written(counted.groupBy(F.col(source).alias("source")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    total = sums.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    return sums.withColumn("share", F.col("tokens") / F.lit(float(total)) if total else F.lit(0.0))


def _measure(table: DataFrame, exponents: list[float], budget_of_total: float) -> list[tuple[float, float]]:
    """Entropy of the weights and most passes over one source, for each exponent, from one aggregate."""
    live = table.where("share > 0")
    exprs = []
    for i, a in enumerate(exponents):
        power = F.pow("share", F.lit(a))
        exprs += [F.sum(power).alias(f"z{i}"), F.sum(power * a * F.log("share")).alias(f"l{i}"), F.max(F.pow("share", F.lit(a - 1))).alias(f"m{i}")]
    row = live.agg(*exprs).first()
    # entropy of p_i = q_i / z with q = share^a is log z - sum(q log q) / z
    import math

    return [(math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"] * budget_of_total)
            for i in range(len(exponents))]


def exponent(table: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget_of_total: float = 1.0) -> float:
    """Largest exponent in [0, 1] that meets the entropy target, raised to the smallest that keeps the repetition limit."""
    import math

    n = table.where("share > 0").count()
    if n < 2:
        return 1.0
    target = entropy * math.log(n)

    def bisect(holds) -> float:
        """Boundary of a condition that holds at 0 and may fail further up."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            steps = 2 ** LEVELS
            inner = [low + (high - low) * k / steps for k in range(1, steps)]
            found = [holds(*m) for m in _measure(table, inner, budget_of_total)]
            # walk the levels as single bisections would
            a, b = 0, steps
            while b - a > 1:
                middle = (a + b) // 2
                a, b = (middle, b) if found[middle - 1] else (a, middle)
            low, high = low + (high - low) * a / steps, low + (high - low) * b / steps
        return low

    (at_one, passes_at_one), (_, passes_at_zero) = _measure(table, [1.0, 0.0], budget_of_total)
    found = 1.0 if at_one >= target else bisect(lambda h, _: h >= target)
    if passes_at_zero > repeats and passes_at_one <= repeats:
        found = max(found, bisect(lambda _, most: most > repeats))
    elif passes_at_one > repeats:
        found = 1.0
    return found


def plan(documents: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", entropy: float = ENTROPY,
         repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row `(key, text_md5, source, tokens, weight, block, place, copies)`: how often the document goes into the mix."""
    ready(documents.sparkSession)
    order = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(whole(text))))
    counted = written(documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), token_count(whole(text)).alias("tokens"),
                                       F.md5(whole(text)).alias("text_md5"), order.alias("order")), "counted")
    table = shares(counted)
    total = table.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    limit = total if budget is None else budget
    alpha = exponent(table, entropy, repeats, limit / total if total else 1.0)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(alpha))).otherwise(0.0)
    norm = table.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    weighted = table.withColumn("weight", power / F.lit(norm)).withColumn("due", F.floor(F.col("weight") * F.lit(float(limit))).cast("long"))
    weighted = weighted.select(
        F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "weight",
        F.when(F.col("tokens") > 0, F.floor(F.col("due") / F.col("tokens"))).otherwise(1).cast("long").alias("passes"),
        F.when(F.col("tokens") > 0, F.col("due") % F.col("tokens")).otherwise(0).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"))
    rows = counted.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())
    dealt = lookup_join(rows, weighted, ["_source", "_none"], "inner").withColumn(
        # the leading 32 bits of the order cut the source into blocks of equal width
        "block", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("blocks") / F.lit(4294967296)).cast("long"))
    blocks = dealt.groupBy("_source", "_none", "block").agg(F.sum("tokens").alias("_sum"))
    by_source = Window.partitionBy("_source", "_none").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(F.col("_source").alias("_s"), F.col("_none").alias("_n"), F.col("block").alias("_b"),
                           F.coalesce(F.sum("_sum").over(by_source), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_none", "block").orderBy("order")
    placed = dealt.withColumn("_upto", F.sum("tokens").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))) \
        .withColumn("_own", F.sum("tokens").over(Window.partitionBy("_source", "_none", "block", "order")))
    joined = placed.join(before, (F.col("_source") == F.col("_s")) & (F.col("_none") == F.col("_n")) & (F.col("block") == F.col("_b")))
    place = (F.col("_before") + F.col("_upto") - F.col("_own")).alias("place")
    return joined.select("doc_id", "text_md5", "source", "tokens", "weight", "block", place,
                         (F.col("passes") + (place < F.col("rest")).cast("long")).alias("copies"))


def mixed(documents: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """`documents` as the mix holds them: each row as often as planned, none where it is left out.

    A null text has no tokens, a null source is a source of its own; repeated rows get the same number of copies each; an
    empty table stays empty; extra columns, whatever their names, are carried along.
    """
    planned = plan(documents, text, source, key, **options)
    digest = free_name(documents, "_digest")
    keyed = documents.withColumn(digest, F.md5(whole(text)))
    # equal rows have equal plans, so one line per id, source and text serves all of them
    own = {c: free_name(keyed, f"_{c}") for c in ("id", "src", "md5", "copies", "copy")}
    lines = planned.groupBy(F.col("doc_id").alias(own["id"]), F.col("source").alias(own["src"]), F.col("text_md5").alias(own["md5"])).agg(
        F.first("copies").alias(own["copies"]))
    joined = keyed.join(lines, keyed[key].eqNullSafe(lines[own["id"]]) & keyed[source].eqNullSafe(lines[own["src"]]) & (keyed[digest] == lines[own["md5"]]))
    return joined.where(F.col(own["copies"]) > 0).withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.col(own["copies"])))).select(*documents.columns)


ORACLE = rf"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))) AS ord,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents),
sums AS (SELECT source, sum(tokens)::BIGINT AS tokens, sum(tokens) / (SELECT sum(tokens) FROM counted)::DOUBLE AS share FROM counted GROUP BY source),
list AS (SELECT list(share) AS s, count(*) AS n, sum(tokens)::BIGINT AS total FROM sums),
e(step, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT step, low, high, mid, ln(list_sum(q)) - list_sum(list_transform(q, lambda x: x * ln(x))) / list_sum(q) >= {ENTROPY} * ln(n) AS ok
    FROM (SELECT *, (low + high) / 2 AS mid, list_transform(s, lambda x: pow(x, (low + high) / 2)) AS q FROM e, list WHERE step < {LEVELS * PASSES}))),
r(step, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT step, low, high, (low + high) / 2 AS mid,
      list_max(list_transform(s, lambda x: pow(x, (low + high) / 2 - 1))) / list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2))) > {REPEATS} AS ok
    FROM r, list WHERE step < {LEVELS * PASSES})),
alpha AS (SELECT greatest(
  CASE WHEN list_sum(list_transform(s, lambda x: -x * ln(x))) >= {ENTROPY} * ln(n) THEN 1.0 ELSE (SELECT max(low) FROM e) END,
  CASE WHEN list_max(list_transform(s, lambda x: 1 / x)) / n > {REPEATS} THEN (SELECT max(low) FROM r) ELSE 0.0 END) AS a FROM list),
weighted AS (SELECT source, tokens, pow(share, a) / (SELECT sum(pow(share, a)) FROM sums, alpha) AS weight FROM sums, alpha),
due AS (SELECT *, floor(weight * (SELECT total FROM list)::DOUBLE)::BIGINT AS due, greatest(1, ceil(tokens / {BLOCK_TOKENS}))::BIGINT AS blocks FROM weighted),
placed AS (SELECT doc_id, c.source, c.tokens, weight, due // d.tokens AS passes, due % d.tokens AS rest,
  floor(('0x' || substr(ord, 1, 8))::BIGINT * blocks / 4294967296.0)::BIGINT AS block,
  (sum(c.tokens) OVER (PARTITION BY c.source ORDER BY ord) - c.tokens)::BIGINT AS place FROM counted c JOIN due d ON c.source = d.source)
SELECT doc_id, source, tokens, weight, block, place, (passes + (place < rest)::INT)::BIGINT AS copies FROM placed
"""
