"""Document fingerprints: a homomorphic multiset hash over paragraph pieces, in DataFrame functions alone.

A text's pieces are its paragraphs (lines), cut after sentence ends and, as long paragraphs would be one piece each, before
words that begin with certain letters (cuts that depend on the content alone, so an edit moves none elsewhere). Each piece is hashed to a wide vector; a
fingerprint is the sum of its pieces' vectors modulo powers of two. So the order of pieces does not matter,
equal texts have equal fingerprints, and a piece is inserted or deleted by adding or subtracting its vector
(`combined`). The vector has two parts:

* exact lanes: 32 random bits each, summed modulo 2^32; equal sums mean equal multisets;
* sign lanes: the bits of 64-bit hashes, counted in two fields of 32 bits to a long. With the number of pieces
  these are random projections of the multiset, and their cosine estimates how much two texts share.

A fingerprint is an array of longs: number of pieces, exact lanes, packed sign lanes. Pieces are exploded and
summed per document in generated code. All of a comparison lies in one layout, by hash of `doc_id`: whole texts cross the
network once; the previous document gets a text's front, as long as it needs, and its fingerprint, and nothing else moves.

Defined cases: a null text is empty and has no pieces (all lanes 0; two texts without pieces are alike 1, one
without and one with pieces 0); repeated rows have equal fingerprints; an empty table gives an empty table.
Rows that share a `doc_id` (null counts as an id, first in order) share their next document: the one of the
next id, of several rows there the one whose text hash is smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.shared import ready, text_key, whole, written
from flowspark.plans.scale import lags, ordered

EXACT_SEEDS = (11, 12)
SIGN_SEEDS = (101, 102)
LOW = 0xFFFFFFFF
FIELDS = 0x0000000100000001  # the lowest bit of each field of a long
SHIFTS = 32
PIECES = r"\n+|(?<=[.!?])[ \t]+|[ \t]+(?=[a-dA-D0-2а-в])|(?<=[。！？；，、،؟।…])|(?<=[a-z])(?=[A-Z])"
KEY, NO_KEY = "_key", "_no_key"  # the id that the layout hashes; plain equality of both is null-safe equality of ids


def pieces(text: Column) -> Column:
    """Paragraphs, cut after sentence ends and before some words; empty ends don't count."""
    return F.filter(F.split(text, PIECES), lambda p: p != "")


N_EXACT = 2 * len(EXACT_SEEDS)
N_SIGNS = SHIFTS * len(SIGN_SEEDS)


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str] | None = None) -> DataFrame:
    """One row per distinct `keys` with the number of rows, `n_rows`, and a fingerprint for each of `texts` (name of the
    result: column; by default `fingerprint`: `text`), all from one pass; rows with equal keys must have equal texts."""
    texts = texts or {"fingerprint": "text"}
    sides = F.array(*[F.struct(F.lit(i).alias("side"), pieces(whole(c)).alias("parts")) for i, c in enumerate(texts.values())])
    by_side = df.select(*keys, F.explode(sides).alias("_s"))
    exploded = by_side.select(*keys, F.col("_s.side").alias("_side"), F.posexplode_outer("_s.parts").alias("_at", "_piece"))
    # the hashes are columns of their own below the sums, so that each is computed once a piece
    hashed = exploded.select(
        *keys, "_side", ((F.coalesce("_at", F.lit(0)) == 0) & (F.col("_side") == 0)).cast("long").alias("_copies"),
        F.col("_piece").isNotNull().alias("_is"), *[F.xxhash64("_piece", F.lit(s)).alias(f"_h{s}") for s in (*EXACT_SEEDS, *SIGN_SEEDS)])
    values = [F.lit(1).cast("long")]
    for s in EXACT_SEEDS:
        values += [F.col(f"_h{s}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(f"_h{s}", 32)]
    for s in SIGN_SEEDS:
        values += [F.shiftrightunsigned(f"_h{s}", k).bitwiseAND(F.lit(FIELDS)) for k in range(SHIFTS)]
    # sums of each side first: a piece then adds to one vector only, however many sides there are
    named = {f"_l{i}": v for i, v in enumerate(values)}
    one_side = hashed.groupBy(*keys, "_side").agg(F.sum("_copies").alias("_copies"), *[
        F.sum(F.when(F.col("_is"), v).otherwise(F.lit(0).cast("long"))).alias(name) for name, v in named.items()])
    summed = one_side.groupBy(*keys).agg(F.sum("_copies").alias("_copies"), *[
        F.sum(F.when(F.col("_side") == side, F.col(name)).otherwise(F.lit(0).cast("long"))).alias(f"_l{side}_{i}")
        for side in range(len(texts)) for i, name in enumerate(named)]) if len(texts) > 1 else one_side.withColumnsRenamed(
            {name: f"_l0_{i}" for i, name in enumerate(named)})

    def packed(side: int) -> Column:
        # repeated rows add up to a multiple of one row's vector
        lanes = [F.expr(f"_l{side}_{i} div _copies") for i in range(len(values))]
        lanes[1:1 + N_EXACT] = [x.bitwiseAND(F.lit(LOW)) for x in lanes[1:1 + N_EXACT]]
        return F.array(*lanes)

    return summed.select(*keys, *[packed(i).alias(name) for i, name in enumerate(texts)], F.col("_copies").alias("n_rows"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the pieces of both (`sign` 1) or of `a` without those of `b` (-1)."""
    return F.zip_with(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), b, lambda s, y: F.when(
        (s["i"] >= 1) & (s["i"] <= N_EXACT), (s["x"] + sign * y).bitwiseAND(F.lit(LOW))).otherwise(s["x"] + sign * y))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the signed lanes, 1 for equal fingerprints, 0 where one text has no pieces."""

    def signed(f: Column) -> Column:
        packed = F.slice(f, N_EXACT + 2, N_SIGNS)
        low = F.transform(packed, lambda x: 2 * x.bitwiseAND(F.lit(LOW)) - f[0])
        high = F.transform(packed, lambda x: 2 * F.shiftrightunsigned(x, 32) - f[0])
        return F.concat(low, high).cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)

    def cosine(s):
        scale = F.sqrt(dot(s["x"], s["x"]) * dot(s["y"], s["y"]))
        return F.when(scale > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(s["x"], s["y"]) / scale))).otherwise(0.0)

    near = F.transform(F.array(F.struct(signed(a).alias("x"), signed(b).alias("y"))), cosine)[0]
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def neighbours(documents: DataFrame) -> DataFrame:
    """One row per `doc_id`: the previous id in ascending order (round the end), that id's longest text and the hash of
    the row that stands for the id. Ids are laid out by range; no task sees them all."""
    ids = written(documents.groupBy("doc_id").agg(F.max("n_chars").alias("most"), F.min("text_hash").alias("head")), "ids")
    laid = lags(ordered(ids, [], ["doc_id"]), [], {"prev_id": ("doc_id", 1), "prev_most": ("most", 1)})
    laid = written(laid.select("doc_id", "most", "head", "prev_id", "prev_most", "_pos", "_n"), "neighbours")
    ends = {r["_pos"]: r for r in laid.where("_pos = 1 or _pos = _n").collect()}
    if not ends:
        return laid.drop("_pos", "_n", "most")
    last = ends[max(ends)]

    def value(v, kind="long"):
        return F.lit(v).cast(kind)

    at_start = F.col("_pos") == 1
    return laid.select(
        "doc_id", "head", F.when(at_start, value(last["doc_id"])).otherwise(F.col("prev_id")).alias("prev_id"),
        F.when(at_start, value(last["most"], "int")).otherwise(F.col("prev_most")).alias("prev_most"))


def identity(column: str) -> list[Column]:
    """A nullable numeric id as two columns without nulls."""
    return [F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")).alias(KEY), F.isnull(column).alias(NO_KEY)]


def placed(documents: DataFrame, text: str = "text") -> DataFrame:
    """Texts laid out by hash of their id, each beside what `neighbours` says of it."""
    docs = documents.select("doc_id", whole(text).alias("text"))
    near = neighbours(docs.select("doc_id", F.length("text").alias("n_chars"), text_key("text").alias("text_hash")))
    near = near.select(*identity("doc_id"), "head", "prev_id", "prev_most")
    # measures are taken behind the exchange, so that nothing but id and text goes through it and all uses share it
    laid = docs.select(*identity("doc_id"), "text").join(near, [KEY, NO_KEY])
    return laid.withColumns({"n_chars": F.length("text"), "text_hash": text_key("text")})


def heads(laid: DataFrame) -> DataFrame:
    """The rows of `placed` that stand for their id. As a plain equality this would become a key of the join below it, and
    texts would be laid out anew."""
    return laid.where(F.col("text_hash").bitwiseXOR(F.col("head")) == 0)


def edited(laid: DataFrame) -> DataFrame:
    """Rows of `placed` with the edited text: the last quarter replaced by as much from the front of the next document.

    A document sends the previous one only the front it needs.
    """
    sent = heads(laid).select(KEY, NO_KEY, "prev_id", F.expr("substring(text, 1, prev_most div 4)").alias("_front"))
    fronts = sent.groupBy(KEY, NO_KEY).agg(F.first("prev_id").alias("prev_id"), F.first("_front").alias("_front"))
    return laid.join(fronts.select(*identity("prev_id"), "_front"), [KEY, NO_KEY]).withColumn(
        "edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 4), substring(_front, 1, n_chars div 4))"))


def compared(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and the edited text, and how alike the text is to that and to the next document."""
    ready(documents.sparkSession)
    laid = placed(documents, text)
    keys = [KEY, NO_KEY, "text_hash", "n_chars", "edited_sha256"]
    changed = edited(laid).withColumn("edited_sha256", F.sha2("edited", 256))
    prints = fingerprints(changed, keys, {"own": "text", "edited_print": "edited"})
    # a fingerprint is computed anew for the previous document: cheaper than a table of all of them and two exchanges
    following = fingerprints(heads(laid), [KEY, NO_KEY, "prev_id"], {"_next": "text"})
    joined = prints.join(following.select(*identity("prev_id"), "_next"), [KEY, NO_KEY])

    def digest(name: str) -> Column:
        return F.sha2(F.array_join(F.col(name).cast("array<string>"), " "), 256)

    rows = joined.select(
        F.when(~F.col(NO_KEY), F.col(KEY)).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        digest("own").alias("fingerprint"), digest("edited_print").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_print")).alias("near_edited"), likeness(F.col("own"), F.col("_next")).alias("near_next"), "n_rows")
    return rows.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))).drop("_row", "n_rows")
