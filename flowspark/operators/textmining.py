"""Text signatures and clusters of similar rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.text import as_col
from flowspark.operators.graph import components
from flowspark.plans.scale import checkpoint

HASHES = 128
RECALL = 0.999      # that a pair at the threshold shares a band
GROWTH = 16


# -- signatures ----------------------------------------------------------------------

_XX = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_AT_ONCE = 1 << 14  # tokens hashed at a time, so that the work stays in a core's cache


def _token_minima(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Smallest of each seeded hash over the bags that begin at `starts`; `tokens` are Spark's `xxhash64` of each token's
    hash, which `xxhash64(hash, seed)` goes on from."""
    out = np.full((HASHES, len(starts)), np.iinfo(np.int64).max)
    for first in range(0, len(tokens), _AT_ONCE):
        part = tokens[first:first + _AT_ONCE].view(np.uint64) + (_XX[4] + np.uint64(4))
        low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, first + len(part), "left")
        cuts = np.maximum(starts[low:high] - first, 0)
        h, other = np.empty_like(part), np.empty_like(part)
        for seed in range(HASHES):
            np.bitwise_xor(part, np.uint64(seed * int(_XX[0]) & (1 << 64) - 1), out=h)
            np.right_shift(h, np.uint64(41), out=other)
            np.left_shift(h, np.uint64(23), out=h)
            np.bitwise_or(h, other, out=h)
            np.multiply(h, _XX[1], out=h)
            np.add(h, _XX[2], out=h)
            for shift, prime in ((33, _XX[1]), (29, _XX[2]), (32, None)):
                np.right_shift(h, np.uint64(shift), out=other)
                np.bitwise_xor(h, other, out=h)
                if prime is not None:
                    np.multiply(h, prime, out=h)
            least = np.minimum.reduceat(h.view(np.int64), cuts)
            np.minimum(out[seed, low:high], least, out=out[seed, low:high])
    return out


def _minima(df: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """`(row_id, h0 ... h127)`: the smallest of each of 128 seeded token hashes, `xxhash64(xxhash64(token), seed)`.

    The 128 minima of a row are taken where it lies, so one short row per document crosses the shuffle, which joins rows of
    one id. Rows without tokens have no minima.
    """
    names = [f"h{i}" for i in range(HASHES)]
    schema = T.StructType([df.schema[row_id], *[T.StructField(n, T.LongType()) for n in names]])
    bags = df.select(row_id, F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(F.xxhash64(t)))).alias("_bag"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bag = batch.column(1)
            ends = bag.offsets.to_numpy().astype(np.int64)
            some = np.diff(ends) > 0  # a condition in the query would make every bag twice
            made = _token_minima(bag.values.to_numpy()[ends[0]:ends[-1]], ends[:-1][some] - ends[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), *map(pa.array, made)], names=[row_id, *names])

    rows = bags.mapInArrow(least, schema)
    return rows.groupBy(row_id).agg(*[F.min(n).alias(n) for n in names])


def _pack(first: int) -> Column:
    word = F.lit(0).cast("long")
    for i in range(64):
        bit = F.col(f"h{first + i}").bitwiseAND(F.lit(1).cast("long"))
        word = word.bitwiseOR(F.shiftleft(bit, i))
    return word


def minhash_signature(df: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """`(row_id, sig_hi, sig_lo)`: low bit of the smallest of each of 128 seeded token hashes.

    Rows without tokens get no signature.
    """
    return _minima(df, row_id, tokens).select(row_id, _pack(0).alias("sig_hi"), _pack(64).alias("sig_lo"))


def signature_distance(a_hi, a_lo, b_hi, b_lo) -> Column:
    """Differing bits of two 128-bit signatures."""
    return F.bit_count(as_col(a_hi).bitwiseXOR(as_col(b_hi))) + F.bit_count(as_col(a_lo).bitwiseXOR(as_col(b_lo)))


def within(distance: Column, similarity: float) -> Column:
    return distance <= (1 - similarity + 0.05) * HASHES


def bands_for(similarity: float) -> int:
    """As few bands as still let a pair of this Jaccard similarity share one with `RECALL`."""
    for bands in (16, 32, 64):
        if 1 - (1 - similarity ** (HASHES // bands)) ** bands >= RECALL:
            return bands
    return HASHES


def banded_signatures(df: DataFrame, row_id: str, tokens: str, bands: int) -> DataFrame:
    """`(row_id, sig_hi, sig_lo, buckets)`: a bucket is a hash of a band's whole minima, not of their low bits, so unlike
    rows meet as rarely in a large table as in a small one."""
    rows = HASHES // bands
    buckets = F.array(*[F.xxhash64(F.lit(b), *[f"h{b * rows + i}" for i in range(rows)]) for b in range(bands)])
    return _minima(df, row_id, tokens).select(row_id, _pack(0).alias("sig_hi"), _pack(64).alias("sig_lo"), buckets.alias("buckets"))


def similar_clusters(df: DataFrame, row_id: str, tokens: str, similarity: float = 0.7, bands: int | None = None,
                     crowd: int = 64) -> DataFrame:
    """`(row_id, cluster)`: rows joined through shared bands of their minima.

    Two rows are linked when they share a band and their signatures are `within` the similarity. There are
    as many bands as `bands_for` says: at a Jaccard similarity of 0.7 a pair shares none of 32 bands of 4
    with a probability below 2e-4, whatever the size of the table.

    Equal signatures collapse first. In each bucket all members are compared with one centre. Members outside the
    component of their bucket's centre become centres in turn, `crowd` a bucket in the first round and `GROWTH` times as
    many in each further one, and are compared with the bucket's members of other components, until none is left: every
    pair that shares a bucket is settled, no bucket is cut or split.
    """
    signed = checkpoint(banded_signatures(df, row_id, tokens, bands or bands_for(similarity)))
    # equal bits can stand for different minima: a node has the buckets of all its rows
    one = checkpoint(signed.groupBy("sig_hi", "sig_lo").agg(
        F.min(row_id).alias("rep"), F.array_distinct(F.flatten(F.collect_set("buckets"))).alias("buckets")))
    entries = one.select("rep", "sig_hi", "sig_lo", F.explode("buckets").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    entries = checkpoint(entries.join(sizes, "bucket"))
    # the centre is the member that meets most others over all buckets
    met = entries.groupBy("rep").agg(F.sum("_size").alias("_met"))
    first = entries.join(met, "rep").groupBy("bucket").agg(
        F.min_by(F.struct(F.col("rep").alias("c_rep"), F.col("sig_hi").alias("c_hi"), F.col("sig_lo").alias("c_lo")),
                 F.struct(-F.col("_met"), F.col("rep"))).alias("_c")).select("bucket", "_c.*")
    members = checkpoint(entries.drop("_size").join(first, "bucket"))
    near = within(signature_distance("sig_hi", "sig_lo", "c_hi", "c_lo"), similarity)
    edges = checkpoint(members.where((F.col("rep") != F.col("c_rep")) & near).select(F.col("c_rep").alias("a"), F.col("rep").alias("b")).distinct())
    found = checkpoint(components(edges))
    left = _stragglers(members, found)
    members = members.select("bucket", "rep", "sig_hi", "sig_lo")
    most = crowd
    while not left.isEmpty():
        # an even share of each bucket's stragglers, by a hash that every round draws anew
        counts = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("_many"))
        share = F.pmod(F.xxhash64("rep", F.lit(most)), F.col("_many")) < most
        chosen = checkpoint(left.join(counts, "bucket").where(share).select("bucket", "rep", "sig_hi", "sig_lo"))
        centres = _placed(chosen, found, "rep", "_of").select(
            F.col("bucket").alias("_bucket"), F.col("rep").alias("c_rep"), F.col("sig_hi").alias("c_hi"), F.col("sig_lo").alias("c_lo"), "_of")
        placed = _placed(members.join(chosen.select("bucket").distinct(), "bucket", "left_semi"), found, "rep", "_own")
        new = placed.join(centres, (placed["bucket"] == centres["_bucket"]) & (F.col("_own") != F.col("_of")) & near)
        new = checkpoint(new.select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")).distinct())
        if not new.isEmpty():
            edges = edges.union(new)
            found = checkpoint(components(edges))
        left = _stragglers(left.join(chosen.select("bucket", "rep"), ["bucket", "rep"], "left_anti"), found)
        most *= GROWTH
    reps = _placed(one.select("rep", "sig_hi", "sig_lo"), found, "rep", "cluster").select("sig_hi", "sig_lo", "cluster")
    return signed.join(reps, ["sig_hi", "sig_lo"]).select(row_id, "cluster")


def _placed(df: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    """`df` with the component of `node`, itself where it has no edge."""
    side = found.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(side, node, "left").withColumn(name, F.coalesce(name, node))


def _stragglers(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members outside the component of their bucket's centre."""
    both = _placed(_placed(members, found, "rep", "_own"), found, "c_rep", "_of_centre")
    return checkpoint(both.where("_own <> _of_centre").select(*members.columns))


def string_hash(token: Column, bits: int) -> Column:
    """Multiply-and-xor hash by 1000003 over the characters, cut to `bits` (at most 64) bits."""
    if not 1 <= bits <= 64:
        raise ValueError("1 to 64 bits")
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    half = F.lit((1 << 32) - 1)
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long"))
    start = F.shiftleft(F.get(codes, F.lit(0)), 7)

    def times(x: Column) -> Column:
        """Product modulo 2^64, by halves of 32 bits so that nothing overflows."""
        low = x.bitwiseAND(half) * 1000003
        high = (F.shiftrightunsigned(x, 32) * 1000003 + F.shiftrightunsigned(low, 32)).bitwiseAND(half)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))

    mixed = F.aggregate(codes, start.bitwiseAND(mask), lambda x, c: times(x).bitwiseXOR(c).bitwiseAND(mask))
    return F.when(F.length(token) == 0, F.lit(0).cast("long")).otherwise(mixed.bitwiseXOR(F.length(token).cast("long")))


def simhash(df: DataFrame, row_id: str, tokens: str, bits: int = 32, weight: str | None = None) -> DataFrame:
    """`(row_id, simhash)`: per bit the weighted vote of all tokens, 1 when it is not negative.

    The vector's first entry is the highest bit. Without `weight` every token counts once per
    occurrence; else `weight` names an array parallel to `tokens`, and 1 needs a positive vote.
    `tokens` may also name plain tokens, one per row, with the `weight` of each: votes are then
    added up where the rows lie before they are shuffled.
    """
    if weight and not isinstance(df.schema[tokens].dataType, T.ArrayType):
        rows = df.select(row_id, F.col(tokens).alias("t"), F.col(weight).alias("w"))
    elif weight:
        rows = df.select(row_id, F.explode(F.arrays_zip(F.col(tokens).alias("t"), F.col(weight).alias("w"))).alias("e")) \
            .select(row_id, F.col("e.t").alias("t"), F.col("e.w").alias("w"))
    else:
        rows = df.select(row_id, F.explode(tokens).alias("t")).groupBy(row_id, "t").agg(F.count(F.lit(1)).alias("w"))
    hashed = rows.withColumn("h", string_hash(F.col("t"), bits))
    votes = []
    for i in range(bits):
        on = F.shiftright("h", i).bitwiseAND(F.lit(1).cast("long")) == 1
        votes.append(F.sum(F.when(on, F.col("w")).otherwise(-F.col("w"))).alias(f"v{i}"))
    summed = hashed.groupBy(row_id).agg(*votes)
    bit = (lambda c: c > 0) if weight else (lambda c: c >= 0)
    vector = F.array(*[F.when(bit(F.col(f"v{i}")), 1.0).otherwise(0.0) for i in reversed(range(bits))])
    return summed.select(row_id, vector.alias("simhash"))
