"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

1. `signatures`: a document's words (A-Z lowered) give its set of distinct 5-word shingles as 64-bit hashes. One
   permutation of the hashes is cut into `BINS` bins, each bin's smallest hash is its value. An empty bin takes the
   value of the first occupied bin of its own fixed random order of all bins (optimal densification). Bins form
   bands of `ROWS`; a band's hash is a bucket.
2. Documents with equal sets are one class; only a class's smallest id goes on.
3. In each bucket every member is paired with one centre only: a star, so pairs grow with members, not with their
   square. The centre is the member that meets most others over all buckets (of equals the smallest id), so it stands
   in the middle of its group.
4. Members that didn't come into the component of their bucket's centre are stragglers. They become the centres of
   stars of their own, `CENTRES` a bucket in the first round and `GROWTH` times as many in each further one, to the
   members of other components, until no straggler is left: every pair that shares a bucket has been settled, no
   bucket is cut short.
   A pair is confirmed on full sets when its sizes and its bitmaps allow the similarity (both are exact bounds). Of two
   sets of `LARGE` shingles or more, whose bitmaps fill up, the sketches, 4 bits of each bin, must also agree in `AGREE`
   of 288 bins; at a similarity of 0.75 they agree in fewer with a probability below 2e-6. In smaller sets few shingles
   fill many bins and the sketch is too noisy to decide. All that is compared where the pair arises, so hopeless pairs
   never leave the join.
5. Components by smallest neighbours over the confirmed edges and the class memberships.

At a similarity of 0.75 a pair shares no bucket with a probability of (1 - 0.75^6)^48 < 1e-4, at 0.8 < 1e-6.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; fewer than five words
are one shingle; a row with null `doc_id` is linked with nothing, its component is null and it is kept; rows that
share a `doc_id` are one node with the links of each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.shared import free_name, ready, text_key, written
from flowspark.operators.graph import components
from flowspark.plans.scale import broadcast_if_small

SHINGLE = 5
SIMILARITY = 75  # per cent
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
CENTRES, GROWTH = 64, 16
NIBBLES = 16  # 4-bit values in a long
AGREE = 185  # of BINS
LARGE = 512  # shingles from which sketches count
BITS = 1024  # of a set's bitmap

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_CHUNK = 1 << 20
# odd multipliers for the words of a shingle and the finalizer's multipliers (splitmix64)
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; endless texts are split piece by piece."""
    import xxhash

    digest, parts, at = xxhash.xxh3_64_intdigest, [], 0
    while at < len(text):
        cut = len(text)
        if cut - at > _CHUNK and (blank := _BLANK.search(text, at + _CHUNK)):
            cut = blank.start()
        found = text[at:cut].split()
        parts.append(np.fromiter(map(digest, found), np.uint64, len(found)))
        at = cut + 1 if cut < len(text) else cut
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles; bytes.split() splits at exactly the blanks that part words."""
    w, size = word_hashes(text.translate(_LOWER)), SHINGLE
    if not len(w):
        return w
    if len(w) < size:  # the whole sequence is one shingle
        own = mix(np.full(1, len(w), np.uint64))
        return mix(own + (w * _TIMES[:len(w)]).sum(dtype=np.uint64, keepdims=True))
    total = np.zeros(len(w) - size + 1, np.uint64)
    for j in range(size):
        total += w[j:len(w) - size + 1 + j] * _TIMES[j]
    return np.unique(mix(total))


class Hasher:
    """Bins and bands; the random orders of bins are the same everywhere."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        order = np.random.Generator(np.random.PCG64(20_240_601)).random((self.bins, self.bins)).argsort(axis=1).argsort(axis=1)
        np.fill_diagonal(order, -1)  # an occupied bin comes first in its own order
        self.order = order.astype(np.int16)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """Signature of a non-empty sorted set: the smallest hash of each bin, empty bins densified."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        least = hashes[first]
        if len(first) < self.bins:
            least = least[self.order[:, bins[first].astype(np.int64)].argmin(axis=1)]
        return least

    def bitmap(self, hashes: np.ndarray) -> np.ndarray:
        """Presence of a set's hashes by their upper bits, 64 to a long."""
        bits = np.zeros(BITS, dtype=np.uint8)
        bits[(hashes >> np.uint64(65 - BITS.bit_length())).astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").view("<u8")

    def sketch(self, values: np.ndarray) -> np.ndarray:
        """Four bits of each bin, 16 to a long."""
        nibbles = (values & np.uint64(15)).reshape(-1, NIBBLES) << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4))
        return np.bitwise_or.reduce(nibbles, axis=1)

    def buckets(self, values: np.ndarray) -> np.ndarray:
        rows = values.reshape(self.bands, self.rows)
        total = self.salt.copy()
        for j in range(self.rows):
            total = mix(total + rows[:, j] * _TIMES[j % 5] + np.uint64(j))
        return total


def _binary(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def signatures(df: DataFrame, text: str = "text") -> DataFrame:
    """Per row: `doc_id`, `n_shingles`, two 64-bit sums that tell sets apart, the buckets, the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            n, one, two, buckets, sketches = [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                hashes = shingle_set(raw)
                n.append(len(hashes))
                one.append(int(hashes.sum(dtype=np.uint64)))
                two.append(int(mix(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)))
                values = hasher.values(hashes) if len(hashes) else hashes
                buckets.append(hasher.buckets(values) if len(hashes) else hashes)
                sketches.append(np.concatenate([hasher.sketch(values), hasher.bitmap(hashes)]) if len(hashes) else hashes)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()),
                "set_a": pa.array(np.array(one, np.uint64).view(np.int64)), "set_b": pa.array(np.array(two, np.uint64).view(np.int64)),
                "buckets": _longs(buckets), "sketch": _longs(sketches)})

    return _binary(df, text).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, buckets array<long>, sketch array<long>")


def shingle_sets(df: DataFrame, text: str = "text") -> DataFrame:
    """Per row: `doc_id` and its set as an array of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "shingles": _longs([shingle_set(raw) for raw in batch.column(1).to_pylist()])})

    return _binary(df, text).mapInArrow(run, "doc_id long, shingles array<long>")


def agreeing(a: Column, b: Column) -> Column:
    """How many bins of two sketches agree: 4-bit fields of the exclusive or that are zero."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for k in range(BINS // NIBBLES):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.lit(NIBBLES) - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones))
    return total


def _shared_at_most(n: Column, own: Column, other: Column) -> Column:
    """Bound on the common shingles: each bit of one bitmap that the other lacks stands for a shingle that it lacks."""
    lacking = F.lit(0)
    for k in range(BINS // NIBBLES, BINS // NIBBLES + BITS // 64):
        lacking = lacking + F.bit_count(F.get(own, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(k)))))
    return n - lacking


def _likely(a: str, b: str) -> Column:
    """Whether two members, by their columns `n` and `sketch` behind a prefix, may be linked."""
    n_a, n_b, s_a, s_b = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}sketch"), F.col(f"{b}sketch")
    shared = F.least(_shared_at_most(n_a, s_a, s_b), _shared_at_most(n_b, s_b, s_a))
    return ((100 * F.least(n_a, n_b) >= SIMILARITY * F.greatest(n_a, n_b))
            & (100 * shared >= SIMILARITY * (n_a + n_b - shared))
            & ((F.least(n_a, n_b) < LARGE) | (agreeing(s_a, s_b) >= AGREE)))


def _starred(classes: DataFrame) -> DataFrame:
    """`(bucket, node, centre)`: members of the buckets that hold two classes or more."""
    entries = classes.select("node", F.explode("buckets").alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(entries.join(crowded, "bucket"), "members")
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    centres = members.join(met, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("centre"))
    return written(members.join(centres, "bucket").select("bucket", "node", "centre"), "stars")


def _confirmed(pairs: DataFrame, classes: DataFrame, documents: DataFrame, text: str) -> DataFrame:
    """The distinct pairs `(a, b)` whose full sets are similar enough; only the documents of a pair are read into sets.
    Joins on a hot centre are split at run time."""
    pairs = written(pairs.distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sized = written(classes.join(nodes, "node").select(F.col("node").alias("doc_id"), "n"), "nodes")
    near, _ = broadcast_if_small(sized)
    # an id with several texts stands for the class it names; repeated rows have one set and give one pair
    own = shingle_sets(documents.join(near.select("doc_id"), "doc_id", "left_semi"), text)
    sets = written(own.withColumn("n", F.size("shingles").cast("long")).join(near, ["doc_id", "n"]).select("doc_id", "shingles"), "sets")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", shared.alias("_both"), (F.size("_a") + F.size("_b")).alias("_sum"))
    return both.where(100 * F.col("_both") >= SIMILARITY * (F.col("_sum") - F.col("_both"))).select("a", "b").distinct()


def linked(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """`(signatures, components)`: the written signature table, and `(node, component)` of all ids with a link."""
    ready(documents.sparkSession)
    signed = written(signatures(documents, text), "signatures")
    classes = written(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b")
        .agg(F.min("doc_id").alias("node"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch"))
        .withColumnRenamed("n_shingles", "n"), "classes")
    named = classes.select(F.col("n").alias("n_shingles"), "set_a", "set_b", "node")
    copies = signed.where("doc_id is not null").join(named, ["n_shingles", "set_a", "set_b"])
    copies = copies.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()

    members = _starred(classes)
    # an id whose texts differ names several classes: each is a member under the id
    marks = classes.select("node", "n", "sketch")
    spokes = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    ends = spokes.join(marks.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch")), "b").join(
        marks.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch")), "a")
    likely = ends.where(_likely("a_", "b_")).select("a", "b")
    edges = written(_confirmed(likely, classes, documents, text).unionByName(copies), "edges")
    found = written(components(edges), "components")
    left = _stragglers(members, found)
    if left.isEmpty():
        return signed, found
    near = members.join(left.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "node")
    open_members = written(near.join(marks, "node"), "open")
    most = CENTRES
    while not left.isEmpty():
        # an even share of each bucket's stragglers, by a hash that every round draws anew
        counts = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("_many"))
        share = F.pmod(F.xxhash64("node", F.lit(most)), F.col("_many")) < most
        chosen = written(left.join(counts, "bucket").where(share).select("bucket", "node"), "chosen")
        pairs = written(_met(open_members, chosen, found), "met")
        if not pairs.isEmpty():
            new = written(_confirmed(pairs, classes, documents, text), "edges")
            if not new.isEmpty():
                edges = edges.unionByName(new)
                found = written(components(edges), "components")
        left, most = _stragglers(left.join(chosen, ["bucket", "node"], "left_anti"), found), most * GROWTH
    return signed, found


def _component(df: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    side = found.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(side, node, "left").withColumn(name, F.coalesce(name, node))


def _stragglers(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members outside the component of their bucket's centre."""
    both = _component(_component(members, found, "node", "_own"), found, "centre", "_of_centre")
    return written(both.where("_own <> _of_centre").select(*members.columns), "stragglers")


def _met(members: DataFrame, chosen: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct pairs of a chosen straggler and a member of its bucket that may be linked and aren't connected yet."""
    placed = _component(members, found, "node", "component")
    centres = placed.join(chosen, ["bucket", "node"]).select(
        "bucket", *[F.col(c).alias(f"c_{c}") for c in ("node", "n", "sketch", "component")])
    likely = (F.col("component") != F.col("c_component")) & (F.col("node") != F.col("c_node")) & _likely("", "c_")
    met = placed.join(centres, (placed["bucket"] == centres["bucket"]) & likely)
    return met.select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b")).distinct()


def near_duplicates(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: set size, smallest reachable id, and whether the document is the one of its group that stays."""
    signed, found = linked(documents, text)
    rows = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _nodes(documents: DataFrame, text: str, node: str) -> DataFrame:
    """`documents` with a number for each id and text: the id where it has one text, else a hash of both. Null where a row
    without id has no words, as nothing is linked with it."""
    digest = free_name(documents, "text_key")
    keyed = documents.withColumn(digest, text_key(text))
    several = keyed.groupBy(F.col("doc_id").cast("long").alias("_id_of")).agg(F.min(digest).alias("_least"), F.max(digest).alias("_most"))
    several, _ = broadcast_if_small(written(several.where("_id_of is not null and _least <> _most").select("_id_of"), "ids-of-several"))
    shared = free_name(documents, "shared_id")
    marked = keyed.join(several.select(F.col("_id_of").alias(shared)), keyed["doc_id"].cast("long") == F.col(shared), "left")
    # from 2^62 on, so that in a group a plain id comes first
    own = F.shiftrightunsigned(F.xxhash64(F.lit("node"), F.col("doc_id").cast("long"), digest), 2).bitwiseOR(F.lit(1 << 62))
    wordless = ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    value = F.when(F.col("doc_id").isNull(), F.when(~wordless, own)).when(F.col(shared).isNotNull(), own).otherwise(F.col("doc_id").cast("long"))
    return marked.withColumn(node, value).select(*documents.columns, node)


def deduplicated(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with one document of each group.

    A document is what shares id and text: rows that share an id but not the text are judged each by its own text, rows
    without an id by their text alone. Of rows equal in both, one stays; rows without words and without id all stay.
    """
    node = free_name(documents, "node_key")
    numbered = _nodes(documents, text, node)
    signed, found = linked(numbered.select(F.col(node).alias("doc_id"), F.col(text).alias("text")), "text")
    gone, _ = broadcast_if_small(found.where("node <> component").select(F.col("node").alias(node)))
    kept = numbered.join(gone, node, "left_anti")
    repeated = written(signed.where("doc_id is not null").groupBy(F.col("doc_id").alias(node)).count().where("count > 1").select(node), "repeated")
    if repeated.isEmpty():
        return kept.select(*documents.columns)
    return kept.join(repeated, node, "left_anti").select(*documents.columns).unionByName(
        kept.join(repeated, node, "left_semi").dropDuplicates([node]).select(*documents.columns))


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reached AS (SELECT x AS node, x AS seen FROM links UNION SELECT r.node, l.y FROM reached r JOIN links l ON l.x = r.seen),
lowest AS (SELECT node, min(seen) AS low FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.node = d.doc_id
"""
