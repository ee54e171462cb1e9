"""Substring dedup by seed and extend: every passage of `WINDOW` words that occurs twice or more, anywhere, goes.

1. Seeds: word 15-grams are hashed and winnowed, the smallest of each 21 consecutive ones (the last of equals) is an
   anchor. 15 + 21 - 1 = 35, so every window of 35 words selects one anchor inside it, and equal windows select the
   same one: no repeat is missed. An anchor carries one hash of its reach, the words of all windows that select it.
2. Join: anchors meet on their hash, by partial sums, never pairwise. Anchors whose hash occurs once go. Two
   occurrences with equal reach extend all the way both ways; a hash with one reach only is settled by that.
3. Extend: of a hash with several reaches, one occurrence of each reach is extended to the left by each length that
   its windows allow, and to the right by as much as makes up 35: the keys of these extensions meet on their hash. A
   key of two reaches, or of a reach that occurs twice, is a repeated window for all occurrences of the reach.
4. The union of a document's repeated windows are its maximal repeats of 35 words or more; their words go.

A window is judged on the input, all its occurrences count, those in its own document too. Work per group is one row
for each distinct reach, so a passage in a third of all documents costs one row each and is combined before any
shuffle; the joins on an anchor's hash are split at run time.

Defined cases: a null text has no words; repeated rows repeat each other's windows and lose them; rows are told apart
by id and text, so rows that share a `doc_id` (or have none) keep their own results; an empty table gives an empty
table. Hashes have 64 bits, and an anchor's and an extension's must both agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.minhash import mix, word_hashes
from flowspark.llm.shared import free_name, ready, text_key, whole, written
from flowspark.plans.scale import broadcast_if_small

WINDOW, GRAM = 35, 15
SPAN = WINDOW - GRAM + 1  # 15-grams an anchor is the smallest of

_BASE = np.uint64(0x9E3779B97F4A7C15)
# an occurrence's windows are bits: bit j is the window that starts j words before the anchor


def _prefix(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash and the powers of its base, modulo 2^64."""
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(hashes), _BASE, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(mix(hashes) * powers[:-1])])
    return sums, powers


# the inverse of the base modulo 2^64 brings a slice's hash to its start
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Slices:
    """Hashes of word slices of one text in constant time each."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.sums, _ = _prefix(hashes)
        self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(hashes), _INVERSE, np.uint64)]))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def selected(grams: np.ndarray) -> np.ndarray:
    """For each run of `SPAN` consecutive hashes, that is each window of words, the position of the last smallest one."""
    if len(grams) < SPAN:
        return np.zeros(0, np.int64)  # shorter than a window of words
    windows = np.lib.stride_tricks.sliding_window_view(grams, SPAN)
    return SPAN - 1 - windows[:, ::-1].argmin(axis=1) + np.arange(len(windows))


def text_anchors(part: Slices) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, first and last window of each anchor of a text."""
    grams = part.of(np.arange(part.n - GRAM + 1), np.arange(GRAM, part.n + 1))
    at = selected(grams)  # grows with the window, so an anchor's windows are consecutive
    pos, first, count = np.unique(at, return_index=True, return_counts=True)
    return pos, grams[pos], first, first + count - 1


def anchors(docs: DataFrame) -> DataFrame:
    """`(doc_id, text_hash, pos, seed, reach, own)` of every anchor of `docs (doc_id, text_hash, text binary)`; `own` are
    the windows that select it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ints, longs = [], [], []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                hashes = word_hashes(raw)
                if len(hashes) < WINDOW:
                    continue
                part = Slices(hashes)
                pos, seed, first, last = text_anchors(part)
                own = (1 << (pos - first + 1)) - (1 << (pos - last))
                reach = mix(part.of(first, last + WINDOW) + own.astype(np.uint64))
                ids.append(np.full(len(pos), i))
                ints.append(np.stack([pos, own]).astype(np.int32))
                longs.append(np.stack([seed, reach]).view(np.int64))
            rows = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))
            two = np.concatenate(ints, axis=1) if ints else np.zeros((2, 0), np.int32)
            pair = np.concatenate(longs, axis=1) if longs else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(1).take(rows), pa.array(two[0]), pa.array(pair[0]), pa.array(pair[1]), pa.array(two[1]),
            ], names=["doc_id", "text_hash", "pos", "seed", "reach", "own"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, pos int, seed long, reach long, own int")


def extensions(docs: DataFrame) -> DataFrame:
    """`(seed, reach, shift, key)`: the own windows of the occurrences listed in `at (pos, seed, reach, own)` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for raw, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = Slices(word_hashes(raw))
                pos, own = (np.array([a[c] for a in listed], np.int64) for c in ("pos", "own"))
                marks = np.array([(a["seed"], a["reach"]) for a in listed], np.int64).reshape(-1, 2)
                for shift in range(SPAN):
                    has = (own >> shift) & 1 == 1
                    starts = pos[has] - shift
                    out[0].append(marks[has, 0])
                    out[1].append(marks[has, 1])
                    out[2].append(np.full(len(starts), shift, np.int64))
                    out[3].append(part.of(starts, starts + WINDOW).view(np.int64))
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            order = np.lexsort((columns[2], columns[1], columns[0]))  # neighbours share seed and reach: they compress
            seed, reach, shift, key = (c[order] for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(reach), pa.array(shift.astype(np.int32)), pa.array(key)],
                                             names=["seed", "reach", "shift", "key"])

    return docs.mapInArrow(run, "seed long, reach long, shift int, key long")


def _of_rows(docs: DataFrame, rows: DataFrame, hash_: str) -> tuple[DataFrame, DataFrame]:
    """`docs` with and without a row of the same id and text hash in `rows`, a table of distinct `(doc_id, text_hash)`.

    Where the list is measured small, only the texts that are listed go on to a shuffle."""
    i, h = free_name(docs, "_i"), free_name(docs, "_h")
    side, _ = broadcast_if_small(rows.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (docs[hash_] == F.col(h))
    return docs.join(side, same, "left_semi"), docs.join(side, same, "left_anti")


def _beside(docs: DataFrame, listed: DataFrame, hash_: str, name: str) -> DataFrame:
    """`docs` with the column `at` of their row in `listed`, as `name`."""
    i, h = free_name(docs, "_i"), free_name(docs, "_h")
    side = listed.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("at").alias(name))
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side[i]) & (docs[hash_] == side[h])).drop(i, h)


def removal(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents keyed by id and text hash, and `(doc_id, text_hash, at)`: anchors with the windows that repeat."""
    ready(documents.sparkSession)
    keyed = documents.withColumn(free_name(documents, "text_hash"), text_key(text))
    key = keyed.columns[-1]
    narrow = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("text_hash"),
                          whole(text).cast("binary").alias("text"))
    seeds = written(anchors(narrow), "anchors")
    common = written(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "common-seeds")
    side, _ = broadcast_if_small(common)
    seeds = written(seeds.join(side, "seed", "left_semi"), "common-anchors")
    # a reach with its occurrences; where several reaches share a seed, one occurrence of each is extended
    reaches = seeds.groupBy("seed", "reach").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "pos", "own")).alias("one"))
    groups = reaches.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"))
    shared = written(reaches.join(groups, "seed"), "reaches")
    listed = written(shared.where("kinds > 1").select("one.*", "seed", "reach").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("pos", "seed", "reach", "own")).alias("at")), "listed")
    texts = _beside(_of_rows(narrow, listed, "text_hash")[0], listed, "text_hash", "at").select("text", "at")
    keys = written(extensions(texts), "extensions")
    # repeated rows list an occurrence twice, but under one reach
    met = keys.groupBy("seed", "key").agg(F.min("reach").alias("_least"), F.max("reach").alias("_most")).where("_least <> _most")
    bits = keys.join(met.select("seed", "key"), ["seed", "key"]).groupBy("seed", "reach").agg(F.expr("bit_or(1 << shift)").alias("bits"))
    marked = shared.where("n > 1 or kinds > 1").join(bits, ["seed", "reach"], "left").select(
        "seed", "reach", F.when(F.col("n") > 1, F.col("one.own")).otherwise(F.coalesce("bits", F.lit(0))).alias("bits")).where("bits > 0")
    # a table of its own, so that the join's large partitions can be split
    marked = written(marked, "marked")
    per_row = seeds.join(marked, ["seed", "reach"]).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "bits")).alias("at"))
    return keyed, written(per_row, "repeats")


def covered(n: int, at: list[dict]) -> np.ndarray:
    """Which of `n` words the windows cover."""
    pos = np.array([a["pos"] for a in at], np.int64)
    bits = np.array([a["bits"] for a in at], np.int64)
    change = np.zeros(n + 1, np.int64)
    for shift in range(SPAN):
        starts = pos[(bits >> shift) & 1 == 1] - shift
        starts = starts[(starts >= 0) & (starts + WINDOW <= n)]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def stripped(raw: bytes, at: list[dict] | None) -> tuple[int, int, bytes]:
    """Number of words, words removed, and the kept ones joined by one blank."""
    words = raw.split()
    if not at:
        return len(words), 0, b" ".join(words)
    gone = covered(len(words), at)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def _with_marks(documents: DataFrame, text: str) -> tuple[DataFrame, str]:
    """`documents` with their repeated windows; texts without any stay where they are."""
    keyed, per_row = removal(documents, text)
    mark = free_name(documents, "_at")
    touched, rest = _of_rows(keyed, per_row, keyed.columns[-1])
    joined = _beside(touched, per_row, keyed.columns[-1], mark).select(*documents.columns, mark)
    none = F.lit(None).cast(joined.schema[mark].dataType)
    return joined.unionByName(rest.select(*documents.columns, none.alias(mark))), mark


def repeats(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: words, removed words, digest of the kept ones."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked, mark = _with_marks(slim, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stripped(raw, at) for raw, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_words": pa.array([f[0] for f in found], pa.int64()),
                "n_removed": pa.array([f[1] for f in found], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())})

    return marked.select("doc_id", whole("text").cast("binary").alias("text"), mark).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(documents: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """`documents` with the repeated words cut out of the text and a changed text's code points in `length`, if there is
    such a column; untouched texts stay as they are, a null stays null."""
    marked, mark = _with_marks(documents, text)
    place = documents.columns.index(text)
    count = documents.columns.index(length) if length in documents.columns else None
    schema = T.StructType(documents.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = [], []
            for value, at in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if value is not None and at:
                    _, n, kept = stripped(value.encode(), at)
                    value = kept.decode() if n else value
                    cut.append(bool(n))
                else:
                    cut.append(False)
                texts.append(value)
            columns = batch.columns[:-1]
            if count is not None:
                sizes = [len(t) if c else n for t, c, n in zip(texts, cut, columns[count].to_pylist())]
                columns[count] = pa.array(sizes, batch.schema.field(count).type)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(run, schema)


ORACLE = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM split WHERE len(w) >= 35)),
repeated AS (SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated),
placed AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM split WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)
"""
