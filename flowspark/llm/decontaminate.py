"""Benchmark decontamination by Wu-Manber multi-pattern search.

1. Windows: `WORDS` consecutive words of a benchmark item, or all words of a shorter one, become patterns ` w1 ... wk `
   with a blank on either side, so that a pattern only meets whole words. Documents are brought into the same form.
2. Block shift tables: patterns of like length form a class; of its shortest length m the table tells, for the block
   of bytes that ends m bytes behind a place, how far the search may move on. A block that ends no pattern's first m
   bytes rules out all places up to it.
3. Where the shift is 0, the block's suffix-hash bucket and a hash of the first bytes select the patterns that can
   begin here; the text is compared with them byte by byte (a lookup by the whole string, for each length in the
   bucket, so patterns that share a beginning don't make a chain).
4. A batch of texts is one buffer cut into lanes; numpy moves all lanes at once, each by its own shift.

Benchmark windows are dealt by a hash into blocks of about `BLOCK_BYTES`, so neither the driver nor a worker ever holds
more than one block of a benchmark of any size, and a window that many items share is dealt over the blocks by item. With
one block the documents are scanned once and nothing is shuffled; with more, each block's findings (only of documents
that have any) are written and put together by id and text hash.

Defined cases: a null text or item has no words; a row without `item_id` marks words but has no name, so it isn't counted;
items that share an id are one; rows that repeat, or share a `doc_id`, each get the result of their own text; an empty
table of documents gives an empty table, an empty benchmark leaves all documents clean; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.shared import LOWER, UPPER, ready, text_key, whole, written

GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = 10
BLOCK_BYTES = 16 * 1024 * 1024
SPANS = "array<struct<start:int,end:int>>"

LANE = 1024           # bytes of a text that one lane searches
MOST_BLOCK = 8        # bytes a block has at most
MOST_LENGTH = 200     # bytes of a pattern that the shift table looks at
_TIMES = np.uint64(0x9E3779B97F4A7C15)
# A-Z to a-z; what is no part of a word to a blank
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: bytes) -> tuple[bytes, int]:
    """The text as ` w1 w2 ... wn ` (empty without words), and n."""
    words = text.translate(_WORD_BYTES).split()
    return (b" %b " % b" ".join(words), len(words)) if words else (b"", 0)


class Patterns:
    """Shift table, suffix-hash buckets and prefix hashes of patterns of like length."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(MOST_LENGTH, min(map(len, patterns)))
        heads = np.frombuffer(b"".join(p[:self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        # blocks long enough that a chance text rarely holds one: log of 2 m r, at about 12 likely bytes
        wanted = math.ceil(math.log(2 * self.m * len(patterns)) / math.log(12)) + 1
        self.block = max(1, min(MOST_BLOCK, wanted, (self.m + 1) // 2))
        places = self.m - self.block + 1
        self.bits = min(22, max(12, (8 * places * len(patterns)).bit_length()))
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        self.shift = np.full(1 << self.bits, places, np.uint8)
        for at in range(places):  # later blocks have smaller shifts and overwrite
            slots = self._slots(self._value(heads, at, self.block))
            self.shift[slots] = places - 1 - at
        self.prefix = min(8, self.m)
        self.prefix_mask = np.uint64((1 << 8 * self.prefix) - 1)
        self.starts = np.zeros(1 << self.bits, bool)
        self.starts[self._slots(self._value(heads, 0, self.prefix) + slots.astype(np.uint64))] = True
        bucket: dict[int, set[int]] = {}
        for slot, pattern in zip(slots.tolist(), patterns):
            bucket.setdefault(slot, set()).add(len(pattern))
        self.lengths = {slot: sorted(sizes) for slot, sizes in bucket.items()}

    @staticmethod
    def _value(heads: np.ndarray, at: int, size: int) -> np.ndarray:
        """The little-endian number that `size` bytes from `at` on make."""
        total = np.zeros(len(heads), np.uint64)
        for j in range(size):
            total |= heads[:, at + j].astype(np.uint64) << np.uint64(8 * j)
        return total

    def _slots(self, values: np.ndarray) -> np.ndarray:
        return ((values * _TIMES) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, eight: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places before `end` where a pattern may begin, and their suffix slots; `eight[i]` is the number that the 8
        bytes from i on make."""
        at = np.arange(0, max(0, end - self.m + 1), LANE)
        stop = np.minimum(at + LANE, end - self.m + 1)
        tail = self.m - self.block
        found, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            slots = self._slots(eight[at + tail] & self.mask)
            step = self.shift[slots].astype(np.int64)
            here = np.flatnonzero(step == 0)
            if len(here):
                step[here] = 1
                spot, own = at[here], slots[here]
                likely = self.starts[self._slots((eight[spot] & self.prefix_mask) + own.astype(np.uint64))]
                found.append(spot[likely])
                buckets.append(own[likely])
            at = at + step
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        return np.concatenate(found), np.concatenate(buckets)


class Search:
    """One block of windows: their classes, and the items of each window."""

    def __init__(self, windows: list[tuple[str, str | None]]):
        named: dict[bytes, set[str]] = {}
        for window, item in windows:
            named.setdefault(b" %b " % window.encode(), set()).update([] if item is None else [item])
        self.number = {pattern: k for k, pattern in enumerate(named)}
        self.items = [frozenset(items) for items in named.values()]
        self.words = [pattern.count(b" ") - 1 for pattern in named]
        classes: dict[int, list[bytes]] = {}
        for pattern in named:  # lengths below 8, 16, 32 bytes, and all longer ones
            classes.setdefault(min(6, max(3, len(pattern).bit_length())), []).append(pattern)
        self.classes = [Patterns(own) for own in classes.values()]

    def occurrences(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of every occurrence of a window."""
        padded = buffer + bytes(16)
        eight = np.ndarray((len(padded) - 8,), "<u8", padded, 0, (1,))
        at, which = [], []
        for own in self.classes:
            spots, slots = own.places(eight, len(buffer))
            for spot, slot in zip(spots.tolist(), slots.tolist()):
                for size in own.lengths.get(slot, ()):
                    k = self.number.get(buffer[spot:spot + size])
                    if k is not None:
                        at.append(spot)
                        which.append(k)
        return np.array(at, np.int64), np.array(which, np.int64)

    def scan(self, texts: list[bytes]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
        """Of each text the number of words, the stretches of words inside occurrences, and the items."""
        forms, counts = zip(*map(normal, texts)) if texts else ((), ())
        spans: list[list[dict]] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        buffer = b"\n".join(forms)  # no pattern has a line feed, so none crosses texts
        at, which = self.occurrences(buffer)
        if len(at):
            begins = np.concatenate([[0], np.cumsum([len(f) + 1 for f in forms])[:-1]]).astype(np.int64)
            firsts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            owner = np.searchsorted(begins, at, "right") - 1
            blanks = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
            # a text of n words has n + 1 blanks
            spare = np.concatenate([[0], np.cumsum(np.array(counts) > 0)[:-1]])
            word = np.searchsorted(blanks, at) - spare[owner]
            change = np.zeros(int(firsts[-1]) + 1, np.int64)
            np.add.at(change, word, 1)
            np.add.at(change, word + np.array(self.words, np.int64)[which], -1)
            hit = np.cumsum(change[:-1]) > 0
            order = np.argsort(owner, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                d = int(owner[own[0]])
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[firsts[d]:firsts[d + 1]], [False]]).astype(np.int8)))
                spans[d] = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                items[d] = sorted(frozenset().union(*[self.items[k] for k in set(which[own].tolist())]))
        return list(counts), spans, items


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct `(window, item)` of a benchmark."""
    plain = F.filter(F.split(F.translate(whole(text), UPPER, LOWER), GAPS), lambda w: w != "")
    cut = benchmark.select(F.col(item).cast("string").alias("item"), plain.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0)))
    return cut.select("item", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, WORDS), " "))).alias("window")) \
        .select("window", "item").distinct()


def _scanned(docs: DataFrame, search, only_hits: bool) -> DataFrame:
    """`docs (doc_id, text_hash, text)` searched for the broadcast `search`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = search.value.scan(batch.column(2).to_pylist())
            out = pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string())),
            ], names=["doc_id", "text_hash", "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

    return docs.mapInArrow(run, f"doc_id long, text_hash long, n_words long, spans {SPANS}, items array<string>")


def _united(spans: Column) -> Column:
    """Overlapping or touching stretches as one."""
    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1),
                         F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def found(documents: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: `doc_id`, `n_words`, `spans` (stretches of words inside benchmark windows) and the sorted `items`."""
    spark = ready(documents.sparkSession)
    rows = written(windows(benchmark), "benchmark-windows")
    size = rows.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_hash"),
                            whole(text).cast("binary").alias("text"))

    def search(block: int):
        own = rows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block)
        return spark.sparkContext.broadcast(Search([tuple(r) for r in own.collect()]))  # one block, about `block_bytes`

    if blocks == 1:
        return _scanned(docs, search(0), False).drop("text_hash")
    parts = None
    for block in range(blocks):
        shared = search(block)
        part = written(_scanned(docs, shared, True).dropDuplicates(["doc_id", "text_hash"]), "benchmark-findings")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    hits = parts.groupBy("doc_id", "text_hash").agg(
        _united(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "spans", "items")
    plain = docs.select("doc_id", "text_hash", F.size(F.filter(F.split(F.translate(F.decode("text", "UTF-8"), UPPER, LOWER), GAPS),
                                                               lambda w: w != "")).cast("long").alias("n_words"))
    both = plain.join(hits, plain["doc_id"].eqNullSafe(hits["_i"]) & (plain["text_hash"] == hits["_h"]), "left")
    return both.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def judged(documents: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words inside benchmark windows, the items they belong to as number and digest."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found(documents, benchmark, text, block_bytes).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WORDS}) AS k, array_to_string(w[i + 1 : i + {WORDS}], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WORDS}, 0) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
placed AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM split, sizes WHERE len(w) >= k)),
met AS (SELECT doc_id, p.k, i, item_id FROM placed p JOIN windows USING (s)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM met GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM split s LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
