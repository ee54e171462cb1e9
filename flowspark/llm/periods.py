"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q and at least max(`LEAST`, 3 q) words that no neighbouring
word extends. All runs of a text are found:

1. Periods below `SHORT`: direct lag scans. A run matches itself q words on over at least `LEAST` - q places, so every
   `LEAST` - `SHORT` + 1-th place is tried and one of them seeds it.
2. Longer periods, by scales [P, R) with R about 1.5 P: the value of a place is the hash of the R - 1 words from there
   on. Of each window of 2 P words the place with the smallest value (the first of equals) is a minimizer. Inside a run
   windows q apart are equal and select places q apart with equal values; as a value spans at least one period, no
   equal value lies in between (a primitive word meets itself only at whole periods). So minimizers are sorted by value,
   and neighbours at a distance in [P, R) are seeds: one row per minimizer, never all pairs of a value.
3. A seed (place, q) is extended both ways as far as words q apart agree, by binary search over hashes of slices, all
   seeds at once, then confirmed word by word. Of equal stretches the smallest period stays.

Texts of like length share one numpy array with unique marks in between, so a batch costs a few dozen array operations
per scale; the work of a text of n words is about n log n. All of it is local to a row: nothing is shuffled, a lost task
is run again.

Defined cases: a null text has no words and no runs; repeated rows get the same result each; equal exponents fall to the
smallest start, then the smallest period; an empty table gives an empty table; a null `doc_id` plants nothing in `judged`;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.minhash import word_hashes
from flowspark.llm.shared import ready, whole
from flowspark.llm.substrings import Slices

LEAST = 24      # words of a run at least
TIMES = 3       # periods of a run at least
SHORT = 8       # periods below are scanned directly
PORTION = 1 << 18  # words that share an array, or one longer text

Run = tuple[int, int, int]  # start, length, period


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` consecutive values, by doubling."""
    width, least = 1, values
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:len(values) - span + 1], least[span - width:]) if span > width else least


def minimizers(values: np.ndarray, span: int) -> np.ndarray:
    """Places of the first smallest value of each `span` consecutive ones, ascending; the lower bits hold the place."""
    bits = np.uint64(len(values).bit_length())
    packed = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    at = sliding_least(packed, span) & ((np.uint64(1) << bits) - np.uint64(1))
    return at[np.concatenate([[True], at[1:] != at[:-1]])].astype(np.int64)


def _scales(longest: int) -> Iterator[tuple[int, int]]:
    low = SHORT
    while TIMES * low <= longest:
        high = -(-3 * low // 2)
        yield low, high
        low = high


def seeds(words: np.ndarray, part: Slices, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that runs of texts of at most `longest` words contain."""
    n = len(words)
    places, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, min(SHORT - 1, longest // TIMES) + 1):
        at = np.arange(0, n - lag, LEAST - SHORT + 1)
        at = at[words[at] == words[at + lag]]
        places.append(at)
        lags.append(np.full(len(at), lag))
    for low, high in _scales(longest):
        size = high - 1
        if n < 2 * low:
            break
        values = part.of(np.arange(n - size + 1), np.arange(size, n + 1))
        at = minimizers(values, 2 * low - size + 1)
        own = values[at]
        order = np.argsort(own, kind="stable")  # equal values keep the order of places
        at, own = at[order], own[order]
        gap = at[1:] - at[:-1]
        good = (own[1:] == own[:-1]) & (gap >= low) & (gap < high)
        places.append(at[:-1][good])
        lags.append(gap[good])
    return np.concatenate(places), np.concatenate(lags)


def _agreeing(part: Slices, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words behind (or before, `back`) the places `a` and `b` agree, `most` at most."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        if back:
            same = part.of(a - middle, a) == part.of(b - middle, b)
        else:
            same = part.of(a, a + middle) == part.of(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _stretch(words: np.ndarray, place: int, lag: int) -> Run:
    """The stretch around a place by comparing word by word, where hashes of slices were equal by chance."""
    differ = np.flatnonzero(words[lag:] != words[:-lag])
    k = int(np.searchsorted(differ, place))
    start = int(differ[k - 1]) + 1 if k else 0
    end = int(differ[k]) if k < len(differ) else len(words) - lag
    return start, max(end - start, 0) + lag, lag


def _runs(words: np.ndarray, longest: int) -> np.ndarray:
    """`(start, length, period)` of all runs of an array of marked-off texts, by start, then period."""
    part = Slices(words)
    at, lag = seeds(words, part, longest)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    ahead = _agreeing(part, at, at + lag, len(words) - at - lag, False)
    behind = _agreeing(part, at, at + lag, at, True)
    length = behind + ahead + lag
    good = length >= np.maximum(LEAST, TIMES * lag)
    rows = np.unique(np.stack([at[good] - behind[good], length[good], lag[good]], axis=1), axis=0)
    for k, (start, size, period) in enumerate(rows.tolist()):
        if not np.array_equal(words[start:start + size - period], words[start + period:start + size]):
            rows[k] = _stretch(words, start, period)
    rows = np.unique(rows[rows[:, 1] >= np.maximum(LEAST, TIMES * rows[:, 2])], axis=0)
    first = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[:len(rows)]
    rows = rows[first]  # sorted by start, length, period: of equal stretches the smallest period
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """All runs of each text, given as an array of word hashes; by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    classes: dict[int, list[int]] = {}
    for i, words in enumerate(texts):
        if len(words) >= LEAST:
            classes.setdefault(len(words).bit_length() // 2, []).append(i)
    for own in classes.values():
        at = 0
        while at < len(own):
            group, total = [], 0
            while at < len(own) and (not group or total + len(texts[own[at]]) <= PORTION):
                group.append(own[at])
                total += len(texts[own[at]]) + 1
                at += 1
            marked = [x for k, i in enumerate(group) for x in (texts[i], np.array([k + 1], np.uint64))]
            begins = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in group])])
            rows = _runs(np.concatenate(marked), max(len(texts[i]) for i in group))
            owner = np.searchsorted(begins, rows[:, 0], "right") - 1
            for k, (start, length, period) in zip(owner.tolist(), rows.tolist()):
                out[group[k]].append((start - int(begins[k]), length, period))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period, then the smallest start, then period."""
    best: Run | None = None
    for run in runs:
        if best is None or (run[1] * best[2], -run[0], -run[2]) > (best[1] * run[2], -best[0], -best[2]):
            best = run
    return best


def repeated(n: int, runs: list[Run]) -> np.ndarray:
    """Which of `n` words a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def _without(words: list[bytes], runs: list[Run]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = repeated(len(words), runs).tolist()
    return b" ".join([w for w, g in zip(words, gone) if not g])


def found(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: `doc_id`, `n_words`, `runs` in words and `collapsed`, the text with each run cut to its first period."""
    ready(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            runs = runs_of([word_hashes(t) for t in texts])
            words = [t.split() for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(map(len, words), pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array([_without(w, own).decode() for w, own in zip(words, runs)], pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole(text).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text that gets a planted run, None for other texts."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    start = g % n
    place = np.arange(n)
    place[start:] = start + (place[start:] - start) % (1 + (n - start) // (3 + g % 8))
    return place


def judged(documents: DataFrame, text: str = "text") -> DataFrame:
    """Digests of the runs and collapsed texts, a run planted in about a tenth of the texts."""
    ready(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, own = raw.split(), word_hashes(raw)
                place = planted(i, len(words))
                if place is not None:
                    words, own = [words[p] for p in place.tolist()], own[place]
                texts.append(words)
                hashes.append(own)
            runs = runs_of(hashes)
            best = [strongest(own) for own in runs]
            listed = ["".join(f"{s},{n},{q}\n" for s, n, q in own) for own in runs]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_runs": pa.array(map(len, runs), pa.int64()),
                "start": pa.array([b and b[0] for b in best], pa.int64()), "length": pa.array([b and b[1] for b in best], pa.int64()),
                "period": pa.array([b and b[2] for b in best], pa.int64()),
                "exponent_milli": pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                "runs_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in listed],
                "collapsed_sha256": [hashlib.sha256(_without(w, own)).hexdigest() for w, own in zip(texts, runs)]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole(text).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


#: crc32 (reflected polynomial 0xEDB88320) of a blob's hex text, by a table that a recursive query fills
CRC_TABLE = """crc_steps AS (
  SELECT i AS slot, i::BIGINT AS c, 0 AS step FROM range(256) r(i) UNION ALL
  SELECT slot, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_steps WHERE step < 8),
crc AS (SELECT list(c ORDER BY slot) AS t FROM crc_steps WHERE step = 8)"""


def crc32_sql(hex_text: str) -> str:
    """SQL for the unsigned crc32 of bytes given as hex; the table `crc` must be in scope."""
    codes = f"list_transform(range(1, len({hex_text}) + 1, 2), lambda i: ('0x' || {hex_text}[i : i + 1])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
hashed AS (SELECT doc_id, w, len(w) AS n, {crc32_sql("hex(encode(doc_id::VARCHAR))")} AS h FROM split, crc),
planted AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g, w FROM hashed),
edited AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM planted),
word AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM edited WHERE n > 0),
pair AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM island GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT doc_id, s, len, min(q) AS q FROM stretch GROUP BY doc_id, s, len),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
best AS (SELECT doc_id, s, len, q FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) AS r FROM run) WHERE r = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period,
  (1000 * len // q)::BIGINT AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM edited e LEFT JOIN listed l USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
