"""Byte-level BPE: encoding and decoding by DuckDB queries inside each Spark partition.

The texts of an Arrow batch are cut into units at blanks, over all their bytes at once, and the distinct units into pieces
by the vocabulary's pattern. The distinct pieces that were not met before become
token-position rows; a recursive query joins neighbours with the merge table and contracts, in every
piece at once, the leftmost pair of the smallest rank, until no piece has a pair that can merge.
Decoding joins the token rows of a batch's distinct pieces with the vocabulary and concatenates in their order. A unit is its
pieces one after the other and a text its units: two Arrow `take`s for all texts of a batch.

Memory of a worker: one DuckDB connection with the vocabulary, memos bounded in bytes (the ids of pieces already
encoded) and a batch's units, pieces and results. Nothing is shuffled; a lost task is simply run again.

Defined cases: a null text is encoded like an empty one (no ids); repeated rows give repeated results;
an empty table gives an empty table; columns that are not named are carried along untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.shared import free_name, ready

MEMO_BYTES = 128 * 1024 * 1024  # of a generation of the pieces' memo; the one for decoding has a quarter of it
DUCKDB_MEMORY = "400MB"
LONG_PIECE = 128  # bytes; longer pieces leave the query for a queue, as it keeps every state of a piece
STATE_ROWS = 8_000_000  # bound on the states of one recursive query

# k holds the piece in its upper and the position in its lower 32 bits; positions count to a piece's last token, so tokens
# before a contracted pair move up by one. A row has its neighbour's id beside its own (-1: none).
ENCODE = """
WITH RECURSIVE state AS (
  SELECT k, id, follower, false AS done FROM seed
  UNION ALL
  SELECT a.k + coalesce(a.k < b.spot, false)::INT, CASE WHEN a.k = b.spot + 1 THEN b.merged ELSE a.id END,
         CASE WHEN a.k = b.spot - 1 THEN b.merged ELSE a.follower END, b.piece IS NULL
  FROM state a LEFT JOIN (
    SELECT piece, (piece << 32) + (best & 4294967295) AS spot, (best >> 32)::INT AS merged
    FROM (SELECT x.k >> 32 AS piece, min((m.merged::BIGINT << 32) + (x.k & 4294967295)) AS best
          FROM state x JOIN merges m ON m.pair = (x.id::BIGINT << 32) + x.follower
          WHERE NOT x.done GROUP BY x.k >> 32)) b ON a.k >> 32 = b.piece
  WHERE NOT a.done AND (b.piece IS NULL OR a.k <> b.spot)
)
SELECT k >> 32 AS piece, id FROM state WHERE done ORDER BY k
"""

DECODE = "SELECT coalesce(raw, ''::BLOB) AS raw FROM tokens LEFT JOIN vocabulary USING (id) ORDER BY pos"

# what a blank may follow without a cut: characters of several bytes that are white space
WIDE_SPACES = np.array([int.from_bytes(chr(c).encode(), "big") for c in
                        (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Memo(dict):
    """Results by key in two generations of at most `most` bytes each; a batch's own keys are always in the young one.

    When the young generation is full it becomes the old one, and what is asked for again moves back. Keys longer than
    `LONGEST` are forgotten with the next batch: they hardly come again and a few of them would fill the memory.
    """

    ENTRY, LONGEST = 250, 256  # bytes beside key and value, characters of a key

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size = most, 0
        self.old: dict = {}
        self.passing: list = []

    def missing(self, keys: set) -> list:
        """The keys without a result yet; `remember` theirs before the next call."""
        for key in self.passing:
            self.pop(key, None)
        self.passing = []
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        fresh = keys.difference(self)
        back = [key for key in fresh if key in self.old]
        self.remember(back, [self.old[key] for key in back])
        return list(fresh.difference(back))

    def remember(self, keys: list, values: list) -> None:
        self.update(zip(keys, values))
        lengths = list(map(len, keys))
        self.passing += [key for key, n in zip(keys, lengths) if n > self.LONGEST]
        self.size += sum(lengths) + self.ENTRY * len(keys)


def joined(values: pa.LargeBinaryArray) -> tuple[bytes, np.ndarray]:
    """All values one after the other, and where each begins and the last one ends."""
    if not len(values):
        return b"", np.zeros(1, dtype=np.int64)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    return data[int(ends[0]):int(ends[-1])].to_pybytes() if data else b"", ends - ends[0]


def parts(data: bytes, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """What lies between each two bounds."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(data)])


def breaks(data: bytes) -> np.ndarray:
    """Which bytes are blanks that follow something else than white space: no piece goes across the place before them."""
    codes = np.frombuffer(data, dtype=np.uint8)
    blank = np.flatnonzero(codes == 0x20)
    blank = blank[blank > 0]
    before = codes[blank - 1]
    apart = (before > 0x20) & (before < 0x7F)
    wide = np.flatnonzero(before >= 0x80)
    ends = blank[wide]
    two = codes[ends - 1] + (codes[ends - 2].astype(np.int64) << 8)
    three = two + (codes[np.maximum(ends - 3, 0)].astype(np.int64) << 16)
    apart[wide] = ~(np.isin(two, WIDE_SPACES) | np.isin(three, WIDE_SPACES))
    found = np.zeros(len(codes), dtype=bool)
    found[blank[apart]] = True
    return found


class Codec:
    """Vocabulary, merge table and memos of one worker."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO_BYTES):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            ranks = read_ranks(lines.readlines())
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        self.decimal = pa.array([f"{i} ".encode() for i in range(size)], pa.large_binary())
        self.spaced = np.zeros(size, dtype=bool)
        for token, rank in ranks.items():
            self.spaced[rank] = token[:1] == b" "
        self.con = duckdb.connect(":memory:", config={"threads": 1})
        self.con.execute(f"SET memory_limit='{DUCKDB_MEMORY}'")
        self.con.execute("SET temp_directory=''")
        splits = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        self.load("CREATE TABLE merges AS SELECT (lhs << 32) + rhs AS pair, merged::INT AS merged FROM given", {
            "lhs": [s[0] for s in splits], "rhs": [s[1] for s in splits], "merged": [s[2] for s in splits]})
        self.load("CREATE TABLE vocabulary AS SELECT id::INT AS id, raw FROM given", {
            "id": list(ranks.values()), "raw": list(ranks)})
        self.pieces, self.runs = Memo(memo), Memo(memo // 4)

    def load(self, sql: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(sql)
        self.con.unregister("given")

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed 32-bit ids of each piece; a piece of the vocabulary is its own token."""
        packed = [r if r is None else r.to_bytes(4, "little") for r in map(self.ranks.get, pieces)]
        rows = []
        for i in [i for i, p in enumerate(packed) if p is None]:
            if len(pieces[i]) > LONG_PIECE:
                packed[i] = self.contract_long(pieces[i])
            else:
                rows.append(i)
        if rows:
            states = np.cumsum(np.array([len(pieces[i]) for i in rows], dtype=np.int64) ** 2)
            cuts = np.flatnonzero(np.diff(states // (STATE_ROWS - LONG_PIECE ** 2))) + 1
            for a, b in pairwise([0, *cuts.tolist(), len(rows)]):
                self.contract(pieces, rows[a:b], packed)
        return packed

    def contract_long(self, piece: bytes) -> bytes:
        """The same contraction for one endless piece, whose query would keep a square of states: a queue of pairs."""
        rank, end = self.ranks, len(piece)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))  # neighbours of the token that starts here
        alive = [True] * end

        def push(a: int) -> None:
            b = after[a] if a >= 0 else end
            if b < end and (r := rank.get(piece[a:after[b]])) is not None:
                heapq.heappush(queue, (r, a, b, after[b]))

        queue: list[tuple[int, int, int, int]] = []
        for a in range(end - 1):
            push(a)
        while queue:
            _, a, b, c = heapq.heappop(queue)
            if alive[a] and alive[b] and after[a] == b and after[b] == c:
                alive[b], after[a] = False, c
                if c < end:
                    before[c] = a
                push(a)
                push(before[a])
        return b"".join(rank[piece[a:after[a]]].to_bytes(4, "little") for a in range(end) if alive[a])

    def contract(self, pieces: list[bytes], rows: list[int], packed: list[bytes]) -> None:
        """Contract the pieces `rows` points at by the recursive query and put their ids into `packed`."""
        sizes = np.array([len(pieces[i]) for i in rows], dtype=np.int64)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = np.frombuffer(b"".join(pieces[i] for i in rows), dtype=np.uint8)
        key = (np.repeat(np.array(rows, dtype=np.int64), sizes) << 32) + (np.arange(len(flat), dtype=np.int64) - starts)
        ids = self.byte_ids[flat]
        follower = np.append(ids[1:], np.int32(-1))
        follower[np.cumsum(sizes) - 1] = -1
        self.con.register("seed", pa.table({"k": key, "id": ids, "follower": follower}))
        found = self.con.sql(ENCODE).to_arrow_table()
        self.con.unregister("seed")
        owner, values = found["piece"].to_numpy(), found["id"].to_numpy().astype("<i4").tobytes()
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for piece, (a, b) in zip(owner[starts].tolist(), pairwise([*(starts * 4).tolist(), len(values)])):
            packed[piece] = values[a:b]

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The units of all texts in their order, and which of them is the first of each text and of the end."""
        data, offsets = joined(pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary()))
        starts = breaks(data)
        starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(starts)
        return parts(data, np.append(starts, len(data))).dictionary_encode(), np.searchsorted(starts, offsets)

    def split(self, units: pa.LargeBinaryArray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all units in their order, and which of them is the first of each unit and of the end."""
        data, offsets = joined(units)
        apart = offsets[:-1][~breaks(data)[offsets[:-1]]]  # a text may run on from one unit to the next only over a break
        found: list[str] = []
        for a, b in pairwise([*apart.tolist(), len(data)]):
            found += self.pattern.findall(data[a:b].decode())
        pieces = pa.array(found, pa.large_string()).cast(pa.large_binary())
        ends = joined(pieces)[1]
        if ends[-1] == len(data):
            return pieces.dictionary_encode(), np.searchsorted(ends, offsets)
        own = [self.pattern.findall(data[a:b].decode()) for a, b in pairwise(offsets.tolist())]  # it leaves characters out
        first = np.cumsum([0, *map(len, own)])
        return pa.array([p.encode() for pieces in own for p in pieces], pa.large_binary()).dictionary_encode(), first

    def known(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pieces."""
        if fresh := self.pieces.missing(set(pieces)):
            self.pieces.remember(fresh, self.encode_pieces(fresh))
        return list(map(self.pieces.__getitem__, pieces))

    def decimals(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decimals of the ids with a blank after each, and where each begins and the last one ends."""
        return joined(self.decimal.take(pa.array(ids)))

    def decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes that the ids stand for, by one query, and where each begins and the last one ends."""
        self.con.register("tokens", pa.table({"pos": np.arange(len(ids)), "id": ids}))
        found = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("tokens")
        return joined(found["raw"].cast(pa.large_binary()).combine_chunks())

    def coded(self, texts: pa.Array, *forms: Callable) -> list[tuple[bytes, list[int]]]:
        """The packed ids of all texts together and each of their `forms` (`decimals`, `decoded`), with the places where the
        texts begin and the last one ends."""
        units, first_unit = self.cut(texts)
        pieces, first_piece = self.split(units.dictionary)
        data, ends = joined(pieces.dictionary)
        packed, ends = joined(pa.array(self.known([data[a:b] for a, b in pairwise(ends.tolist())]), pa.large_binary()))
        ids = np.frombuffer(packed, dtype="<i4")
        results = []
        for data, places in [(packed, ends), *((data, at[ends // 4]) for data, at in (form(ids) for form in forms))]:
            data, places = joined(parts(data, places).take(pieces.indices))
            data, places = joined(parts(data, places[first_piece]).take(units.indices))
            results.append((data, places[first_unit].tolist()))
        return results

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        packed, ends = self.coded(pa.array(texts, pa.large_string()))[0]
        return [packed[a:b] for a, b in pairwise(ends)]

    def decode_runs(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence."""
        raw, at = self.decoded(np.frombuffer(b"".join(packed), dtype="<i4"))
        return [raw[a:b] for a, b in pairwise(at[np.cumsum([0, *map(len, packed)]) // 4].tolist())]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence. Runs that begin at a token with a leading blank are the memo's keys."""
        cut: list[list[bytes]] = []
        distinct: set[bytes] = set()
        for ids in packed:
            at = np.flatnonzero(self.spaced[np.frombuffer(ids, dtype="<i4")]) * 4
            ends = [0, *at[at > 0].tolist(), len(ids)]
            runs = [ids[a:b] for a, b in pairwise(ends)] if ids else []
            cut.append(runs)
            distinct.update(runs)
        if new := self.runs.missing(distinct):
            self.runs.remember(new, self.decode_runs(new))
        return [b"".join(map(self.runs.__getitem__, runs)) for runs in cut]


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; it outlives a task, and so does its memo."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _lists(packed: bytes, ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.array(ends) // 4, pa.int32()), pa.array(np.frombuffer(packed, dtype="<i4")))


def _append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _digests(whole: bytes, ends: list[int], after: int = 0) -> list[str]:
    """Of each part without its last `after` bytes, if it has any."""
    view = memoryview(whole)
    return [hashlib.sha256(view[a:max(a, b - after)]).hexdigest() for a, b in pairwise(ends)]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with the array of token ids of `text` under `ids`."""
    ready(df.sparkSession)
    if ids.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {ids} already")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, ends = codec(path, pattern).coded(batch.column(names.index(text)))[0]
            yield _append(batch, {ids: _lists(packed, ends)})

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """`df` with the bytes that `ids` stand for under `raw`; null ids give empty bytes."""
    ready(df.sparkSession)
    if raw.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {raw} already")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(i or [], dtype="<i4").tobytes() for i in batch.column(names.index(ids)).to_pylist()]
            yield _append(batch, {raw: pa.array(codec(path, pattern).decode(packed), pa.binary())})

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(raw, T.BinaryType())]))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Per row: `doc_id`, the number of ids, a digest of the ids and one of the bytes decoded from them.

    Encoding and decoding in one pass, without the ids in between leaving the worker.
    """
    ready(df.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path, pattern)
            packed, named, raw = own.coded(batch.column(1), own.decimals, own.decoded)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_tokens": pa.array(np.diff(packed[1]) // 4, pa.int64()),
                "ids_sha256": _digests(*named, 1),
                "decoded_sha256": _digests(*raw),
            })

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def reencoded(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Pipeline form: all columns, `text` replaced by what its ids decode to, and the ids with their number, in one pass.

    A null text stays null and has no ids; repeated rows get the same ids each; an empty table stays empty; where `df` has a
    column of such a name already, the new ones get an underscore more.
    """
    ready(df.sparkSession)
    names, place = df.columns, df.columns.index(text)
    ids = free_name(df, ids)
    n_tokens = free_name(df, n_tokens)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n_tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(place)
            own = codec(path, pattern)
            (packed, starts), (raw, ends) = own.coded(given, own.decoded)
            back = [raw[a:b].decode() if t else None for (a, b), t in zip(pairwise(ends), given.is_valid().to_pylist())]
            columns = list(batch.columns)
            columns[place] = pa.array(back, given.type)
            yield pa.RecordBatch.from_arrays(
                [*columns, _lists(packed, starts), pa.array(np.diff(starts) // 4, pa.int64())], names=[*names, ids, n_tokens])

    return df.mapInArrow(run, schema)
