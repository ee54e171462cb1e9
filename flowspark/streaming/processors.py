"""Stateful operators on the engine's state store: changing results, growing series, late rows, joins by timers.

Each is a `StatefulProcessor` over `transformWithState`; its state is per key, versioned with the query's checkpoint, and lies
in the RocksDB store, not in a worker's memory. Run them with `windows.run_to_table`, which selects that store.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from flowspark.streaming.windows import arrival_time

PART = 4096  # points of a series in one row
MERGE = {"count": lambda a, b: a + b, "sum": lambda a, b: a + b, "min": min, "max": max}


def _ddl(fields: Iterable[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def _both(merge, a, b):
    return b if a is None else a if b is None else merge(a, b)


# -- a changing result ----------------------------------------------------------------------

class _Changes(StatefulProcessor):
    """Aggregates of a key; the state is the row that was last given out."""

    def __init__(self, keys: list[str], how: dict[str, str], state: T.StructType):
        self.keys, self.how, self.schema = keys, how, state

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = dict(zip(self.how, self.last.get())) if self.last.exists() else None
        new = dict(old) if old is not None else dict.fromkeys(self.how)
        for row in rows:
            for name, how in self.how.items():
                new[name] = _both(MERGE[how], new[name], row[name])
        if new == old:
            return
        names = dict(zip(self.keys, key))
        self.last.update(tuple(new.values()))
        if old is not None:
            yield Row(**names, **old, change="retract")
        yield Row(**names, **new, change="insert")

    def close(self) -> None:
        pass


def changes(df: DataFrame, keys: Sequence[str], **aggs: tuple[str, str | None]) -> DataFrame:
    """Every change of a grouped result: the new row (`change` = insert) and, when the key was known, the one it replaces
    (retract). `aggs`: name = ("count", None) or ("sum" | "min" | "max", column).

    Each partition adds up its rows before they are shuffled, so a hot key sends one row per Arrow batch; a batch writes
    the state and the changes of its own keys only.
    """
    how = {name: fn for name, (fn, _) in aggs.items()}
    picked = df.select(*keys, *[(F.lit(1).cast("long") if fn == "count" else F.col(c)).alias(n) for n, (fn, c) in aggs.items()])
    names = list(aggs)
    partial = T.StructType([picked.schema[k] for k in keys] + [
        T.StructField(n, T.LongType() if how[n] == "count" or (how[n] == "sum" and isinstance(picked.schema[n].dataType, T.IntegralType))
                      else T.DoubleType() if how[n] == "sum" else picked.schema[n].dataType) for n in names])
    arrow = to_arrow_schema(partial)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(list(keys)).aggregate(
                [(n, "sum" if how[n] == "count" else how[n]) for n in names])
            table = table.select([*keys, *[f"{n}_{'sum' if how[n] == 'count' else how[n]}" for n in names]]).rename_columns(arrow.names).cast(arrow)
            yield from table.to_batches()

    state = _ddl(partial[n] for n in names)
    out = T.StructType([*[partial[k] for k in keys], *[partial[n] for n in names], T.StructField("change", T.StringType())])
    return picked.mapInArrow(add_up, partial).groupBy(*keys).transformWithState(_Changes(list(keys), how, state), out, "append", "None")


# -- growing series ---------------------------------------------------------------------------

class _Series(StatefulProcessor):
    """All points of a key in arrival order, in parts of `PART`; only the last part is ever rewritten."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", "n long")
        self.parts = handle.getMapState("parts", "part long", "times array<long>, values array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.total.get()[0] if self.total.exists() else 0
        total, first = known, known // PART
        times: list[int] = []
        values: list[float] = []
        if known % PART:
            times, values = map(list, self.parts.getValue((first,)))
        touched = []
        for row in rows:
            times.append(row["_t"])
            values.append(row["_v"])
            total += 1
            if total % PART == 0:
                self.parts.updateValue((total // PART - 1,), (times, values))
                touched.append(total // PART - 1)
                times, values = [], []
        if times:
            self.parts.updateValue((total // PART,), (times, values))
            touched.append(total // PART)
        self.total.update((total,))
        if total > 2:
            for part in touched:
                t, v = self.parts.getValue((part,))
                yield Row(**{self.key: key[0]}, total=total, part=part, times=list(t), values=list(v))

    def close(self) -> None:
        pass


def rolling_series(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """All points of each key as they arrive, once there are more than two: `(key, total, part, times, values)`.

    A series has parts of `PART` points, in arrival order; a batch gives out the parts it changed, the newest row of a
    part (that of the greatest `total`) counts. No point is ever dropped and no row grows with the series.
    """
    out = T.StructType([df.schema[key], *T.StructType.fromDDL("total long, part long, times array<long>, `values` array<double>").fields])
    ready = df.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("_t"), F.col(value).cast("double").alias("_v"))
    return ready.groupBy(key).transformWithState(_Series(key), out, "append", "None")


# -- late rows --------------------------------------------------------------------------------

class _Late(StatefulProcessor):
    """Marks the rows that lie behind the watermark; the watermark is the engine's own."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for row in rows:
            yield Row(**{n: row[n] for n in self.names}, late=row["_t"] is not None and row["_t"] < mark)

    def close(self) -> None:
        pass


def mark_late(df: DataFrame, ts: str, slots: int = 4096) -> DataFrame:
    """`df` (with a watermark on `ts`) with `late`: whether the row lay behind the watermark when it came.

    Rows are dealt out by their hash, as the mark needs no key. A row without a time is never late.
    """
    plain = [f.name for f in df.schema.fields]
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    # without its event time column the engine doesn't drop late rows by itself
    coded = df.select(*[F.unix_micros(c).alias(c) if c in times else F.col(c) for c in plain],
                      F.unix_micros(ts).alias("_t"), F.pmod(F.xxhash64(*plain), F.lit(slots)).alias("_slot"))
    out = T.StructType([*[coded.schema[c] for c in plain], T.StructField("late", T.BooleanType())])
    told = coded.groupBy("_slot").transformWithState(_Late(plain), out, "append", "EventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in times})


# -- joins of two streams -----------------------------------------------------------------------

def _tagged(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], times: tuple[str | None, str | None],
            prefixes: tuple[str, str]) -> tuple[DataFrame, list[str], list[str], list[str]]:
    """Both sides as rows of one table: keys as text, `_left`, `_t` and the prefixed columns; timestamps as microseconds."""
    fields = [T.StructField(p + f.name, f.dataType) for p, df in zip(prefixes, (left, right)) for f in df.schema.fields]
    stamps = [f.name for f in fields if isinstance(f.dataType, T.TimestampType)]
    parts = []
    for side, df in enumerate((left, right)):
        keys = [F.coalesce(F.col(pair[side]).cast("string"), F.lit("")).alias(f"_k{i}") for i, pair in enumerate(on)]
        own = {prefixes[side] + c for c in df.columns}
        at = F.lit(None).cast("long") if times[side] is None else F.unix_micros(times[side])
        parts.append(df.select(*keys, F.lit(side == 0).alias("_left"), at.alias("_t"), *[
            (F.unix_micros(f.name.removeprefix(prefixes[side])) if f.name in stamps else F.col(f.name.removeprefix(prefixes[side]))).alias(f.name)
            if f.name in own else F.lit(None).cast("long" if f.name in stamps else f.dataType).alias(f.name) for f in fields]))
    both = parts[0].unionByName(parts[1])
    return both, [f"_k{i}" for i in range(len(on))], [f.name for f in fields], stamps


class _SessionJoin(StatefulProcessor):
    """Open rows of a key from both sides and the sessions they form; a session's pairs come out when its timer fires."""

    def __init__(self, fields: T.StructType, n_left: int, gap: int):
        self.fields, self.n_left, self.gap = fields, n_left, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", T.StructType([T.StructField("_left", T.BooleanType()), T.StructField("_t", T.LongType()), *self.fields]))
        self.sessions = handle.getValueState("sessions", "spans array<struct<first:long,last:long>>")

    def _timer(self, spans: list) -> int | None:
        """The first millisecond at which the earliest of the sessions is over."""
        return -(-(spans[0][1] + self.gap) // 1000) if spans else None

    def _keep(self, old: list, spans: list) -> None:
        """A key has one timer, that of its earliest session, however many are open."""
        before, after = self._timer(old), self._timer(spans)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        if spans:
            self.sessions.update((spans,))
        else:
            self.sessions.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.fields.names
        new = [(row["_left"], row["_t"], *[row[n] for n in names]) for row in rows if row["_t"] is not None]
        if not new:
            return iter(())
        self.rows.appendList(new)
        known = self.sessions.get()
        old = [tuple(s) for s in known[0]] if known is not None else []
        spans: list[tuple[int, int]] = []
        for first, last in sorted(old + [(r[1], r[1]) for r in new]):
            if spans and first - spans[-1][1] < self.gap:
                spans[-1] = spans[-1][0], max(last, spans[-1][1])
            else:
                spans.append((first, last))
        self._keep(old, spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = [tuple(s) for s in self.sessions.get()[0]]
        # sessions lie apart, so those that are over come first
        over = bisect_right(spans, now, key=lambda s: self._timer([s]))
        starts, kept, closed = [s[0] for s in spans[:over]], [], [([], []) for _ in range(over)]
        for row in map(tuple, self.rows.get()):
            if over and row[1] <= spans[over - 1][1]:
                closed[bisect_right(starts, row[1]) - 1][0 if row[0] else 1].append(row)
            else:
                kept.append(row)
        if kept:
            self.rows.put(kept)
        else:
            self.rows.clear()
        if spans[over:]:
            self.handle.registerTimer(self._timer(spans[over:]))
            self.sessions.update((spans[over:],))
        else:
            self.sessions.clear()
        names, cut = self.fields.names, self.n_left
        for (first, last), (left, right) in zip(spans, closed):
            for a in left:
                for b in right:
                    yield Row(_first=first, _end=last + self.gap, **dict(zip(names, (*a[2:2 + cut], *b[2 + cut:]))))

    def close(self) -> None:
        pass


def session_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_ts: str, right_ts: str,
                 gap_seconds: float, prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Pairs with equal keys in one session that both sides' rows form together; both sides need watermarks.

    A key's open rows are kept until the watermark has passed their session's end, then its pairs come out once.
    Keys are compared as text, missing ones as "". Rows without a time belong to no session.
    """
    both, keys, names, stamps = _tagged(left, right, on, (left_ts, right_ts), prefixes)
    fields = _ddl(both.schema[n] for n in names)
    out = T.StructType([T.StructField("_first", T.LongType()), T.StructField("_end", T.LongType()), *fields])
    met = both.groupBy(*keys).transformWithState(_SessionJoin(fields, len(left.columns), int(gap_seconds * 1e6)), out, "append", "EventTime")
    return met.select(F.timestamp_micros("_first").alias("w_start"), F.timestamp_micros("_end").alias("w_end"),
                      *[F.timestamp_micros(n).alias(n) if n in stamps else F.col(n) for n in names])


class _ArrivalJoin(StatefulProcessor):
    """Rows of both sides that arrived in the window that is open; a new row meets those of the other side at once."""

    def __init__(self, fields: T.StructType, n_left: int, size: int):
        self.fields, self.n_left, self.size = fields, n_left, size

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long")
        self.sides = [handle.getListState(name, self.fields) for name in ("left", "right")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names, cut = self.fields.names, self.n_left
        new: tuple[list, list] = ([], [])
        for row in rows:
            now = row["_t"] // 1000  # the same for all rows of a micro-batch
            new[0 if row["_left"] else 1].append(tuple(row[n] for n in names))
        start = now - now % self.size
        if self.window.exists() and self.window.get()[0] != start:
            self._forget()
        if not self.window.exists():
            self.window.update((start,))
            self.handle.registerTimer(start + self.size)
        for side in (0, 1):  # new left rows meet old right rows; new right rows all left rows
            if new[side]:
                others = self.sides[1 - side]
                for b in map(tuple, others.get() if others.exists() else ()):
                    for a in new[side]:
                        one, two = (a, b) if side == 0 else (b, a)
                        yield Row(_start=start, **dict(zip(names, (*one[:cut], *two[cut:]))))
                self.sides[side].appendList(new[side])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.window.exists() and self.window.get()[0] + self.size <= expiredTimerInfo.getExpiryTimeInMs():
            self._forget()
        return iter(())

    def _forget(self) -> None:
        self.window.clear()
        for side in self.sides:
            side.clear()

    def close(self) -> None:
        pass


def arrival_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], size_seconds: float,
                 prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Pairs with equal keys that arrive in one tumbling window, whichever side comes first.

    A pair comes out with the later of its rows. Arrival is the time of the micro-batch, which the checkpoint keeps for a
    repeated batch. It is event time to the engine, so rows are forgotten when later arrivals have passed their window's
    end; timers of processing time would keep a query that reads what there is from ever ending.
    """
    both, keys, names, stamps = _tagged(left, right, on, (None, None), prefixes)
    both = arrival_time(both.drop("_t"), "_arrived").withColumn("_t", F.unix_micros("_arrived")).drop("_arrived")
    fields = _ddl(both.schema[n] for n in names)
    out = T.StructType([T.StructField("_start", T.LongType()), *fields])
    met = both.groupBy(*keys).transformWithState(_ArrivalJoin(fields, len(left.columns), int(size_seconds * 1000)), out, "append", "EventTime")
    return met.select(F.timestamp_millis("_start").alias("w_start"), *[F.timestamp_micros(n).alias(n) if n in stamps else F.col(n) for n in names])
