import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators import models
from flowspark.streaming import joins, lookup, processors, windows

T0 = dt.datetime(2018, 1, 1)
SCHEMA = "a string, b int, eventTime long"
# fixture: three keys, three rows each, one second apart
LEFT = [(k, b, i) for i, (k, b) in enumerate([("x", 15), ("x", 15), ("x", 16), ("y", 15), ("y", 16), ("y", 17), ("z", 20), ("z", 21), ("z", 22)])]
RIGHT = [(k + "2", b, i) for k, b, i in LEFT]


def drop(folder, name, rows, names):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for r in rows:
            f.write(json.dumps(dict(zip(names, r))) + "\n")


def live(spark, folder, schema=SCHEMA, **options):
    return spark.readStream.schema(schema).options(**options).json(str(folder))


def events(rows, step=1000):
    base = int(T0.timestamp()) * 1000
    return [(a, b, base + i * step) for a, b, i in rows]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def left(tmp_path):
    drop(tmp_path / "l", "1.json", events(LEFT), ("a", "b", "eventTime"))
    return tmp_path / "l"


def test_sql_on_a_stream(spark, left):
    live(spark, left).createOrReplaceTempView("t_live")
    assert windows.finished(spark.sql("SELECT * FROM t_live")).count() == 9
    assert windows.finished(spark.sql("SELECT * FROM t_live WHERE a = 'x'")).count() == 3
    out = windows.finished(spark.sql("SELECT a, sum(b) AS s FROM t_live GROUP BY a"), "update")
    assert dict(rows(out))["x"] == 46


def test_windows_in_event_time(spark, left):
    stream = windows.event_time(live(spark, left), "eventTime", "0 seconds")
    out = windows.finished(windows.window_aggregate(stream, windows.tumbling("eventTime", "3 seconds"), [], n=F.count("*"), s=F.sum("b")))
    assert [(r["n"], r["s"]) for r in out.orderBy("w_start").collect()] == [(3, 46), (3, 48)]   # the last window is still open


def test_window_joins(spark, tmp_path, left):
    drop(tmp_path / "r", "1.json", events(RIGHT), ("a2", "b", "eventTime"))
    l = windows.event_time(live(spark, left), "eventTime", "2 seconds")
    r = windows.event_time(live(spark, tmp_path / "r", "a2 string, b int, eventTime long"), "eventTime", "2 seconds")
    got = windows.finished(joins.window_join(l, r, [("b", "b")], "eventTime", "eventTime", "1 second"))
    assert got.count() == 9                                              # one second holds one row per side
    wide = windows.finished(joins.window_join(l, r, [("b", "b")], "eventTime", "eventTime", "4 seconds", "2 seconds"))
    want = 0
    for w in range(-2, 10, 2):
        inside = [(k, b, i) for k, b, i in LEFT if w <= i < w + 4]
        want += sum(1 for x in inside for y in inside if x[1] == y[1])
    assert wide.count() == want


def test_reference_tables(spark, left, tmp_path):
    loads = []

    def load():
        loads.append(1)
        return spark.createDataFrame([("x", "X1"), ("x", "X2"), ("y", "Y")], "a string, n string")

    folder = str(tmp_path / "full")
    step = lookup.full_lookup(lookup.Refreshed(load, 3600), ["a"], lambda d, n: d.write.mode("overwrite").parquet(f"{folder}/{n}"))
    windows.run_to_table(live(spark, left), each=step)
    assert spark.read.parquet(f"{folder}/0").count() == 6 + 3 + 3 and loads == [1]
    with pytest.raises(ValueError):
        lookup.full_lookup(lookup.Refreshed(load), ["a"], print, "right")
    step = lookup.keyed_lookup(load, "a", "a", lambda d, n: d.write.mode("overwrite").parquet(f"{folder}/k{n}"))
    windows.run_to_table(live(spark, left), each=step)
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/k0").select("a", "n").collect()} == {("x", "X1"), ("y", "Y"), ("z", None)}
    sql = "SELECT s.a, d.n FROM s LEFT JOIN d ON s.a = d.a"
    windows.run_to_table(live(spark, left), each=lookup.side_sql(sql, "s", {"d": lambda own: own.createDataFrame([("x", "X1"), ("x", "X2"), ("y", "Y")], "a string, n string")}, lambda d, n: d.write.parquet(f"{folder}/q{n}")))
    assert spark.read.parquet(f"{folder}/q0").count() == 12


def test_refreshed_table_is_loaded_again_when_old(spark):
    loads = []
    table = lookup.Refreshed(lambda: (loads.append(1), spark.range(len(loads)))[1], seconds=-1)
    assert table.get().count() == 1 and table.get().count() == 2


def test_change_log_over_two_batches(spark, tmp_path):
    folder, state_folder = tmp_path / "in", str(tmp_path / "s")
    os.makedirs(folder)
    log = processors.changes(live(spark, folder, "k string, v int"), ["k"], s=("sum", "v"), n=("count", None), top=("max", "v"))
    drop(folder, "1.json", [("a", 1), ("b", 1), ("b", None), ("c", None)], ("k", "v"))
    windows.run_to_table(log, folder=state_folder)
    drop(folder, "2.json", [("a", 5), (None, 2)], ("k", "v"))
    windows.run_to_table(log, folder=state_folder)
    got = spark.read.parquet(f"{state_folder}/out").select("batch", "k", "s", "n", "top", "change").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (0, "a", 1, 1, 1, "insert"), (0, "b", 1, 2, 1, "insert"), (0, "c", None, 1, None, "insert"),
        (1, "a", 1, 1, 1, "retract"), (1, "a", 6, 2, 5, "insert"), (1, None, 2, 1, 2, "insert")], key=str)


def test_a_batch_writes_the_changes_of_its_own_keys(spark, tmp_path):
    folder, state_folder = tmp_path / "in", str(tmp_path / "s")
    os.makedirs(folder)
    log = processors.changes(live(spark, folder, "k string, v int"), ["k"], s=("sum", "v"))
    sizes = []
    for n, keys in enumerate((3000, 3, 3)):
        drop(folder, f"{n}.json", [(f"k{i}", 1) for i in range(keys)], ("k", "v"))
        windows.run_to_table(log, folder=state_folder)
        sizes.append(spark.read.parquet(f"{state_folder}/out").where(F.col("batch") == n).count())
    assert sizes == [3000, 6, 6]


def test_late_rows_are_marked(spark, tmp_path):
    folder, state_folder = tmp_path / "in", str(tmp_path / "s")
    os.makedirs(folder)
    stream = processors.mark_late(windows.event_time(live(spark, folder), "eventTime", "5 seconds"), "eventTime")
    for name, given in (("1", [("x", 1, 0), ("x", 2, 100)]), ("2", [("late", 3, 50), ("ok", 4, 96), ("ok", 5, 200)]), ("3", [("late", 6, 194), ("ok", 7, 195)])):
        drop(folder, f"{name}.json", events(given), ("a", "b", "eventTime"))
        windows.run_to_table(stream, folder=state_folder)
    got = windows.read_result(spark, f"{state_folder}/out", stream.schema)
    assert rows(got.select("b", "late")) == [(1, False), (2, False), (3, True), (4, False), (5, False), (6, True), (7, False)]
    assert {r["a"] for r in got.where("late").collect()} == {"late"} and got.where("eventTime IS NULL").count() == 0


def test_series_keep_every_point(spark, tmp_path):
    """Two batches, the second out of order and longer than a part; nothing is lost and nothing old is written again."""
    folder, state_folder = tmp_path / "in", str(tmp_path / "s")
    roll = processors.rolling_series(live(spark, folder, "k string, ts timestamp, v double") if os.makedirs(folder) is None else None, "k", "ts", "v")
    stamp = lambda i: (T0 + dt.timedelta(seconds=i)).isoformat()
    drop(folder, "1.json", [("a", stamp(5000 + i), i) for i in range(2)] + [("b", stamp(i), i) for i in range(3)], ("k", "ts", "v"))
    windows.run_to_table(roll, folder=state_folder)
    assert rows(spark.read.parquet(f"{state_folder}/out").select("k", "total", "part")) == [("b", 3, 0)]  # two points alone give nothing
    drop(folder, "2.json", [("a", stamp(i), 10 + i) for i in range(5000)], ("k", "ts", "v"))
    windows.run_to_table(roll, folder=state_folder)
    got = spark.read.parquet(f"{state_folder}/out").where("k = 'a'").orderBy("part").collect()
    assert [(r["total"], r["part"], len(r["times"])) for r in got] == [(5002, 0, processors.PART), (5002, 1, 5002 - processors.PART)]
    assert sorted(v for r in got for v in r["values"]) == sorted([0.0, 1.0, *(10.0 + i for i in range(5000))])


def test_session_join_gives_the_last_sessions_too(spark, tmp_path):
    given = [(k, s, t) for k, s, t in (("x", "l", 0), ("x", "r", 2), ("x", "l", 4), ("x", "r", 20), ("y", "l", 0), ("y", "r", 3), ("x", "l", 22))]
    ends, sides = [], []
    for side in "lr":
        drop(tmp_path / side, "1.json", events([(k, i, t) for i, (k, s, t) in enumerate(given) if s == side]), ("a", "b", "eventTime"))
        ends.append(windows.Closing(spark, "eventTime", {"a": side}))
        sides.append(windows.event_time(ends[-1].attach(live(spark, tmp_path / side)), "eventTime", "1 second"))
    out = processors.session_join(*sides, [("a", "a")], "eventTime", "eventTime", 3)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and plan.count("TransformWithState") == 1
    got = ends[0].finished(out, beside=ends[1:])
    start = F.timestamp_diff("SECOND", F.lit(T0), "w_start") if hasattr(F, "timestamp_diff") else (F.unix_seconds("w_start") - int(T0.timestamp()))
    assert rows(got.select(start.cast("int"), "l_a", "l_b", "r_b")) == [(0, "x", 0, 1), (0, "x", 2, 1), (20, "x", 6, 3)]  # three seconds apart is apart


def test_a_key_with_many_sessions_has_one_timer(spark):
    """All sessions that are over come out with the first timer that fires, in a handful of calls to the state store."""
    calls = []

    class State:
        def __init__(self):
            self.value = None

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name in ("get", "exists"):
                    return self.value if name == "get" else self.value is not None
                self.value = None if name == "clear" else (self.value or []) + given[0] if name == "appendList" else given[0]
            return call

    class Handle:
        def __init__(self):
            self.timers = set()

        def getListState(self, *_):
            return State()

        getValueState = getListState

        def registerTimer(self, at):
            calls.append("registerTimer")
            self.timers.add(at)

        def deleteTimer(self, at):
            calls.append("deleteTimer")
            self.timers.discard(at)

    class At:
        def __init__(self, now):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: now

    handle, fields = Handle(), T.StructType.fromDDL("l_n int, r_n int")
    join = processors._SessionJoin(fields, 1, 3000)
    join.init(handle)
    # a thousand sessions of two rows a second apart, 10 seconds from one to the next
    given = [{"_left": side == 0, "_t": n * 10_000 + side * 1000, "l_n": n if side == 0 else None, "r_n": n if side else None}
             for n in range(1000) for side in (0, 1)]
    for part in (given[1000:], given[:1000]):
        list(join.handleInputRows(("k",), iter(part), At(0)))
    assert handle.timers == {4}
    out = list(join.handleExpiredTimer(("k",), At(5000), At(4)))
    assert [(r["_first"], r["_end"], r["l_n"], r["r_n"]) for r in out] == [(n * 10_000, n * 10_000 + 4000, n, n) for n in range(500)]
    handle.timers.discard(4)
    assert handle.timers == {5004} and len(calls) < 20
    out = list(join.handleExpiredTimer(("k",), At(9004), At(5004)))
    assert [r["l_n"] for r in out] == list(range(500, 901)) and len(handle.timers - {5004}) == 1


def test_arrivals_meet_in_both_orders(spark, tmp_path):
    for side in "lr":
        os.makedirs(tmp_path / side)
    l, r = (live(spark, tmp_path / side) for side in "lr")
    out = processors.arrival_join(l, r, [("a", "a")], 366 * 86_400)
    state_folder = str(tmp_path / "s")
    steps = [("l", [("x", 1, 0), ("y", 2, 0)]), ("r", [("x", 3, 0)]), ("r", [("y", 4, 0)]), ("l", [("y", 5, 0), ("x", 6, 0), ("z", 7, 0)])]
    for n, (side, given) in enumerate(steps):
        drop(tmp_path / side, f"{n}.json", events(given), ("a", "b", "eventTime"))
        windows.run_to_table(out, folder=state_folder)
    got = spark.read.parquet(f"{state_folder}/out").select("batch", "l_a", "l_b", "r_b")
    assert rows(got.drop("batch")) == [("x", 1, 3), ("x", 6, 3), ("y", 2, 4), ("y", 5, 4)]


def test_bounded_stream_of_several_batches_is_closed(spark, tmp_path):
    for n in range(3):
        drop(tmp_path / "in", f"{n}.json", events([("x", n, 10 * n), ("y", n, 10 * n + 1)]), ("a", "b", "eventTime"))
    for window, want in ((windows.tumbling("eventTime", "5 seconds"), [1, 1] * 3), (windows.session("eventTime", "5 seconds"), [1, 1] * 3)):
        end = windows.Closing(spark, "eventTime")
        stream = windows.event_time(end.attach(live(spark, tmp_path / "in", maxFilesPerTrigger=1)), "eventTime", "20 seconds")
        got = end.finished(windows.window_aggregate(stream, window, ["a"], n=F.count("*")))
        assert [r["n"] for r in got.collect()] == want and got.where("a IS NULL").count() == 0


def test_scoring_follows_the_model(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(folder)
    drop(folder, "1.json", [(1, [2.0])], ("id", "x"))
    stream = live(spark, folder, "id int, x array<double>", maxFilesPerTrigger=1)
    weights = [1.0]
    model = lookup.Refreshed(lambda: spark.createDataFrame([(0.0, "dense", 1, [weights[0]])], models.LINEAR), seconds=-1)
    step = lookup.scored(model, lambda d, m: models.score_linear(d, m, "x"), lambda d, n: d.write.mode("overwrite").parquet(f"{out}/{n}"))
    windows.run_to_table(stream, each=step, folder=str(tmp_path / "s"))
    weights[0] = 10.0
    drop(folder, "2.json", [(2, [2.0])], ("id", "x"))
    windows.run_to_table(stream, each=step, folder=str(tmp_path / "s"))
    assert [spark.read.parquet(f"{out}/{n}").first()["label"] for n in (0, 1)] == [2.0, 20.0]


def test_bad_times_do_not_move_the_watermark(spark, tmp_path):
    drop(tmp_path / "in", "1.json", [("1514764800000",), ("2018-01-01 00:00:05",), ("no time",)], ("t",))
    stream = windows.event_time(live(spark, tmp_path / "in", "t string"), "t", "1 second")
    got = {r["t"] for r in windows.finished(stream).collect()}
    assert got == {T0, T0 + dt.timedelta(seconds=5), None}
