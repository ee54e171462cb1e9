import datetime as dt
import os

from pyspark.sql import functions as F

from flowspark.sources import files, framing, jdbc, sinks


def write(folder, name, body, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(body)
    return path


def test_lines_skip_encoding(spark, tmp_path):
    write(tmp_path, "a.log", "h1\nh2\nx\ny\n", "gbk")
    write(tmp_path, "b.log", "h1\nh2\n中\n", "gbk")
    rows = files.text_lines(spark, str(tmp_path), "GBK", skip=2).collect()
    assert sorted(r["value"] for r in rows) == ["x", "y", "中"]


def test_csv_quotes_and_surplus(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id,t\n1,"a\nb"\n2,"say ""hi"""\n3,x,lost\n')
    assert [tuple(r) for r in files.csv(spark, path).orderBy("id").collect()] == [("1", "a\nb"), ("2", 'say "hi"'), ("3", "x")]
    given = files.csv(spark, write(tmp_path, "b.csv", "1,x\n\n2,y\n"), header=False, names=["id", "t"])
    assert given.columns == ["id", "t"] and given.count() == 2


def test_multi_line_records(spark):
    lines = ["2018 start", " at a", " at b", "2019 next", "2020 last", " at c"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, no int, line string")
    out = framing.assemble(df, ["path"], ["no"], "line", r"^\d{4}")
    assert {r["line"] for r in out.collect()} == {"2018 start at a at b", "2019 next", "2020 last at c"}
    ends = spark.createDataFrame([("f", i, x) for i, x in enumerate(["a", "b;", "c;", "d"])], "path string, no int, line string")
    out = framing.assemble(ends, ["path"], ["no"], "line", ";$", at_start=False)
    assert {r["line"] for r in out.collect()} == {"ab;", "c;", "d"}


def test_json_objects_across_lines(spark, tmp_path):
    path = write(tmp_path, "a.json", '{"a":1,"s":"} {"}{"a":2,\n"b":{"c":"\\"}"}}\n junk {"a":3}\n{"open":')
    rows = [r["value"] for r in framing.json_objects(spark, path).orderBy("record").collect()]
    assert rows == ['{"a":1,"s":"} {"}', '{"a":2,\n"b":{"c":"\\"}"}}', '{"a":3}']


def test_delimiter_spelled_out(spark, tmp_path):
    path = write(tmp_path, "a.txt", "a\tb\tc")
    assert sorted(r["value"] for r in framing.delimited_records(spark, path, "\\t").collect()) == ["a", "b", "c"]


def test_xml_records(spark, tmp_path):
    path = write(tmp_path, "a.xml", "<?xml version='1.0'?><!-- c --><all><r><a>1</a></r><r><a>2</a></r></all>")
    assert sorted(r["a"] for r in framing.xml_records(spark, path, "r").collect()) == [1, 2]


def test_positions(spark, tmp_path):
    store = str(tmp_path / "pos")
    df = spark.range(10)
    assert files.read_position(spark, store, "s") is None
    files.save_position(spark, store, "s", "3", 3)
    files.save_position(spark, store, "s", "6", 3)
    files.save_position(spark, store, "other", "9", 3)
    assert files.read_position(spark, store, "s") == "6"
    assert files.after_position(df, "id", "6").count() == 3
    assert files.after_position(df, "id", None).count() == 10
    assert files.after_position(df, "id", None, "END").count() == 0


def test_directory_watch_sees_new_files_once(spark, tmp_path):
    from flowspark.streaming.windows import read_result, run_to_table

    folder, state = tmp_path / "in", str(tmp_path / "state")
    write(folder / "x1", "a.txt", "one\n")
    live = files.watch(spark, f"{folder}/x*", "text")
    out = run_to_table(live, folder=state)
    write(folder / "x2", "b.txt", "two\n")
    write(folder / "y", "c.txt", "no\n")
    run_to_table(live, folder=state)
    assert sorted(r["value"] for r in read_result(spark, out, live.schema).collect()) == ["one", "two"]


def test_range_predicates_cover_without_gaps():
    got = jdbc.range_predicates("id", 0, 25, 10)
    assert got == ["id > 0 AND id <= 10", "id > 10 AND id <= 20", "id > 20 AND id <= 25"]
    assert jdbc.range_predicates("id", 0, 5) == ["id > 0 AND id <= 5"]
    assert len(jdbc.range_predicates("id", 0, 10**9, 1, max_parts=100)) <= 101
    times = jdbc.range_predicates("ts", dt.datetime(2018, 1, 1), dt.datetime(2018, 1, 1, 0, 1), 30)
    assert len(times) == 2 and "2018-01-01 00:00:30" in times[0]


def test_merge_statement():
    sql = jdbc.merge_statement("t", "s", ["id", "v"], ["id"])
    assert sql == ('MERGE INTO t d USING s s ON d."id" = s."id" WHEN MATCHED THEN UPDATE SET d."v" = s."v" '
                   'WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (s."id", s."v")')


def test_plain_numbers(spark):
    df = spark.sql("SELECT CAST(1.5 AS DECIMAL(10,2)) AS a, CAST(7 AS DECIMAL(20,0)) AS b")
    assert jdbc.plain_numbers(df).dtypes == [("a", "double"), ("b", "bigint")]


def test_range_query_points(spark):
    body = '[{"metric":{"job":"j","inst":"i"},"values":[["1","2.5"],["3","NaN"]]}]'
    df = spark.createDataFrame([(body,)], "v string")
    assert [tuple(r) for r in files.range_query_points(df, "v", ["job", "inst"]).collect()] == [("j", "i", 1.0, "2.5"), ("j", "i", 3.0, "NaN")]


def test_text_formats(spark):
    df = spark.createDataFrame([("a,b", None, dt.datetime(2018, 1, 2, 3, 4, 5))], "x string, y string, t timestamp")
    row = df.select(
        sinks.json_text(df).alias("j"), sinks.delimited_text(df, ",").alias("d"), sinks.key_value_text(df, ";", "=").alias("k"),
        sinks.xml_text(df).alias("x"),
        sinks.syslog_text(F.lit("body"), F.col("t"), F.lit("h"), F.lit("tag"), 4, 2).alias("s")).collect()[0]
    assert row["d"] == "'a,b',,'2018-01-02 03:04:05'"
    assert row["k"] == "x=a,b;t='2018-01-02 03:04:05'"
    assert row["x"] == "<x>a,b</x><t>2018-01-02 03:04:05</t>"
    assert row["s"] == "<34>Jan 02 03:04:05 h [tag] body"
    raw = spark.createDataFrame([("plain",)], "raw string")
    assert raw.select(sinks.json_text(raw)).collect()[0][0] == "plain"


def test_orc_with_declared_struct(spark, tmp_path):
    from pyspark.sql import types as T

    sinks.write_orc(spark.range(3), str(tmp_path / "o"), T._parse_datatype_string("id int, extra string"))
    assert files.orc(spark, str(tmp_path / "o")).dtypes == [("id", "int"), ("extra", "string")]


def test_preview_shows_vectors(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0]), {"a": 1})], ["id", "vec", "m"])
    assert [tuple(r) for r in files.preview(df).collect()] == [("1", "[1.0,2.0]", '{"a":1}')]
