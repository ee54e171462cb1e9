from pyspark.sql import functions as F

from flowspark.functions import parse


def run(spark, lines, parser):
    return parse.parse(spark.createDataFrame([(x,) for x in lines], "line string"), "line", parser).collect()


def test_delimited(spark):
    rows = run(spark, ['a,"b,c",-,d,e', "x", "a,'q',, ,-", '"un,a,b,c'], parse.delimited(",", ["p", "q", "r", "s"]))
    assert tuple(rows[0])[:4] == ("a", "b,c", None, "d,e")       # surplus goes to the last field
    assert rows[1]["_error"] and rows[1]["_raw"] == "x"          # too few
    assert tuple(rows[2])[:4] == ("a", "q", None, ",-")
    assert rows[3]["_error"]                                     # quote never closed


def test_delimited_multi_character_and_plain(spark):
    assert tuple(run(spark, ["a||b||c||d"], parse.delimited("||", ["x", "y"]))[0])[:2] == ("a", "b||c||d")
    assert tuple(run(spark, ["a|b|c"], parse.delimited("|", ["x", "y"], quotes=False))[0])[:2] == ("a", "b|c")


def test_key_value(spark):
    line = 'start_time="2018-01-01 00:00" duration=5 policy id=1 y=\'N/A\' z=null e= w="a b" tail'
    got = run(spark, [line], parse.key_value(" ", "="))[0]["fields"]
    assert got == {"start_time": "2018-01-01 00:00", "duration": "5", "policy_id": "1", "w": '"a b" tail'}
    assert run(spark, ["a=1 b=2 a=3"], parse.key_value(" ", "="))[0]["fields"] == {"a": "3", "b": "2"}
    assert tuple(run(spark, ["a:1;b:'x;y'"], parse.key_value(";", ":", ["a", "b", "c"]))[0])[:3] == ("1", "x;y", None)


def test_cef(spark):
    line = r"CEF:0|sec|thr\|eat|1.0|100|worm stopped|10|src=10.0.0.1 dst=2.1.2.2 msg=a b c\=d spt=1232"
    row, bad = run(spark, [line, "CEF:0|a|b"], parse.cef())
    assert (row["version"], row["device_product"], row["name"], row["severity"]) == ("0", r"thr\|eat", "worm stopped", "10")
    assert row["extension"] == {"src": "10.0.0.1", "dst": "2.1.2.2", "msg": r"a b c\=d", "spt": "1232"}
    assert bad["_error"]


def test_grok_apache_line(spark):
    line = '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326'
    row, bad = run(spark, [line, "nothing"], parse.regex("%{COMMONAPACHELOG}"))
    assert (row["clientip"], row["auth"], row["verb"], row["response"], row["bytes"]) == ("127.0.0.1", "frank", "GET", "200", "2326")
    assert row["rawrequest"] is None and bad["_error"]


def test_grok_application_line_and_dotted_names(spark):
    line = "2018-07-01 12:00:01 [main] INFO app.Server - started in 5 ms"
    shape = r"%{DATA:at.date} %{DATA:at.time} \[%{DATA:thread}\] %{WORD:level} %{NOTSPACE:type} - %{GREEDYDATA:message}"
    row = run(spark, [line], parse.regex(shape))[0]
    assert row["at"]["date"] == "2018-07-01" and row["at"]["time"] == "12:00:01"
    assert (row["thread"], row["level"], row["message"]) == ("main", "INFO", "started in 5 ms")


def test_json(spark):
    rows = run(spark, ['﻿ {"a":1,"b":{"c":"x"}}', "[1,2]", "{bad", "text"], parse.json("a int, b struct<c:string>"))
    assert rows[0]["a"] == 1 and rows[0]["b"]["c"] == "x" and rows[0]["_error"] is None
    assert rows[1]["raw"] == ["1", "2"] and rows[1]["_error"] is None
    assert rows[2]["_error"] and rows[3]["_error"]


def test_json_schema_over_all_rows(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":2,"b":{"c":1.5,"d":[1]}}',), ("oops",)], "j string")
    schema = parse.json_schema_of(df, "j")
    assert schema.simpleString() == "struct<a:bigint,b:struct<c:double,d:array<bigint>>>"


def test_xml(spark):
    rows = run(spark, ["<r>\u0001<a>1 & 2 < 3</a><b>x</b><b>y</b></r>", "<r><a>"], parse.xml("a string, b array<string>"))
    assert (rows[0]["a"], rows[0]["b"]) == ("1 & 2 < 3", ["x", "y"])
    assert rows[1]["_error"]


def test_select_and_chain(spark):
    one, two = parse.regex("^a=%{INT:a}$"), parse.regex("^b=%{INT:b} c=%{WORD:c}$")
    rows = run(spark, ["a=1", "b=2 c=x", "?"], parse.select([one, two]))
    assert [(r["a"], r["b"], r["c"], r["_error"] is None) for r in rows] == [("1", None, None, True), (None, "2", "x", True), (None, None, None, False)]
    both = parse.chain([parse.regex("k=%{NOTSPACE:k}"), parse.regex("k=%{WORD:k} z=%{INT:z}")])
    assert [(r["k"], r["z"]) for r in run(spark, ["k=ab z=3"], both)] == [("ab", "3")]


def test_good_and_bad_rows_are_kept(spark):
    df = parse.parse(spark.createDataFrame([("a=1",), ("x",)], "line string"), "line", parse.regex("^a=%{INT:a}$"), keep_raw=False)
    good, bad = parse.split_good_bad(df)
    assert [tuple(r) for r in good.collect()] == [("1", None)] and bad.collect()[0]["_raw"] == "x"


def test_reparse_collisions_and_lone_raw(spark):
    df = spark.createDataFrame([("u", '{"name":"v","n":1}')], "name string, body string")
    row = df.transform(parse.reparse("body", parse.json("name string, n int"))).collect()[0].asDict()
    assert row["name"] == "u" and row["body_name"] == "v" and row["n"] == 1 and "body" not in row
    again = df.transform(parse.reparse("body", parse.raw())).collect()[0]
    assert again["body"].startswith("{")


def test_flatten_and_properties(spark):
    df = spark.createDataFrame([((1, "x"), [("p", 1), ("q", 2)])], "a struct<n:int,s:string>, l array<struct<k:string,v:int>>")
    row = parse.flatten(df).collect()[0].asDict()
    assert row["a.n"] == 1 and row["a"] == '{"n":1,"s":"x"}' and row["l.k"] == "p,q"
    props = {r["key"]: (r["type"], r["sample"]) for r in parse.properties(df.select("a")).collect()}
    assert props == {"a.n": ("int", "1"), "a.s": ("string", "x")}


def test_captures_handle_optional_groups(spark):
    df = spark.createDataFrame([("ab",), ("a",), ("zz",)], "t string")
    got = [r[0] for r in df.select(parse.captures(F.col("t"), "(a)(b)?", [1, 2])).collect()]
    assert got == [["a", "b"], ["a", ""], None]
