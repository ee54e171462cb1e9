from pyspark.sql import functions as F

from flowspark.operators import rules as R


def one(df):
    return df.collect()[0].asDict(recursive=True)


def test_add_fields(spark):
    df = spark.createDataFrame([("zhang", 2, None)], "a string, b int, e string")
    row = one(df.transform(R.add_fields({
        "x": "hello,%{a}", "y": "hello,%{e}", "s%{a}": "v", "%{a}": "never", "gone": "%{missing}", "whole": "%{b}", "": "z"})))
    assert row["x"] == "hello,zhang" and row["y"] == "hello," and row["sa"] == "v" and row["whole"] == "2"
    assert "gone" not in row and row["a"] == "zhang"


def test_tags(spark):
    df = spark.createDataFrame([(1, 2)], "k int, j int").transform(R.add_tags(["pre%{k}suf", "plain", "%{k}", "a%{zz}"]))
    assert df.columns == ["k", "j", "preksuf"]
    assert df.transform(R.remove_tags(["pre%{k}suf"])).columns == ["k", "j"]


def test_mapping_and_removal_of_nested_fields(spark):
    df = spark.createDataFrame([(("Mon", 3), 1)], "alarm struct<day:string,hour:int>, id int")
    moved = df.transform(R.mapping({"alarm.day": "day", "alarm.hour": "hour", "id": "key"}))
    assert one(moved) == {"key": 1, "day": "Mon", "hour": 3}          # the emptied parent is gone
    assert one(df.transform(R.remove_fields(["alarm.day"]))) == {"alarm": {"hour": 3}, "id": 1}
    assert one(df.transform(R.mapping({"id": "alarm.id"})))["alarm"] == {"day": "Mon", "hour": 3, "id": 1}
    assert one(df.select("id").transform(R.add_fields({"p.q.r": "%{id}"})))["p"] == {"q": {"r": "1"}}


def test_merger_replace_cut(spark):
    df = spark.createDataFrame([("abc-13-2", None, "abcdef")], "t string, n string, c string")
    assert one(df.transform(R.merger(["t", "n", "zz"], "m", "/")))["m"] == "abc-13-2//"
    assert one(df.transform(R.replace("t", "13", "noon-15")))["t"] == "abc-noon-15-2"
    assert one(df.transform(R.replace("t", "\\d+", "%{c}")))["t"] == "abc-abcdef-abcdef"
    cuts = {(1, 3): "bcd", (4, 9): "ef", (9, 2): "abcdef", (-1, 2): "abcd", (-1, 9): "abcdef"}
    for (start, limit), want in cuts.items():
        assert one(df.transform(R.field_cut("c", start, limit)))["c"] == want


def test_arithmetic(spark):
    df = spark.createDataFrame([("2", "", "x", 1.5, 3)], "a string, b string, c string, d double, e int")
    row = one(R.apply_rules(df, [R.field_add(c, 13) for c in "abcde"]))
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == ("15", "13", "x", 14.5, 16)
    row = one(R.apply_rules(df, [R.field_multiply(c, 2) for c in "abcd"]))
    assert (row["a"], row["b"], row["c"], row["d"]) == ("4", "0", "x", 3.0)


def test_extends_and_list_to_map(spark):
    df = spark.createDataFrame([(1, [("x", 9)]), (2, []), (3, None), (4, [("y", 8), ("z", 7)])], "id int, l array<struct<n:string,id:int>>")
    rows = sorted((r["id"], r["n"]) for r in df.transform(R.extends("l")).collect())
    assert rows == [(1, "x"), (3, None), (4, "y"), (4, "z")]          # own id wins, empty list drops the row
    plain = spark.createDataFrame([(1, ["a", "b"])], "id int, l array<string>")
    assert [r["l"] for r in plain.transform(R.extends("l")).collect()] == ["a", "b"]
    assert one(plain.transform(R.list_to_map("l", ["p", "q", "r"])))["l"] == {"p": "a", "q": "b"}


def test_switch_paths(spark):
    paths = ["/data/app4/x.log", "/data/app2/a.log", "/data/app2/b.log", "/other", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rule = R.switch("path", [(".*app4.*", [R.add_fields({"sys": "APP4"})]), (".*app2.*", [R.add_fields({"sys": "APP2"})])],
                    [R.remove_fields(["none"])], "match")
    got = [r["sys"] for r in df.transform(rule).collect()]
    assert sorted(x for x in got if x) == ["APP2", "APP2", "APP4"] and len(got) == 5


def test_switch_runs_one_case_with_one_scan_and_can_drop_rows(spark):
    df = spark.createDataFrame([("a", 1), ("ab", 2), ("c", 3), (None, 4)], "k string, v int")
    rule = R.switch("k", [("ab", [R.add_fields({"n": "second"})]), ("a", [R.add_fields({"n": "first"}), R.remove_fields(["v"])])],
                    [R.add_fields({"n": "rest"})], "prefix")
    out = df.transform(rule)
    assert {(r["k"], r["v"], r["n"]) for r in out.collect()} == {("a", None, "first"), ("ab", 2, "second"), ("c", 3, "rest"), (None, 4, "rest")}
    dropping = R.switch("k", [("a", [R.drop_rows()])], [R.ignore()])
    assert {r["k"] for r in df.transform(dropping).collect()} == {"ab", "c", None}


def test_script_function_marks_failing_rows(spark):
    def work(frame):
        return frame.assign(q=[10 / int(x) for x in frame["v"]])

    df = spark.createDataFrame([(1, 5), (2, 0)], "id int, v int").coalesce(1)
    rows = {r["id"]: r for r in df.transform(R.script(function=work, schema="id int, v int, q double, _error string")).collect()}
    assert rows[1]["q"] == 2 and rows[1]["_error"] is None and rows[2]["_error"]


def test_capture_first_and_every(spark):
    df = spark.createDataFrame([("ip=1.2.3.4 user=bob",)], "t string")
    pats = [r"ip=(?<ip>\S+)", r"user=(?<user>\w+)"]
    first, every = one(df.transform(R.capture("t", pats))), one(df.transform(R.capture("t", pats, every=True)))
    assert first["ip"] == "1.2.3.4" and first["user"] is None
    assert every["ip"] == "1.2.3.4" and every["user"] == "bob"


def test_xpath_and_xml_text(spark):
    df = spark.createDataFrame([("<r><k> 10 </k><i>120</i><i>13</i></r>",)], "x string")
    row = one(df.transform(R.xpath_fields("x", {"k": ("/r/k/text()", False), "i": ("/r/i/text()", True)})).transform(R.xml_to_text("x", ["k", "i"], "t")))
    assert row["k"] == "10" and row["i"] == ["120", "13"] and row["t"] == "10\n120\n13"


def test_stable_id(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert one(df.transform(R.stable_id(["x", "y", "z"])))["_id"] == hashlib.md5(b"a-3").hexdigest().upper()
    assert one(df.transform(R.stable_id(["z"])))["_id"] == "3"
    assert one(df.transform(R.stable_id([])))["_id"] is None


def test_mark_error_and_order(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    out = R.apply_rules(df, [R.mark_error("odd", F.col("v") == 1), R.add_fields({"w": "%{v}!"})])
    assert {(r["v"], r["_error"], r["w"]) for r in out.collect()} == {(1, "odd", "1!"), (2, None, "2!")}
