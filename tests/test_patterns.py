"""Pattern mining against planted families and against all pairs of templates; matching against every pattern."""

import random

import pytest

from flowspark.operators import patterns as P


def test_lcs_and_templates():
    assert P.lcs(list("abcd"), list("xbyd")) == [(1, 1), (3, 3)] and P.lcs([], ["a"]) == []
    a, b = "10.1 connect to 7".split(" "), "10.2 connect to 9".split(" ")
    assert P.merge_templates(a, b, 0.5) == [P.GAP, "connect", "to", P.GAP]
    assert P.merge_templates(a, b, 0.7) is None


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_is_longest_and_common():
    chance = random.Random(1)
    for _ in range(500):
        a, b = ([chance.choice("abcde") for _ in range(chance.randrange(30))] for _ in range(2))
        pairs = P.lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(a, b)


def families(count, lines, seed=3):
    """Lines of `count` families: six words of its own, two that vary, a number."""
    chance = random.Random(seed)
    own = [[f"f{k}w{i}" for i in range(6)] for k in range(count)]
    out = []
    for at in range(lines):
        k = at % count
        w = list(own[k])
        w.insert(2, f"v{chance.randrange(10 ** 9):x}x")
        w.insert(6, chance.choice(["ann", "bob", "cid", "dan", "eve"]))
        out.append((k, " ".join(w) + f" {chance.randrange(9999)}"))
    return own, out


@pytest.mark.parametrize("count, lines, leaders", [(500, 2000, P.LEADERS), (500, 20_000, P.LEADERS), (40, 400, 64), (40, 400, 10 ** 6)])
def test_planted_families(spark, count, lines, leaders):
    own, rows = families(count, lines)
    df = spark.createDataFrame(rows, "k int, line string").repartition(7)
    found = P.mined(df, 0.7, leaders).collect()
    assert len(found) == count and {r["n"] for r in found} == {lines // count}
    for r in found:
        k = int(next(t for t in r["tokens"] if t.startswith("f")).split("w")[0][1:])
        assert set(own[k]) <= set(r["tokens"]) and not any(t.startswith("v") for t in r["tokens"])


@pytest.mark.parametrize("ratio", [0.6, 0.8])
def test_fixpoint_of_random_lines(spark, ratio):
    """No two templates that are left can merge, no line is lost, and each line holds a template that covers enough of it."""
    chance = random.Random(8)
    lines = [" ".join(chance.choice(["get", "put", "disk", "node", "user", "ok", "fail"]) + chance.choice(["", "", "", "A", "B"])
                      for _ in range(chance.randint(1, 8))) + chance.choice(["", " 17", " 4 x"]) for _ in range(120)]
    results = []
    for leaders in (1, 10 ** 6):
        found = P.mined(spark.createDataFrame([(x,) for x in lines], "line string"), ratio, leaders).collect()
        assert sum(r["n"] for r in found) == len(lines)
        for i, a in enumerate(found):
            for b in found[:i]:
                assert P.merged(list(a["tokens"]), list(b["tokens"]), P.need(ratio, max(a["size"], b["size"]))) is None
        for line in set(lines):
            tokens = [P.GAP if t.isdigit() else t for t in P._TOKEN.findall(line)]

            def holds(r):
                rest, plain = iter(tokens), [t for t in r["tokens"] if t != P.SKIP]
                return len(plain) >= P.need(ratio, len(tokens)) and all(t in rest for t in plain)

            assert any(map(holds, found))
        results.append(len(found))
    assert max(results) < len(set(lines))


def test_one_family_with_most_lines(spark):
    """Every token of a line is shared by all others but one; parts of a family come together again."""
    df = spark.range(30_000).selectExpr("concat('job j', id, 'x done by worker ', id % 7, ' on host') AS line").repartition(16)
    out = P.mine_patterns(df.union(spark.createDataFrame([("disk is full",), ("",), (None,)], "line string")), "line", 0.7)
    rows = {r["pattern_key"]: r for r in out.collect()}
    assert set(rows) == {"job*done by worker*on host", "disk is full"}
    best = rows["job*done by worker*on host"]
    assert best["pattern_size"] == 30_000 and best["cluster_total"] == 30_001 and abs(best["pattern_scale"] - 30_000 / 30_001) < 1e-9


def test_nothing_to_mine(spark):
    assert P.mine_patterns(spark.createDataFrame([(None,), (" ",)], "line string"), "line").count() == 0


@pytest.mark.parametrize("model_bytes", [P.MODEL_BYTES, 1500])
def test_matching_in_one_block_and_in_many(spark, model_bytes):
    chance = random.Random(6)
    words = ["hot", "a", "b", "c", "d", "e", "Ä"]
    model = [(P.JOIN.join(["hot", *(chance.choice([*words, P.GAP]) for _ in range(chance.randint(0, 5)))]), f"k{i}") for i in range(80)]
    model += [(P.GAP, "nothing"), ("", "empty")]
    lines = [" ".join(["hot", *(chance.choice(words) for _ in range(chance.randint(0, 9)))]) for _ in range(200)] + [None, "", "cold a"]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(lines)], "id int, line string, pattern_key string")
    got = {r["id"]: (r["isMatch"], r["patternKey"]) for r in P.match_patterns(
        df, "line", spark.createDataFrame(model, "template string, pattern_key string"), model_bytes).collect()}

    def told(line):
        tokens, best = P._TOKEN.findall(line or ""), None
        for template, key in model:
            texts, rest = P._texts(template), iter(tokens)
            if texts and all(t in rest for t in texts):
                best = min(best or (0, ""), (-len(texts), key)) if best else (-len(texts), key)
        return (best is not None, best and best[1])

    assert got == {i: told(x) for i, x in enumerate(lines)}


def test_matching_moves_no_lines(spark):
    """A token in every line puts no rows together: the plan has no exchange of lines."""
    df = spark.range(1000).selectExpr("concat('hot ', id) AS line")
    model = spark.createDataFrame([(P.JOIN.join(["hot", " ", str(i)]), f"k{i}") for i in range(300)], "template string, pattern_key string")
    out = P.match_patterns(df, "line", model)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.where("isMatch").count() == 1000 - 1000 + 300
