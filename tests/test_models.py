import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import hmm, models, textmining, vectors
from flowspark.operators.dbscan import dbscan
from flowspark.operators.graph import components


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 12)] + [(20, i) for i in range(21, 60)] + [(i, i + 1) for i in range(100, 130)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert [got[x] for x in (1, 4, 11, 12, 59, 130)] == [1, 1, 10, 12, 20, 100]
    assert len(got) == 4 + 2 + 1 + 40 + 31


def brute_dbscan(points, ids, eps, need, inclusive=True, count_self=True):
    seen = {}
    for i in sorted(range(len(points)), key=lambda i: ids[i]):
        seen.setdefault(points[i], ids[i])
    xs, first = np.array(list(seen)), np.array(list(seen.values()))
    d = ((xs[:, None] - xs[None]) ** 2).sum(-1)
    near = d <= eps * eps if inclusive else d < eps * eps
    if not count_self:
        near &= ~np.eye(len(xs), dtype=bool)
    core, label, n = near.sum(1) >= need, np.zeros(len(xs), int), 0
    for i in np.argsort(first):
        if core[i] and not label[i]:
            n += 1
            todo, label[i] = [i], n
            while todo:
                for k in np.flatnonzero(near[todo.pop()]):
                    if core[k] and not label[k]:
                        label[k] = n
                        todo.append(k)
    for i in np.flatnonzero(~core):
        options = [label[k] for k in np.flatnonzero(near[i]) if core[k]]
        label[i] = min(options) if options else 0
    by_point = dict(zip(map(tuple, xs), label))
    return {i: int(by_point[p]) for i, p in zip(ids, points) if by_point[p]}


@pytest.mark.parametrize("dims,inclusive,count_self", [(2, True, True), (3, False, False)])
def test_dbscan_equals_brute_force(spark, dims, inclusive, count_self):
    rng = np.random.default_rng(dims)
    data = np.vstack([rng.normal(c, 0.3, (70, dims)) for c in (0, 1.2, 3)] + [rng.uniform(-2, 5, (40, dims))]).round(2)
    points = [tuple(map(float, p)) for p in np.vstack([data, data[:20]])]
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], ["id", *names])
    got = {r["id"]: r["label"] for r in dbscan(df, names, 0.4, 5, "id", inclusive, count_self).collect()}
    assert got == brute_dbscan(points, list(range(len(points))), 0.4, 5, inclusive, count_self)


def test_dbscan_with_one_heavy_cell(spark):
    """Most points share one cell: they are one cluster without being compared."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") / 1e6).otherwise(F.col("id") * 1.0).alias("x"))
    got = dbscan(df, ["x"], 0.5, 4, "id")
    assert got.select("label").distinct().count() == 1 and got.count() >= 4500


def test_svm_vote_over_pairs(spark):
    """All sign patterns of three classes against the walk stated in words: start label, its first pair, hand over."""
    heads = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "a"), ("b", "b"), ("c", "c")]
    patterns = [[bool(k >> i & 1) for i in range(6)] for k in range(64)]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(patterns)], "k int, hits array<boolean>")
    got = {r["k"]: r["label"] for r in df.select("k", models.vote(F.col("hits"), heads).alias("label")).collect()}
    for k, (ab, _, bc, a, b, c) in enumerate(patterns):
        label = "a" if a else "b" if b else "c" if c else "a"
        if label == "a" and not ab:
            label = "b"
        if label == "b" and not bc:
            label = "c"
        assert got[k] == label


def test_svm_separates_three_classes(spark):
    rng = np.random.default_rng(3)
    centres = {"a": (0, 0), "b": (6, 0), "c": (0, 6)}
    rows = [(k, [float(v) for v in rng.normal(c, 0.5)]) for k, c in centres.items() for _ in range(40)]
    df = spark.createDataFrame(rows, "kind string, x array<double>").coalesce(1)
    model = models.train_svm(df, "x", "kind", max_iter=8)
    assert model.count() == 6
    out = models.score_svm(df, model, "x")
    assert out.where("kind = label").count() >= 110
    two = models.train_svm(df.where("kind <> 'c'"), "x", "kind", max_iter=8)
    assert two.count() == 1 and two.first()["accuracy"] > 0.95


def test_linear_model_and_residuals(spark):
    df = spark.createDataFrame([([float(i), float(i % 3)], 2.0 + 3 * i - (i % 3)) for i in range(50)], "x array<double>, y double")
    model = models.train_linear(df, "x", "y", reg=0.0)
    row = model.first()
    assert abs(row["intercept"] - 2) < 1e-6 and np.allclose(row["data"], [3, -1])
    assert models.squared_residuals(df, model, "x", "y").first()["ssr"] < 1e-9


def test_pca_keeps_the_largest_components(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([([float(v) for v in r],) for r in data], "x array<double>")
    row = models.train_pca(df, "x", share=0.9).first()
    values = np.sort(np.linalg.eigvalsh(np.cov(data.T)))[::-1]
    assert row["k"] == 1 and np.allclose(row["eigenvalues"][0], values[0])
    assert abs(row["eigenvectors"][0]) > 0.99
    flat = models.project(df, models.train_pca(df, "x", k=2), "x", "p").select("p").collect()
    assert np.allclose(np.var([r["p"][0] for r in flat], ddof=1), values[0])


def test_row_centred_pca_matches_pair_products(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(12, 4))
    centred = data - data.mean(axis=1, keepdims=True)
    want = np.sort(np.linalg.eigvalsh(centred @ centred.T))[::-1][:2]
    df = spark.createDataFrame([([float(v) for v in r],) for r in data], "x array<double>")
    assert np.allclose(models.train_row_centred_pca(df, "x", 2).first()["eigenvalues"], want)


def test_lda_direction(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(v) for v in rng.normal((0, c), (4, 0.3))]) for k, c in ((0, 0), (1, 3)) for _ in range(80)]
    df = spark.createDataFrame(rows, "y int, x array<double>")
    vector = models.train_lda(df, "x", "y", 1).first()["eigenvectors"]
    assert abs(vector[1]) > 0.95


def test_polynomial_terms(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([([2.0, 3.0],)], "x array<double>")
    got = models.polynomial(df, "x", 2).select(vector_to_array("poly").alias("p")).first()["p"]
    assert sorted(got) == [2, 3, 4, 6, 9]


def test_model_table_round_trip(spark, tmp_path):
    path, calls = str(tmp_path / "m"), []
    df = spark.createDataFrame([([float(i)], 2.0 * i) for i in range(10)], "x array<double>, y double")

    def fit(d):
        calls.append(1)
        return models.train_linear(d, "x", "y", reg=0.0)

    for _ in range(2):
        out = models.fit_or_load(df, path, "m1", fit, lambda d, m: models.score_linear(d, m, "x"))
    assert calls == [1] and abs(out.where("y = 18").first()["label"] - 18) < 1e-6
    assert models.load_model(spark, path, "other") is None
    models.save_model(fit(df), path, "m2")
    assert models.load_model(spark, path).count() == 2


# -- hidden Markov models --------------------------------------------------------------

def simulate(n, seed):
    rng = np.random.default_rng(seed)
    model = hmm.Hmm(np.array([0.3, 0.2, 0.5]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.3, 0.6]]),
                    np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]))
    states, symbols = [], []
    s = rng.choice(3, p=model.initial)
    for _ in range(n):
        states.append(int(s))
        symbols.append(int(rng.choice(3, p=model.emission[s])))
        s = rng.choice(3, p=model.transition[s])
    return model, states, symbols


def one_pass_viterbi(model, symbols):
    a, b = np.log(model.transition), np.log(model.emission)
    score, back = np.log(model.initial) + b[:, symbols[0]], []
    for o in symbols[1:]:
        total = score[:, None] + a
        back.append(total.argmax(0))
        score = total.max(0) + b[:, o]
    path = [int(score.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return path[::-1]


def test_viterbi_in_blocks_equals_one_pass(spark):
    model, _, symbols = simulate(257, 1)
    df = spark.createDataFrame([("s", i, o) for i, o in enumerate(symbols)], "k string, i int, o int")
    packed = hmm.blocks(df, ["k"], "i", "o", size=20)
    assert packed.count() == 13
    got = [s for r in hmm.viterbi(packed, ["k"], model).orderBy("block").collect() for s in r["states"]]
    assert got == one_pass_viterbi(model, symbols)


def test_baum_welch_in_blocks_equals_whole_sequence_and_learns(spark):
    truth, _, _ = simulate(10, 0)
    rows = [(k, i, o) for k in range(6) for i, o in enumerate(simulate(400, 10 + k)[2])]
    df = spark.createDataFrame(rows, "k int, i int, o int")
    start = hmm.Hmm(np.array([0.4, 0.3, 0.3]), np.array([[0.6, 0.2, 0.2], [0.3, 0.5, 0.2], [0.2, 0.3, 0.5]]),
                    np.array([[0.7, 0.2, 0.1], [0.2, 0.6, 0.2], [0.1, 0.2, 0.7]]))
    cut = hmm.baum_welch(hmm.blocks(df, ["k"], "i", "o", size=37), ["k"], start, 2)
    whole = hmm.baum_welch(hmm.blocks(df, ["k"], "i", "o", size=10_000), ["k"], start, 2)
    assert np.allclose(cut.transition, whole.transition, atol=1e-8) and np.allclose(cut.emission, whole.emission, atol=1e-8)
    assert np.allclose(cut.initial, whole.initial, atol=1e-8)
    more = hmm.baum_welch(hmm.blocks(df, ["k"], "i", "o", size=10_000), ["k"], start, 12)
    assert np.abs(more.emission - truth.emission).max() < 0.12 and np.abs(more.transition - truth.transition).max() < 0.12


def test_supervised_frequencies(spark):
    rows, truth = [], None
    for k in range(30):
        truth, states, symbols = simulate(120, 100 + k)
        rows += [(k, i, s, o) for i, (s, o) in enumerate(zip(states, symbols))]
    df = spark.createDataFrame(rows, "k int, i int, s int, o int")
    model = hmm.to_model(hmm.frequencies(df, ["k"], "i", "s", "o"), ["0", "1", "2"], ["0", "1", "2"])
    assert np.abs(model.transition - truth.transition).max() < 0.1 and np.abs(model.emission - truth.emission).max() < 0.1


# -- text --------------------------------------------------------------------------------

def py_simhash(tokens, bits):
    votes = [0] * bits
    for t in tokens:
        x, mask = ord(t[0]) << 7, (1 << bits) - 1
        for c in t:
            x = ((x * 1000003) ^ ord(c)) & mask
        x ^= len(t)
        for i in range(bits):
            votes[i] += 1 if x >> i & 1 else -1
    return [1.0 if v >= 0 else 0.0 for v in reversed(votes)]


def test_simhash(spark):
    tokens = [["images", "a.png", "x"], ["Default.aspx"], ["a", "a", "b"]]
    df = spark.createDataFrame(list(enumerate(tokens)), "id int, t array<string>")
    for bits in (8, 32, 63, 64):
        got = {r["id"]: r["simhash"] for r in textmining.simhash(df, "id", "t", bits).collect()}
        assert got == {i: py_simhash(t, bits) for i, t in enumerate(tokens)}


def test_minima_are_those_of_the_seeded_hashes(spark, monkeypatch):
    """Repeated ids share a signature, missing ids and tokens count, bags cross the borders of what is hashed at once."""
    df = spark.sql("""SELECT if(id = 3, null, id % 40) AS id, if(id % 9 = 1, null, transform(sequence(0, int(id * 37 % 400)),
        x -> if(x % 50 = 7, null, string(x * 31 + id * 7)))) AS t FROM range(50) UNION ALL SELECT 100, array() UNION ALL SELECT 5, array(null, 'a')""")
    terms = df.select("id", F.explode("t").alias("t")).select("id", F.xxhash64("t").alias("t"))
    want = terms.groupBy("id").agg(*[F.min(F.xxhash64("t", F.lit(i))).alias(f"h{i}") for i in range(128)])
    got = textmining._minima(df, "id", "t")
    assert got.count() == want.count() > 30 and got.exceptAll(want).count() == 0
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # no 128 buffers per token
    tokens, starts = np.arange(-900, 1100), np.array([0, 3, 500, 512, 1999])
    whole = textmining._token_minima(tokens, starts)
    monkeypatch.setattr(textmining, "_AT_ONCE", 256)
    assert (textmining._token_minima(tokens, starts) == whole).all()


def test_tf_idf_of_odd_rows_without_a_shuffle_of_terms(spark):
    """Repeated and missing ids, missing tokens; the token table broadcast whole, in part and not at all."""
    odd = spark.sql("""SELECT if(id % 20 = 3, null, id % 45) AS id, if(id % 9 = 1, null, transform(sequence(0, int(id * 37 % 60)),
        x -> if(x % 50 = 7, null, string(x * x % (id + 5))))) AS t FROM range(60) UNION ALL SELECT 100, array() UNION ALL SELECT 5, array(null, 'only')""")
    for df in (odd, odd.where("id > 15 AND id < 45 AND id % 20 > 3").dropDuplicates(["id"])):
        df = df.localCheckpoint()
        tf = df.select("id", F.explode("t").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
        idf = tf.groupBy("token").agg(F.log((F.lit(float(df.select("id").distinct().count())) + 1) / (F.count(F.lit(1)) + 1)).alias("idf"))
        want = tf.join(idf, "token").select("id", "token", "tf", F.round(F.col("tf") * F.col("idf"), 12).alias("w"))
        for most in (1 << 20, 400, 1):
            made = vectors.tf_idf_rows(df, "id", "t", max_bytes=most)
            got = made.select("id", "token", "tf", F.round("tf_idf", 12).alias("w"))
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 100
    made = vectors.tf_idf_rows(df, "id", "t")
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()  # not terms written before
    packed = made.groupBy("id").agg(F.collect_list("token").alias("t"), F.collect_list("tf_idf").alias("w"))
    votes = textmining.simhash(packed, "id", "t", 32, "w")
    assert votes.exceptAll(textmining.simhash(made, "id", "token", 32, "tf_idf")).count() == 0 and votes.count() > 10


def test_signatures_and_clusters(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(1, words), (2, words), (3, words[:58] + ["x", "y"]), (4, [f"v{i}" for i in range(60)])]
    df = spark.createDataFrame(docs, "id int, t array<string>")
    sig = {r["id"]: r for r in textmining.minhash_signature(df, "id", "t").collect()}

    def dist(a, b):
        return bin((sig[a]["sig_hi"] ^ sig[b]["sig_hi"]) & (2**64 - 1)).count("1") + bin((sig[a]["sig_lo"] ^ sig[b]["sig_lo"]) & (2**64 - 1)).count("1")

    assert dist(1, 2) == 0 and dist(1, 3) < 16 and dist(1, 4) > 40
    got = {r["id"]: r["cluster"] for r in textmining.similar_clusters(df, "id", "t").collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4


@pytest.mark.parametrize("pairs, crowd", [(300, 64), (4000, 64), (300, 2)])
def test_planted_pairs_are_joined_at_any_size(spark, pairs, crowd):
    """Nearly equal rows among others: as many pairs, as many joined."""
    rng = np.random.default_rng(pairs)
    rows = []
    for k in range(pairs):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 100)]
        rows += [(2 * k, words), (2 * k + 1, words[:99] + ["changed"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = {r["id"]: r["cluster"] for r in textmining.similar_clusters(df, "id", "t", 0.9, crowd=crowd).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(pairs)) >= 0.999 * pairs
    assert len(set(got.values())) >= 0.99 * pairs


@pytest.mark.parametrize("crowd", [64, 2])
def test_pairs_at_the_threshold_are_joined(spark, crowd):
    """Pairs with a Jaccard similarity of just 0.7: 70 of 100 words are common."""
    rng = np.random.default_rng(crowd)
    rows = []
    for k in range(1000):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 100)]
        rows += [(2 * k, words[:85]), (2 * k + 1, words[:70] + words[85:])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = {r["id"]: r["cluster"] for r in textmining.similar_clusters(df, "id", "t", 0.7, crowd=crowd).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(1000)) >= 998
    assert len(set(got.values())) >= 990


@pytest.mark.parametrize("crowd", [64, 1])
def test_crowded_buckets_are_settled_whole(spark, crowd):
    """Every pair that shares a bucket of far more than `crowd` rows is settled, as brute force does it."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        words = [f"b{k}" for k in range(80)]
        at = int(rng.integers(0, 60))
        words[at:at + 20] = [f"n{i // 2}_{k}" for k in range(14)] + [f"m{i}_{k}" for k in range(6)]
        rows.append((i, words))
    df = spark.createDataFrame(rows, "id int, t array<string>")
    signed = textmining.banded_signatures(df, "id", "t", 64).collect()
    low, full = {r["id"]: r["id"] for r in signed}, {}
    for r in signed:
        for bucket in r["buckets"]:
            full.setdefault(bucket, []).append(r)

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for own in full.values():
        for x, a in enumerate(own):
            for b in own[:x]:
                far = sum(bin((a[c] ^ b[c]) & (2**64 - 1)).count("1") for c in ("sig_hi", "sig_lo"))
                if far <= (1 - 0.95 + 0.05) * 128:
                    p, q = find(a["id"]), find(b["id"])
                    low[max(p, q)] = min(p, q)
    assert max(map(len, full.values())) > 64
    got = {r["id"]: r["cluster"] for r in textmining.similar_clusters(df, "id", "t", 0.95, bands=64, crowd=crowd).collect()}
    assert got == {i: find(i) for i in low}
    assert 1 < len(set(got.values())) < len(rows)


def test_date_slots(spark):
    from pyspark.sql import functions as F

    v = spark.range(1).select(vectors.date_slots(F.lit("2018-03-31 23:59:00").cast("timestamp")).alias("v")).first()["v"]
    assert len(v) == 108 and [i for i, x in enumerate(v) if x] == [2, 16, 22, 47, 107]


def test_sparse_vectors_are_appended(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "u"), (2, ["b"], "v")], "id int, t array<string>, c string")
    out = vectors.one_hot(vectors.tf_idf(df, "t", features=16), "c")
    sizes = {r["vector"].size for r in out.select("vector").collect()}
    assert sizes == {16 + 3} or sizes == {16 + 2}


def test_logistic_scores(spark):
    df = spark.createDataFrame([([float(i), 1.0], float(i > 20)) for i in range(40)], "x array<double>, y double").coalesce(1)
    fitted = models.train_logistic(df, "x", "y", reg=0.001)
    assert models.score_logistic(df, fitted, "x").where("y = prediction").count() >= 38
