"""Operators against brute force: odd rows, empty tables, the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from check_oracle import TABLES, canon
from flowspark.llm import fingerprints, langid, licenses, minhash, mixing, quality, substrings, warc
from flowspark.llm.queries import ORACLE, QUERIES


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in cursor.fetchall())


# --- licences -------------------------------------------------------------------------------------------------------

def test_licenses_of_odd_rows(odd, none):
    rows = licenses.labelled(odd).collect()
    assert len(rows) == odd.count() and licenses.labelled(none).count() == 0
    texts = Counter((r.doc_id, r.text) for r in odd.collect())
    by_id = {r.doc_id: r for r in rows}
    for (i, text), _ in texts.items():
        if i in (None, 20, 21):
            continue
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        spots = sorted((s, label) for phrase, label in licenses.BASE.items() for s in range(len(w)) if w[s:s + len(phrase.split())] == phrase.split())
        r = by_id[i]
        assert (r.n_words, r.n_base) == (len(w), len(spots))
        assert (r.first_word, r.last_word) == ((spots[0][0], spots[-1][0]) if spots else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in spots})) and 0 <= r.score <= 1


def test_license_places_at_the_edges(spark):
    texts = {1: "cc by", 2: "CC-BY cc by-nc 4.0", 3: "license mit license mit", 4: "by cc by cc",
             5: "license version 2.0 Licensed under the Apache License, Version 2.0", 6: "the terms of the GNU GENERAL public licensé"}
    got = {r.doc_id: r for r in licenses.labelled(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].n_base for i in range(1, 7)] == [1, 2, 1, 1, 1, 0]
    assert got[5].labels == "apache,apache-2.0" and got[5].score == 1.0 and got[2].labels == "cc-by,cc-by-nc-4.0"


# --- near-duplicates --------------------------------------------------------------------------------------------------

def components_of(texts):
    """Brute force over all pairs."""
    sets = {}
    for i, text in texts:
        w = lower(text).encode().split()
        grams = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(grams)
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(p and q and 100 * len(p & q) >= 75 * len(p | q) for p in sets[a] for q in sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def near_texts(seed=3):
    """Groups of edited copies, chains, and pairs on either side of the threshold."""
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(400)]
    texts, i = [], 100
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 6, 12, 40, 150]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((i, " ".join(copy)))
            i += 1
            base = copy if rng.random() < 0.5 else base
    rng.shuffle(texts)
    return texts


def test_components_equal_brute_force(spark):
    texts = near_texts()
    want, _ = components_of(texts)
    rows = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_group_with_weak_centre(spark):
    """A hot group whose smallest id is like few of the others: later stars must find the rest."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(80)]
    texts = []
    for i in range(120):
        copy = list(base)
        at = rng.randrange(0, 70)
        copy[at:at + (9 if i else 1)] = [f"n{i}_{k}" for k in range(9 if i else 1)]
        texts.append((i, " ".join(copy)))
    want, _ = components_of(texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    want, sets = components_of([(r.doc_id, r.text) for r in odd.collect()])
    assert len(rows) == odd.count() and minhash.near_duplicates(none).count() == 0
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.n_shingles in {len(s) for s in sets[r.doc_id]}
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    # the two texts of id 21 are documents of their own: the longer one is near text 7 and goes, the other stays
    assert sorted(ids) == sorted([i for i in want if want[i] == i] + [21])
    assert [r.text for r in kept.where("doc_id = 21").collect()] == ["one id"]
    assert minhash.deduplicated(none).count() == 0


def test_texts_that_share_an_id_or_have_none(spark):
    """Rows are documents by id and text: no text is lost to another one's id, and copies without an id go too."""
    one, two, three = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    given = [(1, one), (1, two), (1, one), (2, three), (3, one), (None, two), (None, two), (None, three + " more"), (None, ""), (None, None), (4, ""), (4, "")]
    rows = [(*r, "x", 1, 2, 3, "y") for r in given]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id_of string, node_key long, _least long, shared_id long, Text_Key string")
    got = [r.text for r in minhash.deduplicated(docs).collect()]
    assert sorted(t.split()[0][0] for t in got if t) == ["a", "b", "c"] and len([t for t in got if not t]) == 3


def test_extra_columns_named_like_helpers(spark):
    repeat = " ".join(f"p{i}" for i in range(50))
    names = "_id, _src, _md5, _copies, _copy, _digest, _i, _h, _at, text_hash, at".split(", ")
    docs = spark.createDataFrame([(i, f"t{i} {repeat} u{i}", "en", "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(6)],
                                 "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for made in (substrings.without_repeats(docs), mixing.mixed(docs), minhash.deduplicated(docs), langid.accepted(docs)):
        rows = made.collect()
        assert made.columns == docs.columns and rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert [r.text for r in substrings.without_repeats(docs).orderBy("doc_id").collect()] == [f"t{i} u{i}" for i in range(6)]


def test_without_labels_lettered_documents_stay(spark):
    docs = spark.createDataFrame([(1, "ein Haus", None), (2, "12 !", None), (3, None, None), (4, "\u00c4", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.accepted(docs).collect()} == {1, 4}


def test_short_pairs_are_not_lost_by_their_sketch(spark):
    """A text of seven words and one more: similarity 0.75, few shingles fill all bins, so sketches differ by chance."""
    hasher, texts = minhash.Hasher(), []
    for k in range(6000):
        words = [f"s{k}_{j}" for j in range(8)]
        pair = [" ".join(words[:7]), " ".join(words)]
        a, b = (hasher.values(minhash.shingle_set(t.encode())) for t in pair)
        if ((a & np.uint64(15)) == (b & np.uint64(15))).sum() < minhash.AGREE and set(hasher.buckets(a)) & set(hasher.buckets(b)):
            texts += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
    assert len(texts) >= 10
    rows = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in rows) and len(rows) == len(texts)


def test_densified_signature_estimates_similarity():
    hasher, rng = minhash.Hasher(), np.random.default_rng(1)
    for size in (8, 60, 2000):
        shared = minhash.mix(rng.integers(1, 2**62, size, dtype=np.uint64))
        a = np.sort(np.concatenate([shared, minhash.mix(rng.integers(1, 2**62, size // 8, dtype=np.uint64))]))
        b = np.sort(np.concatenate([shared, minhash.mix(rng.integers(1, 2**62, size // 8, dtype=np.uint64))]))
        true = size / (size + 2 * (size // 8))
        assert abs((hasher.values(a) == hasher.values(b)).mean() - true) < 0.15


def test_bitmaps_bound_what_is_shared(spark):
    from pyspark.sql import functions as F

    hasher, rng, rows = minhash.Hasher(), np.random.default_rng(2), []
    for size in (3, 60, 170, 900, 5000):
        shared = minhash.mix(rng.integers(1, 2**62, size, dtype=np.uint64))
        a, b = (np.unique(np.concatenate([shared, minhash.mix(rng.integers(1, 2**62, size // 6, dtype=np.uint64))])) for _ in range(2))
        marks = [np.concatenate([hasher.sketch(hasher.values(x)), hasher.bitmap(x)]).view(np.int64).tolist() for x in (a, b)]
        rows.append((len(a), len(b), *marks, len(shared)))
    df = spark.createDataFrame(rows, "a_n long, b_n long, a_sketch array<long>, b_sketch array<long>, shared long")
    bound = minhash._shared_at_most(F.col("a_n"), F.col("a_sketch"), F.col("b_sketch"))
    for r in df.select("shared", "a_n", bound.alias("bound")).collect():
        assert r.shared <= r.bound <= r.a_n
    assert df.select(bound.alias("bound"), "shared").where("bound = shared").count() >= 1


def test_long_text_hashes_like_short_ones(monkeypatch):
    text = (" ".join(f"w{i}" for i in range(5000)) + "\n").encode()
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "_CHUNK", 50)
    assert (minhash.word_hashes(text) == whole).all()


# --- fingerprints -----------------------------------------------------------------------------------------------------

def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprints.compared(odd).collect()
    assert len(rows) == odd.count() and fingerprints.compared(none).count() == 0
    one = fingerprints.compared(odd.limit(1)).collect()
    assert one[0].near_next == 1.0
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    ids = [i for i in sorted(texts, key=lambda i: (i is not None, i or 0)) if True]
    prints = {}
    for r in rows:
        following = texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        options = set()
        for text in texts[r.doc_id]:
            q = len(text) // 4
            options |= {(len(text), hashlib.sha256((text[:len(text) - q] + n[:q]).encode()).hexdigest()) for n in following}
        assert (r.n_chars, r.edited_sha256) in options
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts[r.doc_id]) == 1:
            prints.setdefault(next(iter(texts[r.doc_id])), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprint_is_homomorphic(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "One.\nTwo two.\nThree."), (2, "Three.\nOne.\nTwo two."), (3, "One.\nThree."), (4, "Two two.")], "doc_id long, text string")
    prints = fingerprints.fingerprints(df, ["doc_id"])
    f = {r.doc_id: r.fingerprint for r in prints.collect()}
    assert f[1] == f[2] != f[3]
    both = prints.where("doc_id = 3").crossJoin(prints.where("doc_id = 4").select(F.col("fingerprint").alias("b")))
    row = both.select(fingerprints.combined(F.col("fingerprint"), F.col("b")).alias("plus")).first()
    assert row.plus == f[1]
    back = prints.where("doc_id = 1").crossJoin(prints.where("doc_id = 4").select(F.col("fingerprint").alias("b")))
    assert back.select(fingerprints.combined(F.col("fingerprint"), F.col("b"), -1).alias("minus")).first().minus == f[3]


def plain_fingerprint(text):
    """The same sums in plain Python."""
    import struct

    import xxhash

    parts = [p for p in re.split(fingerprints.PIECES, text) if p]

    def hashes(seed):
        return [xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=xxhash.xxh64_intdigest(p.encode(), seed=42)) for p in parts]

    low, lanes = fingerprints.LOW, [len(parts)]
    for seed in fingerprints.EXACT_SEEDS:
        lanes += [sum(h & low for h in hashes(seed)) & low, sum(h >> 32 for h in hashes(seed)) & low]
    for seed in fingerprints.SIGN_SEEDS:
        lanes += [sum((h >> k) & fingerprints.FIELDS for h in hashes(seed)) for k in range(fingerprints.SHIFTS)]
    return lanes


def plain_likeness(a, b):
    if a == b:
        return 1.0

    def signed(f):
        packed = f[1 + fingerprints.N_EXACT:]
        return [2 * (x & fingerprints.LOW) - f[0] for x in packed] + [2 * (x >> 32) - f[0] for x in packed]

    x, y = signed(a), signed(b)
    scale = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / scale)) if scale else 0.0


def test_fingerprints_equal_plain_sums(spark, small):
    rows = {r.doc_id: r for r in QUERIES["op4_document_fingerprints"](spark, small).collect()}
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    own = [plain_fingerprint(text) for _, text in texts]
    assert len(rows) == len(texts)
    for k, (i, text) in enumerate(texts):
        q, n = len(text) // 4, (k + 1) % len(texts)
        changed = text[:len(text) - q] + texts[n][1][:q]
        after = plain_fingerprint(changed)
        digests = [hashlib.sha256(" ".join(map(str, lanes)).encode()).hexdigest() for lanes in (own[k], after)]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == digests
        assert math.isclose(r.near_edited, plain_likeness(own[k], after), abs_tol=1e-9)
        assert math.isclose(r.near_next, plain_likeness(own[k], own[n]), abs_tol=1e-9)


def test_edited_texts_are_nearer_than_the_next(spark, small):
    rows = QUERIES["op4_document_fingerprints"](spark, small).collect()
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    for k, (i, text) in enumerate(texts):
        r, q, front = next(r for r in rows if r.doc_id == i), len(text) // 4, texts[(k + 1) % len(texts)][1]
        assert r.edited_sha256 == hashlib.sha256((text[:len(text) - q] + front[:q]).encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


# --- mixing -----------------------------------------------------------------------------------------------------------

def skewed(spark, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), None if i % 50 == 7 else f"s{min(int(rng.expovariate(1.2)), 5)}") for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("entropy, repeats", [(0.9, 4.0), (0.99, 1.5), (0.2, 4.0)])
def test_mix_meets_targets(spark, entropy, repeats):
    docs = skewed(spark)
    rows = mixing.plan(docs, entropy=entropy, repeats=repeats, block_tokens=500).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.tokens
    total, weight = sum(tokens.values()), {r.source: r.weight for r in rows}
    assert math.isclose(sum(weight.values()), 1)
    h = -sum(w * math.log(w) for w in weight.values())
    natural = -sum(t / total * math.log(t / total) for t in tokens.values())
    most = max(weight[s] * total / tokens[s] for s in tokens)
    assert most <= repeats * (1 + 1e-6)
    assert h >= min(entropy * math.log(len(tokens)), h if math.isclose(most, repeats, rel_tol=1e-6) else math.inf) - 1e-6
    assert h >= natural - 1e-9
    # realised tokens follow the weights, to one document a source
    for s in tokens:
        got = sum(r.copies * r.tokens for r in rows if r.source == s)
        assert abs(got - weight[s] * total) <= 40
    assert len({b.block for b in rows if b.source == "s0"}) > 5


def test_mix_of_odd_rows(odd, none):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(none).count() == 0 and mixing.plan(none).count() == 0
    planned = Counter()
    for r in mixing.plan(odd).collect():
        planned[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +planned


# --- substrings -------------------------------------------------------------------------------------------------------

def stripped(texts):
    spots = {}
    cut = [(t or "").encode().split() for t in texts]
    for d, w in enumerate(cut):
        for k in range(len(w) - 34):
            spots.setdefault(tuple(w[k:k + 35]), []).append((d, k))
    gone = [set() for _ in cut]
    for places in spots.values():
        if len(places) > 1:
            for d, k in places:
                gone[d].update(range(k, k + 35))
    return [(len(w), len(g), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in g)).hexdigest()) for w, g in zip(cut, gone)]


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (34, 35, 36, 50, 80, 200)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 34))
            parts += [rng.choice(words) for _ in range(rng.randrange(0, 12))] + p[a:a + rng.randrange(30, 90)]
        texts.append(" ".join(parts))
    texts += ["same " * 200, "same " * 34, "ab cd " * 60, " ".join(words[:35]), " ".join(words[:35])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == stripped(texts)


def test_repeats_of_odd_rows(odd, none):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeats(odd).collect())
    given = odd.collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), *s) for r, s in zip(given, stripped([r.text for r in given])))
    assert rows == want and substrings.repeats(none).count() == 0
    out = substrings.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and substrings.without_repeats(none).count() == 0
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[2].text is None and kept[4].text == " \n\t " and kept[4].n_chars == 4
    assert kept[8].text == "tail" and kept[8].n_chars == 4 and kept[7].text == ""


def test_every_window_holds_its_anchor():
    rng = np.random.default_rng(5)
    for grams in (rng.integers(0, 5, 300).astype(np.uint64), np.zeros(80, np.uint64), rng.integers(0, 2**60, 21).astype(np.uint64)):
        pos = substrings.selected(grams)
        for k in range(len(grams) - 20):
            part = grams[k:k + 21]
            assert pos[k] == k + max(np.flatnonzero(part == part.min()))


# --- archives ---------------------------------------------------------------------------------------------------------

def page_rows():
    big = "<p>" + "payload " * 40
    return [(5, "u5", big), (3, "u3", big), (3, "u3", big), (9, None, big), (None, "u", big), (1, "u1", None), (2, "u2", ""), (4, "u\r\nX: 1", "é" * 60),
            (6, "u6", "x" * 99), (7, "u7", "x" * 99), (8, "u8", "y" * 100), (10, "u10", "y" * 100), (11, "l", "z" * 300_000)]


def test_archives_of_odd_rows(spark):
    rows = page_rows()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "page_id long, url string, html string, payload long")
    got = Counter(tuple(r) for r in warc.archived(df).collect())
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same and len(raw) >= 100 else i
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert got == want
    assert warc.archived(df.limit(0)).count() == 0


def test_archive_form(spark, small, tmp_path):
    import struct

    import zstandard

    pages = spark.read.parquet(f"{small}/pages.parquet")
    done = warc.write_archives(warc.typed(pages).coalesce(1), f"file://{tmp_path}/a").collect()
    assert sum(d.records for d in done) == pages.count()
    raw = (tmp_path / "a" / done[0].archive).read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and size == done[0].dictionary_bytes > 0
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(warc.record(*r))) for r in warc.typed(pages).collect())
    assert len(raw) < plain  # the dictionary pays for itself
    with pytest.raises(ValueError):
        broken = warc.record(1, "u", b"abc", "0" * 64, "response", None)
        warc.parsed(broken)


# --- language ---------------------------------------------------------------------------------------------------------

def test_language_of_held_out_rows(spark, small):
    import zlib

    truth = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, small).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(truth[r.doc_id].lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(odd, none):
    rows = langid.predictions(odd).collect()
    assert len(rows) == odd.count() and langid.predictions(none).count() == 0
    for r, text in zip(rows, [r.text for r in odd.collect()]):
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.score == 0)
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and {9, 2, 3, 4}.isdisjoint({r.doc_id for r in kept.collect()})
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.predictions(unlabelled).collect()} == {"und"}


def test_kernel_equals_sets():
    texts = ["Das Haus", "das  Haus!", "the house", "x"]
    bits = np.stack([langid.presence(t) for t in texts])
    k = langid.unit_rows(bits) @ langid.unit_rows(bits).T

    def grams(t, n):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        return {t[i:i + n] for i in range(len(t) - n + 1)}

    for a in range(3):
        for b in range(3):
            want = np.mean([len(grams(texts[a], n) & grams(texts[b], n)) / math.sqrt(len(grams(texts[a], n)) * len(grams(texts[b], n))) for n in langid.LENGTHS])
            assert abs(k[a, b] - want) < 0.06  # slots are shared by few


def test_slices_see_all_ngrams(monkeypatch):
    text = "".join(random.Random(1).choice("abc d") for _ in range(5000))
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "SLICE", 64)
    assert (langid.presence(text) == whole).all()


# --- quality ----------------------------------------------------------------------------------------------------------

def base_counts(text):
    w = words_of(text)
    grams = list(zip(w, w[1:], w[2:]))
    found, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if found[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, odd, none, small):
    rng = random.Random(6)
    made = [(i, "".join(rng.choice(["a ", "b ", "cc ", "#", "\n", "x|y ", "\t", "é "]) for _ in range(rng.randrange(0, 90))), "en", "s") for i in range(300)]
    for df in (spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), odd.where("doc_id not in (20, 21)"),
               spark.read.parquet(f"{small}/documents.parquet")):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in quality.statistics(df).collect():
            want = base_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.judged(none).count() == 0
    assert quality.judged(odd).count() == odd.count()
    assert quality.judged(odd.where("doc_id in (2, 3)")).where("kept").count() == 0


def mcd(x, keep, steps):
    """The same estimate in numpy, with exact quantiles."""
    floors = np.array(list(quality.FLOORS.values()))
    low = lambda v, q: np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]
    middle = np.array([low(x[:, j], 0.5) for j in range(x.shape[1])])
    spread = np.array([low(abs(x[:, j] - middle[j]), 0.5) for j in range(x.shape[1])])
    z = (x - middle) / np.maximum(floors, 1.4826 * spread)
    far = (z * z).sum(axis=1)
    for _ in range(steps):
        near = z[far <= low(far, keep)]
        mu, cov = near.mean(axis=0), np.cov(near.T, bias=True)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), 1.0))
        far = np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(cov), z - mu)
    return far / max(1.0, low(far, 0.5) / quality.CHI_MEDIAN)


def test_distances_equal_numpy(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    rows = []
    for i in range(700):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        if i % 12 == 0:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), "en" if i < 400 else "de", "big" if i % 300 else "tiny"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    group = {i: (lang, source) for i, _, lang, source in rows}
    feats = {i: np.array([math.log(c / n), math.log1p(s / n), math.log1p(100 * d / n), math.sqrt(p / n), math.log(n)])
             for i, t, *_ in rows for n, c, s, d, p in [base_counts(t)]}
    for lang in ("en", "de"):
        for wide in (False, True):
            own = [i for i in group if group[i][0] == lang and (wide or group[i][1] == "big")]
            far = dict(zip(own, mcd(np.array([feats[i] for i in own]), quality.KEEP, quality.STEPS)))
            for i in own:
                if (group[i][1] == "tiny") == wide:
                    assert math.isclose(got[i].distance, far[i], rel_tol=1e-6), i
    assert all(got[i].kept == (i % 12 != 0) for i in got)


def test_outliers_in_one_statistic_alone(spark):
    rng = random.Random(12)

    def some(n, size=6):
        return ["".join(rng.choice("abcdefghijklmnop") for _ in range(size + rng.randrange(-1, 2))) for _ in range(n)]

    texts = [" ".join(some(rng.randrange(90, 111))) for _ in range(600)]
    lines = "".join(" ".join(some(14)) + "\nheader\n" for _ in range(9))
    repeats = " ".join(" ".join(some(3) + ["one", "two", "three"]) for _ in range(16)) + " " + " ".join(some(2))
    symbols = " ".join(w + "$" * (i % 3 == 0) for i, w in enumerate(some(100)))
    planted = {"u_lines": lines, "u_repeats": repeats, "u_symbols": symbols, "u_length": " ".join(some(100, 14)), "u_words": " ".join(some(3000))}
    rows = [(i, t, "en", "s") for i, t in enumerate(texts + list(planted.values()))]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for k, name in enumerate(planted):
        assert not got[600 + k].base_failed and not got[600 + k].kept, (name, got[600 + k].distance)
    assert sum(got[i].kept for i in range(600)) >= 598
