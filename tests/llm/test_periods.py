"""Periodic runs against the definition, tried place by place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from flowspark.llm import periods as P
from flowspark.llm.minhash import mix


def brute(w):
    """All runs by comparing at every lag."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def hashed(w):
    return mix(np.array([zlib.crc32(str(x).encode()) + 10_000 for x in w], np.uint64)) if len(w) else np.zeros(0, np.uint64)


def words_like(chance, n, letters):
    w = [chance.randrange(letters) for _ in range(n)]
    for _ in range(chance.randrange(4)):
        if n > 30:
            a, q = chance.randrange(n), chance.choice([1, 2, 3, 5, 7, 8, 9, 11, 12, 13, 17, 18, 26, 27, 40, 41, 63, 100])
            for i in range(a + q, min(n, a + q * chance.randint(2, 6) + chance.randrange(4))):
                w[i] = w[i - q]
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 50, 100_000])
def test_random_texts(letters):
    chance = random.Random(letters)
    texts = [words_like(chance, chance.choice([0, 1, 23, 24, 25, 60, 130, 400, 700]), letters) for _ in range(60)]
    assert P.runs_of([hashed(w) for w in texts]) == [brute(w) for w in texts]


def test_one_text_more_than_a_portion(monkeypatch):
    monkeypatch.setattr(P, "PORTION", 500)
    chance = random.Random(5)
    texts = [words_like(chance, n, 40) for n in (300, 301, 900, 64, 100, 200, 255, 256)]
    assert P.runs_of([hashed(w) for w in texts]) == [brute(w) for w in texts]


def test_every_period_is_found():
    for q in range(1, 120):
        for n in (max(24, 3 * q) - 1, max(24, 3 * q), 3 * q + q // 2 + 24):
            w = [f"a{i}" for i in range(17)] + [f"b{i % q}" for i in range(n)] + [f"c{i}" for i in range(9)]
            assert P.runs_of([hashed(w)])[0] == ([(17, n, q)] if n >= max(24, 3 * q) else [])


def test_overlapping_and_nested_runs():
    inner = ["x", "y"] * 15
    w = (inner + ["z"]) * 4
    assert P.runs_of([hashed(w)])[0] == brute(w) and len(brute(w)) == 5


def test_words_on_which_slice_hashes_collide():
    # the Thue-Morse sequence defeats polynomial hashes modulo a power of two; it has no run
    w = [bin(i).count("1") % 2 for i in range(1 << 13)]
    assert P.runs_of([hashed(w)]) == [[]]
    both = w[:4096] + ["k", "l", "m"] * 20 + w
    assert P.runs_of([hashed(both)]) == [[(4096, 60, 3)]]


def test_long_text(spark):
    chance = random.Random(2)
    w = [chance.randrange(5000) for _ in range(200_000)]
    for i in range(50_000 + 7919, 50_000 + 7919 * 4 + 11):
        w[i] = w[i - 7919]
    assert P.runs_of([hashed(w)])[0] == [(50_000, 7919 * 4 + 11, 7919)]


def test_odd_rows(odd, none):
    def words_of(text):
        return [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]

    def planted(i, w):
        h = zlib.crc32(str(i).encode())
        if i is None or h % 10 or not w:
            return w
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]

    def told(i, w):
        # a long text is periodic in nothing here; the definition takes too long for it
        runs = brute(w) if len(w) < 5000 else P.runs_of([hashed(w)])[0]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))

    got = [tuple(r) for r in P.judged(odd).collect()]
    rows = odd.collect()
    assert sorted(got, key=str) == sorted((told(r.doc_id, planted(r.doc_id, words_of(r.text))) for r in rows), key=str)
    assert P.judged(none).count() == 0
    plain = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in P.found(odd).collect()]
    assert sorted(plain, key=str) == sorted(((r.doc_id, len(words_of(r.text)), P.runs_of([hashed(words_of(r.text))])[0]) for r in rows), key=str)


def test_ties_fall_to_the_first_run(spark):
    text = " ".join(["a"] * 24 + ["u", "v"] + ["b"] * 24 + ["w"] + ["c", "d"] * 24)
    row = P.judged(spark.createDataFrame([(5, text)], "doc_id long, text string")).first()
    assert zlib.crc32(b"5") % 10 and (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 0, 24, 1, 24000)
    got = P.found(spark.createDataFrame([(5, text)], "doc_id long, text string")).first()
    assert got.collapsed == "a u v b w c d"
