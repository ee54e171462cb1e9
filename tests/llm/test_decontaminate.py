"""Benchmark windows by Wu-Manber search against plain substring search."""

import hashlib
import random
import re

import pytest

from flowspark.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(text, items):
    """Words, words hit and items with occurring windows."""
    w = words_of(text)
    hit, named = set(), set()
    for item, question in items:
        q = words_of(question)
        for i in range(max(1, len(q) - D.WORDS + 1)) if q else ():
            own = q[i:i + D.WORDS]
            for s in range(len(w) - len(own) + 1):
                if w[s:s + len(own)] == own:
                    hit.update(range(s, s + len(own)))
                    named.update([] if item is None else [str(item)])
    return len(w), hit, sorted(named)


BENCHMARK = [
    (1, "The house and the garden of the neighbour were sold. The house"), (2, "short one"), (3, None), (4, " ?!, "), (None, "nobody's item but two words"),
    (5, " ".join(f"common{i}" for i in range(12))), (5, " ".join(f"common{i}" for i in range(30, 45))), (6, " ".join(f"common{i}" for i in range(12))),
    (10, "die"), (11, "Ä ÖÜ ß é"), (12, "a"), (13, " ".join(f"w{i % 977} x{i % 31}." for i in range(300))), (14, "repeated row common0 common1 common2"),
]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(t, i, f"x{i}", i) for i, t in BENCHMARK]
    return spark.createDataFrame(rows, "text string, item_id long, doc_id string, n_words long")


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 2000])
def test_odd_rows_in_one_block_and_in_many(odd, none, items, block_bytes):
    got = sorted(D.found(odd, items, block_bytes=block_bytes).collect(), key=str)
    want = []
    for r in odd.collect():
        n, hit, named = brute(r.text, BENCHMARK)
        want.append((r.doc_id, n, sorted(hit), named))
    told = [(r.doc_id, r.n_words, [p for s in r.spans for p in range(s["start"], s["end"])], list(r["items"])) for r in got]
    assert sorted(told, key=str) == sorted(want, key=str)
    assert D.judged(none, items, block_bytes=block_bytes).count() == 0
    for r in D.judged(odd, items, block_bytes=block_bytes).where("n_items > 1").collect():
        assert r.contaminated and any(r.items_sha256 == hashlib.sha256(",".join(w[3]).encode()).hexdigest() for w in want if w[0] == r.doc_id)


def test_nothing_to_search_for(odd, items):
    rows = D.judged(odd, items.limit(0)).collect()
    assert len(rows) == odd.count() and not any(r.contaminated or r.n_hit or r.n_items for r in rows)
    assert {r.items_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}


def test_search_of_random_texts():
    chance = random.Random(11)
    for letters in ("a", "ab", "abcé"):
        for _ in range(40):
            def text(n):
                return " ".join("".join(chance.choice(letters) for _ in range(chance.randint(1, 4))) for _ in range(n))

            benchmark = [(k, text(chance.choice([1, 2, 9, 10, 11, 25]))) for k in range(6)]
            rows = [(" ".join(words_of(q)[i:i + D.WORDS]), str(k)) for k, q in benchmark for i in range(max(1, len(words_of(q)) - D.WORDS + 1))]
            docs = [text(chance.randint(0, 400)) + " " + chance.choice(benchmark)[1] + ". " + text(chance.randint(0, 60)) for _ in range(4)] + ["", "?"]
            counts, spans, named = D.Search(rows).scan([d.encode() for d in docs])
            for d, n, s, names in zip(docs, counts, spans, named):
                want = brute(d, benchmark)
                assert (n, {p for x in s for p in range(x["start"], x["end"])}, names) == want
                assert all(a["end"] < b["start"] for a, b in zip(s, s[1:]))  # stretches don't touch


def test_shifts_skip_most_of_a_clean_text():
    chance = random.Random(3)
    word = lambda: "".join(chance.choice("etaoinshrdlu") for _ in range(chance.randint(2, 8)))
    windows = [(" ".join(word() for _ in range(10)), str(i)) for i in range(300)]
    search = D.Search(windows)
    for own in search.classes:
        assert own.shift.max() == own.m - own.block + 1 and (own.shift == own.shift.max()).mean() > 0.5


def test_windows_of_one_beginning_are_told_apart():
    same = "one beginning that very many windows share with each other"
    windows = [(f"{same} {i}", str(i)) for i in range(3000)]
    _, spans, items = D.Search(windows).scan([f"x {same} 17 y {same} 2999".encode(), f"{same} 3000".encode()])
    assert items == [["17", "2999"], []] and spans[0] == [{"start": 1, "end": 12}, {"start": 13, "end": 24}]
