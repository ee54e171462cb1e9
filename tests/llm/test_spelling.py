"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from flowspark.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def told(counts):
    """word: (form, root, n, n_near, form_n) by comparing all pairs."""
    own = {w: [v for v in counts if near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v), default=None) for w, vs in own.items()}
    form = {w: v if v is not None and counts[v] >= 5 * counts[w] else None for w, v in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), counts[w], len(own[w]), counts[form[w]] if form[w] else None) for w in counts}


def counted(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def result(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_words_of_two_letters(spark):
    # nearly every word is near another, letters stand doubled
    chance = random.Random(4)
    counts = {"".join(chance.choice("aab") for _ in range(chance.randint(6, 9))): chance.choice([5, 6, 25, 30, 150, 4000]) for _ in range(220)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.near, r.near_n) for r in S.neighbours(words).collect()}
    for w in counts:
        own = [v for v in counts if near(w, v)]
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        assert got[w] == (counts[w], len(own), best, counts[best] if own else None)


def test_whole_corpus_with_variants(spark):
    chance = random.Random(9)
    letters = "abcdeéüÿ×"
    base = ["".join(chance.choice(letters) for _ in range(chance.randint(5, 10))) for _ in range(40)]
    rows = []
    for i in range(400):
        line = []
        for _ in range(60):
            w = chance.choice(base[:10] if chance.random() < 0.8 else base)
            k = chance.randrange(len(w))
            turn = chance.random()
            line.append(w[:k] + w[k + 1:] if turn < 0.05 else w[:k] + chance.choice(letters) + w[k:] if turn < 0.1 else
                        w[:k] + chance.choice(letters) + w[k + 1:] if turn < 0.15 else w.upper() if turn < 0.2 else w)
        rows.append((i, chance.choice([" ", ", ", "-1-"]).join(line)))
    rows += [(None, rows[0][1]), (3, None), (4, ""), (5, " 12 ?"), (7, rows[7][1]), (7, rows[8][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n long")
    want = told(counted(rows))
    assert len(want) > 100 and any(v[0] for v in want.values()) and result(S.variants(docs)) == want


def test_odd_rows(odd, none):
    assert result(S.variants(odd)) == told(counted([(r.doc_id, r.text) for r in odd.collect()]))
    assert S.variants(none).count() == 0 and S.variants(odd.where("doc_id = 3")).count() == 0


def test_roots_of_a_long_chain(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w0") for i in range(50)]
    got = {r.word: r.root for r in S.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {a: "w37" for a, _ in links}
