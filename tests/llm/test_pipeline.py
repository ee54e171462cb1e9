"""The pipeline stage by stage: each against brute force on its own input, odd rows and an empty table through all of them."""

import base64
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from flowspark.llm import mixing
from flowspark.llm.shared import written

STAGES = dict(corpus_pipeline.STAGES)


def blanks(text):
    return (text or "").encode().split()


def near_groups(rows):
    sets = {}
    for r in rows:
        w = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_windows(rows):
    seen, cut = Counter(), {r.doc_id: blanks(r.text) for r in rows}
    for w in cut.values():
        seen.update(tuple(w[k:k + 35]) for k in range(len(w) - 34))
    out = {}
    for r in rows:
        w = cut[r.doc_id]
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for p in range(k, k + 35)}
        out[r.doc_id] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r.text
    return out


@pytest.fixture(scope="module")
def results(spark, small):
    """Each stage's input and output on the smallest tables."""
    docs, found = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, small), "test-pipeline")
        found[name] = (docs.collect(), out.collect(), docs.columns, out.columns)
        docs = out
    return found


def test_columns_stay_until_the_last_stage(results):
    names = list(results)
    assert all(results[n][3] == ["doc_id", "text", "lang", "source", "n_chars"] for n in names[:-1])
    assert set(results[names[-1]][3]) >= {"doc_id", "text", "ids", "n_tokens"}


def test_language_keeps_texts_with_letters(results):
    given, out, *_ = results["language id"]
    assert {r.doc_id for r in out} >= {r.doc_id for r in given if len([c for c in r.text or "" if c.isalpha()]) > 20}
    assert all(any(c.isalpha() for c in r.text) for r in out)


def test_near_duplicates(results):
    given, out, *_ = results["near duplicates"]
    groups = near_groups(given)
    assert sorted(r.doc_id for r in out) == sorted(i for i in groups if groups[i] == i)
    texts = {r.doc_id: r for r in given}
    assert all(r == texts[r.doc_id] for r in out)


def test_repeated_passages(results):
    given, out, *_ = results["repeated passages"]
    want = without_windows(given)
    assert {r.doc_id: r.text for r in out} == want and len(out) == len(given)
    assert all(r.n_chars == len(r.text) for r in out if r.text != next(g.text for g in given if g.doc_id == r.doc_id))


def test_source_mix(spark, results):
    given, out, *_ = results["source mix"]
    planned = mixing.plan(spark.createDataFrame(given)).collect()
    want = Counter({r.doc_id: r.copies for r in planned if r.copies})
    assert Counter(r.doc_id for r in out) == want
    texts = {r.doc_id: r for r in given}
    assert all(r == texts[r.doc_id] for r in out)
    total = sum(len(blanks(r.text)) for r in given)
    assert abs(sum(len(blanks(r.text)) for r in out) - total) < 0.1 * total


def test_tokens(results):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given, out, *_ = results["byte-level bpe"]
    assert Counter((r.doc_id, r.text) for r in given) == Counter((r.doc_id, r.text) for r in out)
    assert all(list(r.ids) == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in out)


def test_odd_rows_and_empty_tables_pass_all_stages(spark, odd, none, small):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, small), "test-odd")
        assert docs.count() >= 0


def test_run_is_registered(spark, small):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == list(STAGES)
