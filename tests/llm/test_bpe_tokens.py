"""Byte-level BPE against the tiktoken library, token counts against sentencepiece: whole texts, odd texts, random texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from flowspark.llm import bpe, tokens
from flowspark.llm.queries import QUERIES

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", " a  b  ", "\n\n a\n", "a  b", "x  y", "it's we'll 'tis 12 34a",
       "\u0000\u0001", "퟿\U0001f600 ́e", "日本語 テキスト", "<s> </s> <unk> <|endoftext|>", "▁a ▁", "a▁b c", "\t tab\x0b\x1c\x1f \x85z",
       "ab" * 3000, "x" * 5000, " ".join(["word"] * 3000), "a \n b \r\n c", "é ﬁ ²"]


def noise(n, seed=1):
    rng = random.Random(seed)
    letters = "ab eé'\n\t 1.,# 日🙂sS"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")


def test_round_trip_equals_library(spark, library):
    texts = [*ODD, *noise(400), None, None, "same", "same"]
    got = {r.doc_id: r for r in bpe.round_trip(table(spark, texts), RANKS, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids), repr(text)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(text)
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_library(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op1_byte_bpe"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_columns_encode_then_decode(spark, library):
    df = table(spark, ["a b", None, ""]).withColumnRenamed("n_bytes", "IDS_2")
    rows = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [library.encode_ordinary("a b"), [], []]
    assert [bytes(r.raw) for r in rows] == [b"a b", b"", b""]
    clash = table(spark, ["a b", None]).withColumnRenamed("n_bytes", "ids")
    out = bpe.reencoded(clash, RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["a b", None] and out[0].ids == "x" and out[0].ids_ == library.encode_ordinary("a b")


def test_memo_turns_over(library):
    codec = bpe.Codec(RANKS, P.PATTERN, memo=3)
    for _ in range(2):
        for text in noise(60, 5):
            packed = codec.encode([text])
            assert codec.decode(packed) == [text.encode()]
            assert len(packed[0]) // 4 == len(library.encode_ordinary(text))


def test_words_of_a_batch_are_cut_in_few_calls(library):
    """Units are joined to a text again before the pattern cuts them; each word of its own cost a call before."""
    codec = bpe.Codec(RANKS, P.PATTERN)
    whole, calls = codec.pattern, []

    class Counted:
        def findall(self, text):
            calls.append(text)
            return whole.findall(text)

    codec.pattern = Counted()
    texts = [" ".join(f"w{i}x{k}, été{k}" for k in range(300)) for i in range(3)]
    for text, packed in zip(texts, codec.encode(texts)):
        assert packed == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text))
    assert len(calls) <= 2 * len(texts)


def test_blanks_after_wide_spaces(library):
    """No cut before a blank that follows white space of several bytes, nor between a control character and a blank."""
    wide = [chr(c) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    odd = [*wide, *map(chr, range(0x21)), "\x7f", "é", "Ġ", "à", "日", "🙂", "…", "—", "1", "'"]
    rng = random.Random(3)
    texts = [f"a{c} b{c}  b {c}c {c} d{c}" for c in odd]
    texts += ["".join(rng.choice([*odd, " ", " ", " ", "x"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    codec = bpe.Codec(RANKS, P.PATTERN)
    packed = codec.encode(texts)
    for text, got, back in zip(texts, packed, codec.decode(packed)):
        assert got == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text)), repr(text)
        assert back == text.encode()


def test_sliced_and_null_texts_and_unknown_ids(library):
    codec = bpe.Codec(RANKS, P.PATTERN)
    given = pa.array(["no", None, "a b", "", " a b", None, "no"]).slice(1, 5)
    packed, named, raw = codec.coded(given, codec.decimals, codec.decoded)
    texts = ["", "a b", "", " a b", ""]
    assert [packed[0][a:b] for a, b in zip(packed[1], packed[1][1:])] == codec.encode(texts)
    assert [raw[0][a:b].decode() for a, b in zip(raw[1], raw[1][1:])] == texts
    assert [named[0][a:b].decode().split() for a, b in zip(named[1], named[1][1:])] == [
        list(map(str, library.encode_ordinary(t))) for t in texts]
    unknown = len(codec.ranks) + 5  # an id that no token has stands for nothing
    assert codec.decode_runs([np.array(i, dtype="<i4").tobytes() for i in ([unknown], [], [64, unknown, 65])]) == [
        b"", b"", b"".join(t for i in (64, 65) for t, r in codec.ranks.items() if r == i)]
    letters = bpe.Codec(RANKS, r"\p{L}+")  # a pattern that leaves characters out
    assert letters.encode(["a, b", ", ", "é"]) == [b"".join(codec.encode(["a", "b"])), b"", codec.encode(["é"])[0]]


def test_counts_equal_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD, *noise(400, 2), None]
    df = table(spark, texts)
    got = {r.doc_id: r for r in tokens.token_counts(df, MODEL, limit=100).collect()}
    for i, text in enumerate(texts):
        n = len(model.encode(text or ""))
        assert got[i].n_tokens == n, repr(text)
        assert got[i].over_limit == (n > 100) and got[i].n_bytes == len((text or "").encode())


def test_count_query_equals_library(spark, small):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op6_token_counts"](spark, small).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(model.encode(t)) for i, t in texts.items()}
    assert all(tokens.Counter(MODEL).cuts for _ in range(1))


def test_empty_tables(spark):
    empty = table(spark, [])
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
    assert tokens.token_counts(empty, MODEL).count() == 0
