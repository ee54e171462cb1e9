"""Token counts of a sentencepiece model: lengths only, in Arrow batches balanced by bytes.

Texts are cut at safe boundaries, places no piece of the vocabulary can span: before a blank that
stands between two non-blanks, as no piece has a blank behind another character. Each unit counts
alone as the library counts it (its dummy prefix is the blank that was cut), so a text's count is the
sum over its units, and long texts never reach the library whole. The distinct units of a batch go
through the library in groups of equal bytes; a bounded memo keeps counts from batch to batch.

The boundary rule is proven against the model when a worker loads it; a model that breaks it, or a
text that uses the model's own blank mark, is encoded whole. Null texts count like empty ones: 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.bpe import Memo
from flowspark.llm.shared import in_parts, ready

MARK = "▁"
GROUP_BYTES = 256 * 1024
MEMO_BYTES = 64 * 1024 * 1024


class Counter:
    def __init__(self, path: str, memo: int = MEMO_BYTES, group_bytes: int = GROUP_BYTES):
        import re

        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = ["a", "b  c", "x\ny", " z"]
        self.cuts = (not any(MARK in p.lstrip(MARK) for p in pieces)
                     and len(self.model.encode("  ")) > 0  # blanks are kept, not squeezed
                     and all(len(self.model.encode(f"{p} {q}")) == len(self.model.encode(p)) + len(self.model.encode(q))
                             for p in probe for q in probe if q[0] != " "))
        self.uneven = re.compile(f"  |^ | $|{MARK}")
        self.boundary = re.compile(r"(?<=[^ ]) (?=[^ ])")
        self.memo, self.group_bytes = Memo(memo), group_bytes

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts or MARK in text:
            return [text]
        return self.boundary.split(text) if self.uneven.search(text) else text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.units(t) for t in texts]
        distinct: set[str] = set()
        for units in cut:
            distinct.update(units)
        new = self.memo.missing(distinct)
        for part in in_parts(new, (len(u) + 8 for u in new), self.group_bytes):
            self.memo.remember(part, list(map(len, self.model.encode(part, num_threads=1))))
        return [sum(map(self.memo.__getitem__, units)) for units in cut]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: `doc_id`, `n_bytes`, `n_tokens` and whether the tokens exceed `limit`."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": batch.column(1), "n_tokens": pa.array(counter(path).count(texts), pa.int64())})

    text_col = F.coalesce(F.col(text), F.lit(""))
    counted = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_col).cast("long").alias("n_bytes"),
                        text_col.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
