"""Language ID by string kernels: n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge regression.

* Kernel: the blended spectrum of character n-grams of 1 to 4. A text is the set of its n-grams, as presence bits in
  `SLOTS` slots per length (lower case; everything but letters is one separator); k(x, y) is the mean over the lengths
  of the cosines of the bit vectors.
* Training: a sample of `PER_LANGUAGE` labelled texts a language, those with the smallest hashes of their id, so that it
  does not grow with the corpus. The first `LANDMARKS` texts of the sample, dealt over the languages, are the landmarks;
  their kernel matrix gives the Nystroem map, in which one ridge regression per language is solved.
* Scoring: texts of an Arrow batch become a presence matrix; one product with the landmarks' matrix gives the kernels,
  one with the weights the scores. The largest score wins, held to 0 to 1; endless texts are read in slices, whose
  n-grams overlap.

The model (landmarks' bits, packed, and weights: under 1 MB) goes to the tasks with the function; its size depends on
the parameters and the number of languages alone.

Defined cases: a text that is null or has no letter is `und` with score 0; without a labelled text all texts are `und`;
ties go to the first language by name; repeated rows are scored alike; an empty table gives an empty table; rows with
null `doc_id` are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.shared import free_name, ready

NONE = "und"
LENGTHS = (1, 2, 3, 4)
SLOTS = 2048  # per length
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 192, 0.05
SLICE = 1 << 20
FOLDS = 5


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `FOLDS`; rows of fold 0 are held out."""
    return F.crc32(F.col(key).cast("string")) % FOLDS


def presence(text: str | None) -> np.ndarray | None:
    """Presence bits of a text's n-grams, or None without a letter."""
    if not text:
        return None
    bits, letters = np.zeros((len(LENGTHS), SLOTS), dtype=bool), False
    for at in range(0, len(text), SLICE):
        # an n-gram that crosses a slice's end is seen with the slice before it
        code = np.frombuffer(text[at:at + SLICE + LENGTHS[-1] - 1].lower().encode("utf-32-le"), dtype=np.uint32)
        known, back = np.unique(code, return_inverse=True)
        is_letter = np.array([chr(c).isalpha() for c in known.tolist()])[back]
        letters = letters or bool(is_letter.any())
        code = np.where(is_letter, code, 32).astype(np.uint64)
        value = np.zeros(len(code), np.uint64)
        for row, n in enumerate(LENGTHS):
            if len(code) < n:
                break
            value = value[:len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1:]
            mixed = value * np.uint64(0x9E3779B97F4A7C15)
            bits[row, (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)] = True
    return bits if letters else None


def unit_rows(bits: np.ndarray) -> np.ndarray:
    """Presence matrix (texts, lengths * slots) whose products are the blended kernel."""
    size = np.maximum(bits.sum(axis=2, keepdims=True), 1)
    scaled = bits / np.sqrt(size * len(LENGTHS), dtype=np.float32)
    return scaled.reshape(len(bits), -1).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits
    weights: np.ndarray  # (landmarks, languages): Nystroem map and ridge weights in one

    def matrix(self) -> np.ndarray:
        shape = (len(self.landmarks), len(LENGTHS), SLOTS)
        return unit_rows(np.unpackbits(self.landmarks, axis=1, count=len(LENGTHS) * SLOTS).reshape(shape).astype(bool))


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on the Nystroem features of the sample; `bits` comes dealt over the languages."""
    languages = sorted(set(labels))
    rows = unit_rows(bits)
    chosen = rows[:landmarks]
    values, vectors = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) * (values > 1e-6)
    features = (rows @ chosen.T).astype(np.float64) @ root
    target = np.array([[1.0 if label == c else 0.0 for c in languages] for label in labels])
    balance = 1 / np.sqrt(target.sum(axis=0))[target.argmax(axis=1), None]  # every language weighs the same
    weighted = features * balance
    inner = weighted.T @ weighted + ridge * np.eye(weighted.shape[1]) / max(1, len(languages))
    weights = root @ np.linalg.solve(inner, weighted.T @ (target * balance))
    packed = np.packbits(bits[:landmarks].reshape(len(chosen), -1), axis=1)
    return Model(languages, packed, weights.astype(np.float32))


def train(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on the sample; what reaches the driver is at most `per_language` rows of bits a language."""
    spark = ready(documents.sparkSession)
    usable = documents.where((fold(key) != 0) & F.col(label).isNotNull()).select(
        F.col(key).alias("k"), F.col(label).alias("label"), F.col(text).alias("text"))
    # ids with the smallest hashes: a threshold per language from its count lets a little more than the sample through
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not counts:
        return None
    place = F.shiftrightunsigned(F.xxhash64("k"), 2)
    bounds = F.create_map(*[x for c, n in counts.items() for x in (
        F.lit(c), F.lit(int(min(1.0, (per_language + 8 * per_language ** 0.5) / n) * 2**62)))])
    sampled = usable.where(place <= bounds[F.col("label")]).withColumn("place", place)
    width = len(LENGTHS) * SLOTS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if (b := presence(t)) is None else np.packbits(b.reshape(-1)).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["label", "place", "bits"])

    rows = sampled.select("text", "label", "place").mapInArrow(run, "label string, place long, bits binary").where("bits is not null").collect()
    by_label: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["place"], r["label"], bytes(r["bits"]))):
        own = by_label.setdefault(r["label"], [])
        if len(own) < per_language:
            own.append(bytes(r["bits"]))
    dealt = [(c, own[i]) for i in range(per_language) for c, own in sorted(by_label.items()) if i < len(own)]
    if not dealt:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(b for _, b in dealt), np.uint8).reshape(-1, width), axis=1)
    return fit(bits.reshape(len(dealt), len(LENGTHS), SLOTS).astype(bool), [c for c, _ in dealt])


def classified(documents: DataFrame, model: Model | None, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """`documents` with the predicted language and its score; only `text` is read for it."""
    ready(documents.sparkSession)
    place = documents.columns.index(text)
    schema = T.StructType([*documents.schema.fields, T.StructField(predicted, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = model.matrix().T if model is not None else None
        for batch in batches:
            names, scores = [NONE] * batch.num_rows, np.zeros(batch.num_rows)
            found = [presence(t) for t in batch.column(place).to_pylist()] if model is not None else []
            at = [i for i, b in enumerate(found) if b is not None]
            for part in range(0, len(at), 256):
                rows = at[part:part + 256]
                result = unit_rows(np.stack([found[i] for i in rows])) @ matrix @ model.weights
                best = result.argmax(axis=1)
                for i, k, value in zip(rows, best.tolist(), result[np.arange(len(rows)), best].tolist()):
                    names[i], scores[i] = model.languages[k], min(1.0, max(0.0, value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, predicted, score])

    return documents.mapInArrow(run, schema)


def predictions(documents: DataFrame) -> DataFrame:
    """Per row: whether it is held out, predicted language, score."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return classified(slim, train(documents)).drop("text")


def accepted(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """`documents` without those in which no language is recognised.

    Where nothing is labelled there is no model to reject by, and all documents with a letter stay. Null, empty and letterless
    texts go; repeated rows are judged each; an empty table stays empty; extra columns are carried along.
    """
    model = train(documents, text, label, key)
    if model is None:
        return documents.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    predicted, score = free_name(documents, "predicted_language"), free_name(documents, "language_score")
    found = classified(documents, model, text, predicted, score)
    return found.where((F.col(predicted) != NONE) & (F.col(score) > 0)).select(*documents.columns)
