"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (a blended spectrum of
several lengths) that both hold, over the root of the product of how many each
holds: a cosine of presence vectors. Nystroem landmarks span its feature space, and
one-versus-rest ridge regression in that space gives one decision function per
language. N-grams are hashed into ``DIM`` cells.

The kernel is linear in a text's presence vector, so landmarks and regression fold
into one matrix (cells by languages) and a batch of texts is scored by one product.

Learning takes about ``per_language`` texts of each language, fewer where they would be more
than 30,000 together (documented bounds; texts are chosen by the id's hash), as bit vectors. Null texts and texts without a letter are
``und`` with score 0. Rows are scored one by one, so repeated rows agree. Ties go to
the first language in code-point order. With nothing to learn from, all is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import append_columns, bounded_sample, fold, id_and_text, unused

BITS = 15
DIM = 1 << BITS
LENGTHS = (1, 2, 3, 4)
_GAPS = re.compile(r"[\W\d_]+")


def presence(text: bytes | None) -> np.ndarray | None:
    """The hashed n-grams of a text as a 0/1 vector; None without a letter. Case, digits and signs don't count."""
    if not text:
        return None
    plain = _GAPS.sub(" ", text.decode("utf-8", "replace").lower()).strip()
    # What is left beside letters are numbers such as ½ and ².
    if not plain or not plain.isascii() and not any(map(str.isalpha, plain)):
        return None
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32)
    seen = np.zeros(DIM, np.uint8)
    rolling = np.zeros(len(codes), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if n > len(codes):
            break
        rolling = rolling[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        if n in LENGTHS:
            mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA77)
            seen[mixed >> np.uint32(32 - BITS)] = 1
    return seen


def _unit(packed: np.ndarray) -> np.ndarray:
    """Presence vectors from bits, divided by their root length."""
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return x


def fit(packed: np.ndarray, labels: np.ndarray, languages: list, landmarks: int, ridge: float) -> np.ndarray:
    """Cells by languages: what a text's presence vector, divided by its root length, is multiplied with.

    ``packed`` has one row of bits per text; only the landmarks and a slice of the rest are unpacked at a time.
    """
    # Landmarks: the same number from each language, in sample order.
    rank = np.empty(len(labels), int)
    for k in range(len(languages)):
        rank[labels == k] = np.arange((labels == k).sum())
    marks = _unit(packed[np.lexsort((labels, rank))[:landmarks]])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    features = np.concatenate([_unit(packed[s : s + 64]) @ marks.T for s in range(0, len(packed), 64)]) @ whiten
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ target)
    return (marks.T @ (whiten @ weight).astype(np.float32)).astype(np.float32)


def identify(docs: DataFrame, training: DataFrame, *, text: str = "text", label: str = "lang", per_language: int = 600, landmarks: int = 256, ridge: float = 1.0, sharpness: float = 4.0) -> DataFrame:
    """Columns of ``docs`` plus lang_pred and score, with an underscore in front where ``docs`` has such a column. ``training`` has ``doc_id``, ``text`` and ``label``."""
    labelled = training.select("doc_id", "text", F.col(label).alias("label")).filter("text is not null and label is not null")
    sample = bounded_sample(labelled, "doc_id", "label", per_language, "langid")
    bits = T.StructField("bits", T.BinaryType())

    def make_bits():
        return lambda values: [pa.array([None if (p := presence(v)) is None else np.packbits(p).tobytes() for v in values], pa.binary())]

    rows = sorted((r.label, bytes(r.bits)) for r in append_columns(sample, "text", make_bits, [bits]).select("label", "bits").filter("bits is not null").collect())
    languages = sorted({r[0] for r in rows})
    weights = None
    if languages:
        packed = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
        weights = fit(packed, np.array([languages.index(r[0]) for r in rows]), languages, landmarks, ridge)
    held = docs.sparkSession.sparkContext.broadcast((languages, weights))

    def make():
        languages, weights = held.value

        def work(values, batch=128):
            names: list = ["und"] * len(values)
            scores = np.zeros(len(values))
            for s in range(0, len(values) if languages else 0, batch):
                part = [(s + i, p) for i, v in enumerate(values[s : s + batch]) if (p := presence(v)) is not None]
                if not part:
                    continue
                x = np.stack([p for _, p in part]).astype(np.float32)
                x /= np.sqrt(x.sum(1, keepdims=True))
                decision = sharpness * (x @ weights).astype(np.float64)
                odds = np.exp(decision - decision.max(1, keepdims=True))
                odds /= odds.sum(1, keepdims=True)
                for (i, _), row, best in zip(part, odds, decision.argmax(1), strict=True):
                    names[i], scores[i] = languages[best], row[best]
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return append_columns(docs, text, make, [T.StructField(unused(docs, "lang_pred"), T.StringType()), T.StructField(unused(docs, "score"), T.DoubleType())])


def predict_documents(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; the fold with remainder 2 of 4 is never learned from."""
    docs = id_and_text(documents)
    training = documents.select("doc_id", "text", "lang").filter(fold(F.col("doc_id"), 4) != 2)
    return identify(docs, training, **options).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
