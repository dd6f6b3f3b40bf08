"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of its letters,
each permuted by its place; a text's vector bundles (adds) those of its trigrams; a language's prototype
bundles all of its training documents. A text gets the language whose prototype has the largest cosine.
Training adds vectors in the tasks and then by language and dimension, so the shuffle has one row for each
task, language and dimension and the driver gets one for each language and dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.columns import trimmed
from lexweave.session import table

DIMENSIONS = 512
#: Symbol 0 separates words; 1 to 26 are a-z; other letters share the rest by code point.
ALPHABET = 64
SEED = 42
UNKNOWN = "und"
FOLDS = 5


@cache
def _symbols() -> np.ndarray:
    """Symbol of every code point, in lower case; 0 if it is not a letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (ALPHABET - 27)
    return out


@cache
def _vectors() -> np.ndarray:
    """Vectors of all trigrams, as signs."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (ALPHABET, DIMENSIONS))
    a, b, c = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
    return (a[:, None, None, :] * b[None, :, None, :] * c[None, None, :, :]).reshape(ALPHABET**3, DIMENSIONS)


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the trigrams of a text's letters, its words apart by one separator; empty without letters."""
    x = _symbols()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not x.any():
        return np.empty(0, np.int64)
    x = np.concatenate([[0], x, [0]])
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])].astype(np.int64)
    return (x[:-2] * ALPHABET + x[1:-1]) * ALPHABET + x[2:]


@trimmed
def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(ALPHABET**3, np.int64)
            codes, n = np.unique(trigrams(text.as_py()), return_counts=True)
            counts[lang][codes] += n
    for lang, n in counts.items():
        used = np.flatnonzero(n)
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(used), 4096):
            part = used[at : at + 4096]
            total += n[part].astype(np.float64) @ _vectors()[part].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], ["lang", "at", "value"])


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and their prototypes as rows of length 1. Rows with a null language teach nothing."""
    slim = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = slim.mapInArrow(_train_batches, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        out[langs.index(r["lang"]), r["at"]] = r["value"]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    known = norms[:, 0] > 0
    return [x for x, k in zip(langs, known, strict=True) if k], out[known] / norms[known]


@trimmed
def _predict_batches(batches: Iterator[pa.RecordBatch], langs: list[str], prototypes: np.ndarray) -> Iterator[pa.RecordBatch]:
    prototypes = prototypes.astype(np.float32)
    for b in batches:
        preds, scores = [], []
        for text in b.column(1):
            codes, n = np.unique(trigrams(text.as_py()), return_counts=True)
            pred, score = UNKNOWN, 0.0
            if len(codes) and langs:
                v = np.zeros(DIMENSIONS, np.float32)
                for at in range(0, len(codes), 8192):
                    v += n[at : at + 8192].astype(np.float32) @ _vectors()[codes[at : at + 8192]].astype(np.float32)
                cosines = prototypes @ v / max(float(np.linalg.norm(v)), 1e-9)
                best = int(cosines.argmax())
                pred, score = langs[best], min(1.0, max(0.0, float(cosines[best])))
            preds.append(pred)
            scores.append(score)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; only the text is looked at.

    ``und`` with score 0 for a null text, one without letters, or if no language was learned. Ties go to
    the first language by name. Repeated rows and null ids each give a row.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(partial(_predict_batches, langs=langs, prototypes=prototypes), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction for all of ``documents``, learned from those outside the held-out fold. A null id is not held out, and its row teaches nothing."""
    docs = table(spark, sf_dir, "documents")

    def held(id_: str):
        return F.crc32(F.col(id_).cast("string")) % FOLDS == 0

    langs, prototypes = train(docs.where(~held("doc_id")))
    return identify(docs, langs, prototypes).select("doc_id", F.coalesce(held("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
