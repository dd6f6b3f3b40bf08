"""Toxicity by a chain of linear classifiers.

The chain's categories are predicted one after the other: ``junk`` (labelled of low quality), ``toxic_junk``
(both), ``toxic``. Each is a logistic model over hashed words, hashed beginnings of words, and the
probabilities of the categories before it; the last one gives the verdict. The models of later categories
are trained with out-of-fold probabilities of the earlier ones, so they see them as uncertain as they will
be; every model is then fitted on all rows for use. A model takes the features whose share differs between
the two classes by ``MIN_Z`` standard errors or more in the very rows that it is fitted on, so nothing of a
fold is known to the models that predict it. There is no limit to their number but that of the slots.

Only the fit is on a sample: ``MOST_LABELS`` labelled documents at most, those whose ids have the smallest
hashes. It bounds what reaches the driver; a chain has ``SLOTS`` weights a category at most. Documents are
read twice, once for the sample and once to be scored, whole, where they are read: none is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.columns import replaced, trimmed
from lexweave.session import table

CATEGORIES = ("junk", "toxic_junk", "toxic")
REJECTED = "toxic"
THRESHOLD = 0.3
MOST_LABELS, SLOTS, FOLDS = 10_000, 1 << 18, 4
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
MIN_Z, RIDGE, ROUNDS = 4.0, 0.5, 150
#: Features that are counted at once.
STEP = 1 << 20


class Slots(dict):
    """Slots of a word and of its beginnings, marked, which stand for inflected and compound forms; of those alone that ``telling`` has, if given.

    Kept for words that were seen; cleared when there are many.
    """

    MOST = 1 << 18

    def __init__(self, telling: np.ndarray | None = None) -> None:
        self.telling = None if telling is None else frozenset(telling.tolist())

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.MOST:
            self.clear()
        names = [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]
        slots = [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % SLOTS for x in names]
        self[word] = out = tuple(slots if self.telling is None else self.telling.intersection(slots))
        return out

    def of(self, text: str | None) -> np.ndarray:
        """The distinct slots of a text in lower case, in order."""
        words = set(WORD.findall((text or "").lower()))
        return np.array(sorted(set(chain.from_iterable(map(self.__getitem__, words)))), np.int32)


@dataclass
class Model:
    """Weights by slot, and those of the bias and of the categories before."""

    slots: np.ndarray
    weights: np.ndarray
    dense: np.ndarray


@dataclass
class Chain:
    """Fitted models, one for each category; none if nothing could be fitted."""

    models: list[Model] = field(default_factory=list)

    def telling(self) -> np.ndarray:
        return np.unique(np.concatenate([np.empty(0, np.int64), *(m.slots for m in self.models)]))

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities, a row for each array of slots and a column for each category; 0 without models."""
        out, dense = np.zeros((len(rows), len(CATEGORIES))), np.ones((len(rows), 1))
        if not rows:
            return out
        sizes = np.array([len(r) for r in rows])
        slots, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        for k, model in enumerate(self.models):
            weight = np.zeros(SLOTS)
            weight[model.slots] = model.weights
            out[:, k] = _sigmoid(np.bincount(row, weight[slots], len(rows)) + dense @ model.dense)
            dense = np.column_stack([dense, out[:, k]])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def counted(rows: np.ndarray, slots: np.ndarray, group: np.ndarray, groups: int, y: np.ndarray | None = None) -> np.ndarray:
    """Rows that hold each slot, by group of rows; of those with ``y``, if given."""
    out = np.zeros(groups * SLOTS, np.int64)
    for k in range(0, len(rows), STEP):
        row, slot = rows[k : k + STEP], slots[k : k + STEP]
        if y is not None:
            slot, row = slot[y[row] > 0], row[y[row] > 0]
        out += np.bincount(group[row] * SLOTS + slot, minlength=len(out))
    return out.reshape(groups, SLOTS)


def telling(held: np.ndarray, hits: np.ndarray, n: int, positive: int) -> np.ndarray:
    """Slots whose share of rows differs between the classes by MIN_Z standard errors; none if a class is empty.

    ``held, hits``: rows of each slot, and those of them in the class, of ``n`` and ``positive``.
    """
    if not 0 < positive < n:
        return np.empty(0, np.int64)
    share, gap = held / n, hits / positive - (held - hits) / (n - positive)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * n / (positive * (n - positive)))
    return np.flatnonzero((np.abs(gap) >= MIN_Z * error) & (held > 1))


def fit(rows: np.ndarray, slots: np.ndarray, chosen: np.ndarray, dense: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[Model, np.ndarray]:
    """Ridge logistic regression on the rows ``inside``, and its probabilities for all rows.

    By accelerated gradient steps, each weight at the step its own curvature allows. ``rows, slots``: the
    features of each row, of which ``chosen`` are used; ``dense``: the bias and the categories before.
    """
    number = np.full(SLOTS, -1, np.int64)
    number[chosen] = np.arange(len(chosen))
    kept: list[list[np.ndarray]] = [[], []]
    for k in range(0, len(rows), STEP):  # most features are not chosen
        col = number[slots[k : k + STEP]]
        kept[0].append(rows[k : k + STEP][col >= 0].astype(np.int64))
        kept[1].append(col[col >= 0])
    rows, cols, n_words, n = (*(np.concatenate([np.empty(0, np.int64), *x]) for x in kept), len(chosen), len(y))
    own = inside[rows]
    per_row = (np.bincount(rows, minlength=n) + dense.shape[1]) * inside
    curve = np.concatenate([np.bincount(cols[own], per_row[rows[own]], n_words), (dense**2 * per_row[:, None]).sum(0)]) / 4 + RIDGE
    w = z = np.zeros(n_words + dense.shape[1])
    t = 1.0
    for _ in range(ROUNDS):
        p = (_sigmoid(np.bincount(rows, z[cols], n) + dense @ z[n_words:]) - y) * inside
        g = np.concatenate([np.bincount(cols, p[rows], n_words), p @ dense]) + RIDGE * z
        new, later = z - g / curve, (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / later * (new - w), new, later
    return Model(chosen, w[:n_words], w[n_words:]), _sigmoid(np.bincount(rows, w[cols], n) + dense @ w[n_words:])


def fit_chain(sizes: np.ndarray, slots: np.ndarray, labels: np.ndarray) -> Chain:
    """``sizes, slots``: the number of slots of each row, and the slots one row after the other; ``labels``: a column of 0 and 1 for each category."""
    n = len(sizes)
    if not n:
        return Chain()
    rows = np.repeat(np.arange(n, dtype=np.int32), sizes)
    fold = np.arange(n) % FOLDS
    before, models = np.ones((n, 1)), []
    held = counted(rows, slots, fold, FOLDS)
    for k in range(labels.shape[1]):
        y, oof = labels[:, k].astype(float), np.zeros(n)
        hits = counted(rows, slots, fold, FOLDS, y)
        for f in range(FOLDS):
            inside = fold != f
            chosen = telling(held.sum(0) - held[f], hits.sum(0) - hits[f], int(inside.sum()), int(y[inside].sum()))
            oof[fold == f] = fit(rows, slots, chosen, before, y, inside)[1][fold == f]
        models.append(fit(rows, slots, telling(held.sum(0), hits.sum(0), n, int(y.sum())), before, y, np.ones(n, bool))[0])
        before = np.column_stack([before, oof])
    return Chain(models)


@trimmed
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = Slots()
    for b in batches:
        rows = [zstandard.compress(np.diff(slots.of(t.as_py()), prepend=0).astype("<u4").tobytes(), 3) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2), b.column(3)], ["doc_id", "slots", "quality", "toxic"])


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """A chain fitted on the sample.

    An id that is labelled more than once is toxic, or junk, if any of its labels says so. Labels with a null
    are not used. Rows that repeat an id and its features count once. A category without labels of both kinds
    has a model of a bias alone; without any labelled document the chain is empty and all scores are 0.
    """
    by_id = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    sample = by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality", "toxic")
    rows = slim.mapInArrow(_feature_batches, "doc_id long, slots binary, quality int, toxic int").toArrow()
    once = sorted(set(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "quality", "toxic", "slots")), strict=True)))
    del rows
    y = np.array([[q == 0, q == 0 and t == 1, t == 1] for _, q, t, _ in once], int).reshape(-1, len(CATEGORIES))
    # a stored row tells its size, so all rows are unpacked into one array
    sizes = np.array([zstandard.get_frame_parameters(x).content_size // 4 for _, _, _, x in once], np.int64)
    slots, at = np.empty(int(sizes.sum()), np.int32), 0
    for (_, _, _, x), n in zip(once, sizes.tolist(), strict=True):
        slots[at : at + n] = np.cumsum(np.frombuffer(zstandard.decompress(x), "<u4"))
        at += n
    once.clear()
    return fit_chain(sizes, slots, y)


@trimmed
def _score_batches(batches: Iterator[pa.RecordBatch], fitted: Chain) -> Iterator[pa.RecordBatch]:
    slots = Slots(fitted.telling())
    for b in batches:
        names = b.schema.names
        p = fitted.predict([slots.of(t.as_py()) for t in b.column(names.index("text"))])
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(len(CATEGORIES)))], [*names, *(f"_p_{c}" for c in CATEGORIES)])


def score(docs: DataFrame, fitted: Chain) -> DataFrame:
    """All rows and columns of ``docs`` (with ``text``) plus ``_p_junk, _p_toxic_junk, _p_toxic``.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores. Without a
    fitted chain all scores are 0. An empty table gives an empty result. Columns of ``docs`` that are named
    like a score are replaced by it.
    """
    out = replaced(docs, (f"_p_{c}" for c in CATEGORIES)).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(partial(_score_batches, fitted=fitted), schema + "".join(f", _p_{c} double" for c in CATEGORIES))


def rejected() -> Column:
    """The verdict on a scored row."""
    return F.col(f"_p_{REJECTED}") >= THRESHOLD


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdict for all of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", rejected().alias("toxic"), *[F.col(f"_p_{c}").alias(f"p_{c}") for c in CATEGORIES])
