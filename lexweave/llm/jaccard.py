"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands propose, the shingles decide.

``BANDS`` keys of ``ROWS`` minima each come from a text's distinct shingles. Texts that share a key are
compared with one of them, which every key draws for itself, so a large group costs a comparison for each
member and key and never all of its pairs. A pair links if its shingles, taken from the whole texts again,
reach ``SIMILARITY``. A pair at 0.8 shares some key with a chance of 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9999;
in groups of three or more it may link through others, or be missed where the drawn text is like neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.columns import trimmed
from lexweave.llm.simhash import shingle_hashes
from lexweave.operators.graph import connected_components
from lexweave.operators.skew import hot_join
from lexweave.session import durable

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Shingles that are hashed at once.
STEP = 2048
LANES = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def band_keys(text: str | None) -> list[int]:
    """The keys of a text; none without words."""
    hashes = shingles(text)
    if not len(hashes):
        return []
    least = np.full(len(LANES), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), STEP):
        least = np.minimum(least, (hashes[k : k + STEP, None] * LANES).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), n) - (1 << 63) for n, x in enumerate(least.reshape(BANDS, ROWS))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


@trimmed
def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = band_keys(text.as_py())
            ids += [doc] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "key"])


@trimmed
def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) to the pairs that link."""
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            near.append(similarity(shingles(x.as_py()), shingles(y.as_py())) >= SIMILARITY)
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def links(docs: DataFrame) -> DataFrame:
    """``a, b``: pairs of ids of ``docs`` (``doc_id, text``; ids are unique) whose texts link."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    keys = durable(slim.mapInArrow(_key_batches, "doc_id long, key long"))
    drawn = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "doc_id").alias("h"), "doc_id")).alias("first"), F.count("*").alias("n"))
    met = hot_join(keys, drawn.where("n > 1").select("key", F.col("first.doc_id").alias("other"), "n"), "key", "n").where("doc_id <> other")
    pairs = durable(met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct())
    first, second = (slim.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(_link_batches, "a long, b long")


def later_copies(docs: DataFrame, order: str) -> DataFrame:
    """``doc_id`` of the documents whose group, joined by links, holds one that comes before in ``order``, a column of ``docs``; ties by ``doc_id``.

    Null ids and texts without words are in no group. An empty table gives an empty result.
    """
    groups = durable(connected_components(links(docs)))
    members = durable(groups.join(docs.select(F.col("doc_id").alias("node"), F.col(order).alias("_order")), "node"))
    first = members.groupBy("component").agg(F.min(F.struct("_order", "node")).alias("first"))
    return members.join(first, "component").where("node <> first.node").select(F.col("node").alias("doc_id"))
