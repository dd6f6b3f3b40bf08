"""Benchmark decontamination by greedy string tiling.

A tile is a run of ``MIN_TILE`` (5) or more words that a document and a test item share; the longest tiles
are marked first and never overlap, in either text, so passages that come in another order still count.
An item has leaked if tiles cover ``THRESHOLD`` or more of its words.

Documents are read once for each block of the benchmark and never shuffled. A block has about
``BLOCK_CHARS`` characters, whatever the benchmark's size, so what the driver and a task hold is bounded;
where there are several, the documents and their verdicts so far are written before the next one is read.
Seeds are Karp-Rabin hashes of ``MIN_TILE`` words, joined with the block's sorted table of seeds; a document
is tiled against an item only if its seeds cover enough of the item, which no tiling can exceed. A text
that repeats itself costs no more than another one: places of equal windows are never paired.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.columns import replaced, trimmed
from lexweave.session import table, written

MIN_TILE, THRESHOLD = 5, 0.6
BLOCK_CHARS = 8_000_000
WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Words to numbers from 1; 0 for any other word."""

    def __missing__(self, word: str) -> int:
        return 0


def rolling(ids: np.ndarray, size: int = MIN_TILE) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` numbers, by doubling."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, width, out, done = ids.astype(np.uint64), 1, np.zeros(n, np.uint64), 0
    while done < size:
        if size & width:
            out = out * np.uint64(pow(int(BASE), width, 1 << 64)) + part[done : done + n]
            done += width
        if done < size:
            part = part[:-width] * np.uint64(pow(int(BASE), width, 1 << 64)) + part[width:]
            width *= 2
    return out


class Block:
    """The items of a block, by arrays: their words as numbers one after the other, and the places of their seeds in order of the seeds."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary = Vocabulary()
        self.ids: list[int] = []
        words: list[np.ndarray] = []
        for item, text in items:
            found = WORD.findall((text or "").lower())
            if len(found) >= MIN_TILE:
                words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
                self.ids.append(item)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate([np.empty(0, np.int64), *words])
        places = np.concatenate([np.empty(0, np.int64), *(np.arange(a, b - MIN_TILE + 1) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True))])
        seeds = rolling(self.words)[places] if len(places) else np.empty(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.places, seeds = places[order], seeds[order]
        first = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]])) if len(seeds) else np.empty(0, np.int64)
        self.seeds, self.bounds = seeds[first], np.append(first, len(seeds))

    def coverage(self, text: str | None, threshold: float) -> Iterator[tuple[int, float]]:
        """(item, share of its words under tiles) for the items that may reach the threshold."""
        ids = np.array(list(map(self.vocabulary.__getitem__, WORD.findall((text or "").lower()))), np.int64)
        if len(ids) < MIN_TILE or not len(self.seeds):
            return
        whole = np.convolve(ids == 0, np.ones(MIN_TILE, np.int64), "valid") == 0
        at = np.flatnonzero(whole)
        hashes = rolling(ids)[at]
        place = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = self.seeds[place] == hashes
        if not hit.any():
            return
        met = np.unique(place[hit])
        places = np.sort(np.concatenate([self.places[self.bounds[k] : self.bounds[k + 1]] for k in met]))
        # words of the items that seeds cover; no tiling covers more
        own = np.searchsorted(self.starts, places, "right") - 1
        under = np.minimum(np.append(np.diff(places), MIN_TILE), MIN_TILE)
        under[:-1][own[1:] != own[:-1]] = MIN_TILE
        bound = np.bincount(own, under, len(self.ids))
        hits = at[hit]
        for n in np.flatnonzero(bound >= threshold * self.sizes).tolist():
            item = self.words[self.starts[n] : self.starts[n + 1]]
            # what of the document lies under seeds of this item, runs apart
            use = np.isin(place[hit], np.unique(np.searchsorted(self.seeds, rolling(item))))
            inside = np.zeros(len(ids) + 1, np.int64)
            np.add.at(inside, hits[use], 1)
            np.add.at(inside, hits[use] + MIN_TILE, -1)
            kept = np.cumsum(inside[:-1]) > 0
            run = np.where(kept, ids, 0)[np.flatnonzero(kept | np.append(False, kept[:-1]))]
            yield self.ids[n], tiled(run, item) / len(item)


def _longest(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The length, up to ``most``, of the longest run of numbers above 0 that ``a`` and ``b`` share, and the hashes of windows of that length; 0 if below MIN_TILE."""

    def windows(x: np.ndarray, size: int) -> np.ndarray:
        """Hashes of windows; 0 for those over a number that is not above 0."""
        h, gaps = np.maximum(rolling(x, size), np.uint64(1)), np.concatenate([[0], np.cumsum(x <= 0)])
        return np.where(gaps[size:] == gaps[: len(gaps) - size], h, np.uint64(0))

    low, high, best = MIN_TILE, min(most, len(a), len(b)), (0, a[:0], b[:0])
    while low <= high:
        size = (low + high) // 2
        x, y = windows(a, size), windows(b, size)
        if np.isin(y[y != 0], x[x != 0]).any():
            best, low = (size, x, y), size + 1
        else:
            high = size - 1
    return best


def tiled(a: np.ndarray, b: np.ndarray) -> int:
    """Words of ``b`` under a greedy tiling with ``a``; numbers that are not above 0 match nothing.

    The longest match comes first; of equally long ones that which begins first in ``a``, then in ``b``. Each
    length is found by bisection over hashed windows and its matches are taken in one walk over the places, so
    the time is linear in the texts for a length, and lengths are fewer than the root of twice ``b``'s.
    """
    a, b, covered, most = a.copy(), b.copy(), 0, len(b)
    while True:
        size, x, y = _longest(a, b, most)
        if not size:
            return covered
        most = size
        both = np.intersect1d(x[x != 0], y[y != 0])
        waiting: dict[int, list[int]] = {}
        for j in np.flatnonzero(np.isin(y, both))[::-1].tolist():
            waiting.setdefault(int(y[j]), []).append(j)  # the first place is last in the list
        free, at = np.ones(len(b), bool), 0
        for i in np.flatnonzero(np.isin(x, both)).tolist():
            if i < at:
                continue
            places = waiting[int(x[i])]
            while places and not (free[places[-1]] and free[places[-1] + size - 1]):
                places.pop()  # partly under a tile of this length
            if places and (a[i : i + size] == b[places[-1] : places[-1] + size]).all():
                j = places.pop()
                free[j : j + size] = False
                a[i : i + size], b[j : j + size] = 0, 0
                covered, at = covered + size, i + size
        if at == 0:
            return covered  # hashes alone agreed


#: The block that a worker built last, by name.
_KEPT: dict[str, Block] = {}


@trimmed
def _tile_batches(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], name: str, threshold: float) -> Iterator[pa.RecordBatch]:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Block(items)
    block = _KEPT[name]
    for b in batches:
        names = b.schema.names
        best = list(zip(b.column(names.index("_item")).to_pylist(), b.column(names.index("_coverage")).to_pylist(), strict=True))
        for row, text in enumerate(b.column(names.index("text"))):
            for item, share in block.coverage(text.as_py(), threshold):
                old, most = best[row]
                if share > most or (share == most and share > 0 and (old is None or item < old)):
                    best[row] = (item, share)
        cols = {"_item": pa.array([x for x, _ in best], pa.int64()), "_coverage": pa.array([x for _, x in best], pa.float64())}
        yield pa.RecordBatch.from_arrays([cols.get(n, b.column(i)) for i, n in enumerate(names)], names)


def coverages(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_item, _coverage``: the item (``item_id, text``) that is covered most, ties to the smallest id.

    The coverage is 0 and the item null if no item can reach the threshold. Null and empty texts, and
    items of fewer than ``MIN_TILE`` words, match nothing. Items with a null id are ignored. An empty
    benchmark covers nothing; an empty table gives an empty result. Columns of ``docs`` that are named
    like a result are replaced by it.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-n // BLOCK_CHARS))
    out = replaced(docs, ("_item", "_coverage")).withColumn("text", F.col("text").cast("string")).withColumns({"_item": F.lit(None).cast("long"), "_coverage": F.lit(0.0)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for k in range(blocks):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()]
        out = out.mapInArrow(partial(_tile_batches, items=sorted(own), name=uuid.uuid4().hex, threshold=threshold), schema)
        if k < blocks - 1:  # a block is done with before the next one is read
            out = written(out, f"tiled-{k}")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked item that covers most, for all of ``documents``."""
    out = coverages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.col("_coverage") >= THRESHOLD).alias("contaminated"), F.col("_coverage").alias("coverage"), F.col("_item").alias("item_id"))
