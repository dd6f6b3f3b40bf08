"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link at ``RADIUS`` (3) or fewer differing bits. The 64 bits fall into three blocks. Of
three differing bits one block holds at least one, so without that block two bits differ at most: a
fingerprint emits, for each block left out, the other bits and all their variants at one bit, half of the
two that are left. Both of a linked pair then emit a common variant, and every pair that meets is
verified on all 64 bits. Copies fall together first: variants come from distinct fingerprints.

Rows of a variant are streamed in order of the variant. A group gives the edges of a spanning forest
of its links, never all of its pairs. A group of over ``GROUP`` fingerprints is dealt to blocks of
``GROUP``, and every pair of blocks is linked by a task of its own, so no group is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.columns import trimmed
from lexweave.operators.graph import connected_components
from lexweave.operators.skew import hot_join
from lexweave.session import durable, shuffle_partitions, table

SEED, SHINGLE, RADIUS = 42, 3, 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
GROUP = 4096


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: -size].tolist(), (starts[size:] - 1).tolist(), strict=True)]


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint; 0 for a text without words."""
    hashes = np.array(shingle_hashes(text), "<u8")
    if not len(hashes):
        return 0
    set_ = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<u8")[0])


@trimmed
def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


@trimmed
def _mark_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns and the fingerprint of ``text``."""
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints.view(np.int64))], [*b.schema.names, "_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_print_batches, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(prints: DataFrame) -> DataFrame:
    """``key, fp``: the variants of every distinct ``fp``. The block left out holds its number, so keys of different blocks seldom meet."""
    keys = []
    for n, (low, high) in enumerate(BLOCKS):
        out = ((1 << high) - 1) ^ ((1 << low) - 1)
        flips = [0, *(1 << k for k in range(64) if not low <= k < high)]
        rest = F.col("fp").bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ out)))
        keys += [rest.bitwiseXOR(F.lit(_signed(flip ^ ((n + 1) << low)))) for flip in flips]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among ``prints`` (unsigned, distinct)."""
    a, b, left = [], [], prints
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= RADIUS
            if near.any():
                hits, left = left[near], left[~near]
                a.append(np.full(len(hits), at, np.uint64))
                b.append(hits)
                front.extend(hits)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


@trimmed
def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in order of key to edges (a, b, null); members of groups that are too large to rows (fp, null, key)."""

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

    def large(key: int, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.nulls(len(prints), pa.int64()), pa.array(np.full(len(prints), key, np.int64))], ["a", "b", "key"])

    def linked(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All groups of these rows are whole."""
        cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        n = np.diff(cut)
        two = cut[:-1][n == 2]
        x, y = prints[two], prints[two + 1]
        near = np.bitwise_count(x ^ y) <= RADIUS
        found = [(x[near], y[near])]
        for i in np.flatnonzero(n > 2):
            group = prints[cut[i] : cut[i + 1]]
            if len(group) > GROUP:
                yield large(keys[cut[i]], group)
            else:
                found.append(forest(group))
        a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        if len(a):
            yield rows(a, b)

    held_k, held_f, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if over is not None:  # the rest of a group that has been passed on already
            more = np.searchsorted(keys, over, "right")
            if more:
                yield large(over, prints[:more])
            keys, prints = keys[more:], prints[more:]
            if not len(keys):
                continue
            over = None
        keys, prints = np.concatenate([held_k, keys]), np.concatenate([held_f, prints])
        if not len(keys):
            continue
        last = np.searchsorted(keys, keys[-1], "left")
        if last:
            yield from linked(keys[:last], prints[:last])
        held_k, held_f = keys[last:], prints[last:]
        if len(held_k) > GROUP:
            over = int(held_k[0])
            yield large(over, held_f)
            held_k, held_f = held_k[:0], held_f[:0]
    if len(held_k):
        yield from linked(held_k, held_f)


def _link_blocks(rows: pa.Table) -> pa.Table:
    a, b = forest(np.unique(rows.column("a").to_numpy().view(np.uint64)))
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: edges that connect all distinct ``fp`` which links connect."""
    spread = prints.select("fp").repartition(shuffle_partitions(prints.sparkSession), "fp")  # few rows, each of which becomes 131
    near = variants(spread).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_batches, "a long, b long, key long")
    near = durable(near.distinct())
    large = near.where("key is not null")
    n_blocks = large.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("n"))
    dealt = large.select("key", "a").join(n_blocks, "key").withColumn("own", F.pmod(F.xxhash64("a"), F.col("n")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.select("key", "a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    more = dealt.groupBy("key", "i", "j").applyInArrow(_link_blocks, "a long, b long")
    return near.where("key is null").select("a", "b").unionByName(more).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``; the component is the smallest id that links reach.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows give a row each. A null
    id is never a component unless its group has no other id. Other columns are not read. An empty table
    gives an empty result.
    """
    prints = durable(fingerprints(docs, id_col, text_col))
    return hot_join(prints, components(prints).select("fp", F.col("first.doc_id").alias("component_id"), "n"), "fp", "n").select("doc_id", "fp", "component_id")


def components(prints: DataFrame) -> DataFrame:
    """For every distinct fingerprint of ``prints`` (``doc_id, fp``): ``fp, n`` (its rows) and ``first``, the struct ``doc_id, fp`` that is smallest in its component."""
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    parts = connected_components(links(distinct))
    named = durable(distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "n", "doc_id", F.coalesce("component", "fp").alias("part")))
    first = named.where("doc_id is not null").groupBy("part").agg(F.min(F.struct("doc_id", "fp")).alias("first"))
    return named.join(first, "part", "left").select("fp", "n", "first")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id, one for each group of near-duplicates: that of the smallest id.

    Rows that share an id but are no near-duplicates all stay. Of rows with the smallest id in one group that
    of the smallest fingerprint stays, then that of the smallest text. Rows without an id are left out.
    ``docs`` has ``doc_id`` and ``text``.
    """
    first = components(durable(fingerprints(docs.where("doc_id is not null")))).where("fp = first.fp").select(F.col("first.doc_id").alias("_id"), F.col("fp").alias("_fp"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = docs.where("doc_id is not null").mapInArrow(_mark_batches, f"{schema}, _fp long")
    marked = marked.withColumn("_id", F.col("doc_id").cast("long")).join(first, ["_id", "_fp"], "left_semi")
    one = Window.partitionBy("_id", "_fp").orderBy("text")
    return marked.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_id", "_fp", "_nth")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
