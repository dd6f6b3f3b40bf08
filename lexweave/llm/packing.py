"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

1. One pass tokenizes every whole text and cuts it: full sequences first, then the rest. Ids stay in
   that pass; a piece carries their CRC-32 only, so the shuffles below move numbers, not tokens.
2. The histogram has one row per length (at most ``size`` rows, whatever the corpus). The driver places
   lengths longest first into the pack with the most room and only updates the counts of patterns.
   Every step makes one new pattern at most and uses up a length or a pattern, so there are fewer than
   twice ``size`` patterns and their table, the one thing that is broadcast, is bounded by ``size`` alone.
3. Pieces meet patterns by rank within their length. Each length has as many buckets, by the hash of the
   id, as its count asks for, so that a length that a third of all rows share is ranked by many tasks;
   the buckets' first ranks are prefix sums in two levels.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.columns import trimmed
from lexweave.llm.tokens import encoder
from lexweave.session import durable, table

SIZE = 2048
END = (1).to_bytes(4, "little")
PIECES_A_BUCKET, BUCKETS_A_GROUP = 256, 4096
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
TOKENIZER = "byte_bpe_50k.json"


@trimmed
def _cut_batches(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            tokens = encode(text.as_py() or "") + END
            n = len(tokens) // 4
            for at in range(0, n, size):
                length = min(size, n - at)
                for col, v in zip(out, (doc, at, length, zlib.crc32(tokens[4 * at : 4 * (at + length)]), n), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def plan_packs(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, its count), from shortest-pack-first over ``histogram``.

    Lengths must be 1 to ``size``. The order is deterministic. The sum over patterns of count times
    copies of a length is that length's count.
    """
    room: dict[int, list[list]] = defaultdict(list)  # by room left: [pattern, count], last in first out
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, list]] = []
        space = size
        while left:
            while space >= length and not room[space]:
                space -= 1
            if space < length:
                fit = size // length  # only equal lengths are left to share a new pack with
                full, rest = divmod(left, fit)
                for copies, count in ((fit, full), (rest, 1 if rest else 0)):
                    if count:
                        placed.append((size - copies * length, [(length,) * copies, count]))
                break
            pattern, count = room[space].pop()
            copies = 1
            use = min(left, count)
            if use < count:
                room[space].append([pattern, count - use])
            placed.append((space - length, [pattern + (length,) * copies, use]))
            left -= use * copies
        for space, entry in placed:
            room[space].append(entry)
    return [(p, c) for space in sorted(room) for p, c in room[space]]


def segments(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank past the last, copies in a pattern, first sequence, offset)."""
    used: Counter = Counter()
    rows, base = [], 0
    for pattern, count in packs:
        at = 0
        for length, copies in Counter(pattern).items():
            rows.append((length, used[length], used[length] + copies * count, copies, base, at))
            used[length] += copies * count
            at += copies * length
        base += count
    return rows


def cut_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens`` of every row; a null text is an empty one (its end id only)."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(partial(_cut_batches, path=path, size=size), PIECE_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every row of ``docs``: its pieces plus ``sequence_id, offset``.

    Null ids and repeated rows are packed like any other row. Ties in rank are broken by id, start and
    CRC; rows equal in all of these are interchangeable. An empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    pieces = durable(cut_documents(docs, tokenizer, size, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table_ = spark.createDataFrame(segments(plan_packs(histogram, size)), "seg_length long, lo long, hi long, copies long, base long, at long")
    buckets = spark.createDataFrame([(k, -(-n // PIECES_A_BUCKET)) for k, n in histogram.items()], "length long, buckets long")
    pieces = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.col("buckets"))).drop("buckets")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("bucket") / BUCKETS_A_GROUP))
    groups = counts.groupBy("length", "group").agg(F.sum("n").alias("n"))

    def before(by: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = groups.select("length", "group", before(["length"], "group").alias("past"))
    first = counts.select("length", "group", "bucket", before(["length", "group"], "bucket").alias("first")).join(groups, ["length", "group"]).select("length", "bucket", (F.col("first") + F.col("past")).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(own) - 1).join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("nth"))
    met = ranked.join(F.broadcast(table_), (F.col("length") == F.col("seg_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    into = F.col("rank") - F.col("lo")
    return met.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(into / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + into % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, packed."""
    return pack_documents(table(spark, sf_dir, "documents"))
