"""Line dedup by content-defined chunks of lines.

Where a chunk ends depends on the lines next to that place alone, never on where the chunk began, so equal
passages are cut alike whatever stands around them. A line of ``LONG_CHARS`` or more is a chunk of its own;
a stretch of shorter lines is cut after lines whose hash is smaller than those of both neighbours; blank
lines between chunks stay out of them. A chunk of several lines, or of one long line, that also stands in a
document with a smaller id, or earlier in the same document, is removed; the first one stays. Of a passage
among other short lines up to a chunk at either end is left, and a short line between long ones.

1. Every document gives the names (128-bit hashes) of these chunks, once each: no text.
2. Texts are dealt by id once; both passes below read that one exchange. Documents that hold a name which
   others hold too give the bytes of those chunks. They are reduced to the least and the greatest bytes of a
   name, in the tasks before they move: a name stands for equal bytes if the two are the same.
3. A document loses the chunks that a smaller id holds, and its own repeats.

A name that a third of all documents hold is one row for each task in step 2; it meets the list of documents
through ``hot_join``. A name whose bytes differ (no such pair of texts is known) removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.columns import as_kind, replaced, trimmed
from lexweave.operators.skew import hot_join
from lexweave.session import durable, table

#: A line of so many characters is a chunk of its own; of shorter lines a chunk has MIN_LINES at least to be removed.
LONG_CHARS, MIN_LINES = 80, 2
#: Parts that the documents of one name are dealt to.
SALTS = 64
OWN = ("_lines", "_lost", "_gone", "_id")


def _ends(stretch: list[str]) -> list[int]:
    """Places in a stretch of short lines after which a chunk ends; both parts of a cut have two lines at least. Of equal lines every two make a chunk."""
    h = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in stretch]
    out, equal = [], 0
    for i in range(1, len(h) - 2):
        equal = equal + 1 if h[i] == h[i - 1] else 0
        if h[i - 1] > h[i] < h[i + 1] or equal % 2:
            out.append(i)
    return [*out, len(h) - 1]


def chunks(text: str) -> list[tuple[int, int, str]]:
    """(first line, line past the last, text) of the chunks that make up a text, in order. Blank lines inside a chunk belong to it; others are chunks of their own."""
    lines = text.split("\n")
    cuts, short = {0, len(lines)}, []

    def close() -> None:
        first = 0
        for k in _ends([lines[i] for i in short]) if short else ():
            cuts.update((short[first], short[k] + 1))
            first = k + 1
        short.clear()

    for i, line in enumerate(lines):
        if len(line) >= LONG_CHARS and line.strip():
            close()
            cuts.update((i, i + 1))
        elif line.strip():
            short.append(i)
    close()
    at = sorted(cuts)
    return [(a, b, "\n".join(lines[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]


def multi_line(text: str) -> bool:
    """Whether a chunk may be removed: it has several lines, or a long one, which counts as several."""
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) >= MIN_LINES or any(len(x) >= LONG_CHARS for x in lines)


def _bytes(chunk: str) -> bytes:
    return chunk.encode("utf-8", "surrogatepass")


def repeatable(text: str | None) -> dict[bytes, str]:
    """The distinct chunks of a text that may be removed, by name."""
    return {xxhash.xxh3_128_digest(_bytes(c)): c for _, _, c in chunks(text or "") if multi_line(c)}


@trimmed
def _name_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, names = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = repeatable(text.as_py())
            ids += [doc] * len(own)
            names += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary())], ["doc_id", "name"])


@trimmed
def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of the names in ``_names``, one of each content in a batch."""
    for b in batches:
        found = set()
        for text, wanted in zip(b.column("text"), b.column("_names"), strict=True):
            if wanted.is_valid:
                own = repeatable(text.as_py())
                found.update((n, own[n]) for n in wanted.as_py() if n in own)
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([_bytes(c) for _, c in found], pa.binary())], ["name", "chunk"])


def strip(text: str | None, gone: set[bytes]) -> tuple[str | None, int]:
    """``text`` without chunks of these names and without its own repeats, and the number of lines taken out."""
    left, seen, n = [], set(), 0
    for first, past, c in chunks(text or ""):
        if multi_line(c):
            if c in seen or (gone and xxhash.xxh3_128_digest(_bytes(c)) in gone):
                n += past - first
                continue
            seen.add(c)
        left.append(c)
    return ("\n".join(left) if n else text), n


@trimmed
def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` and ``_gone`` (names of chunks to remove) become ``text``, ``_lines`` and ``_lost``."""
    for b in batches:
        names = b.schema.names
        text_at, gone_at = names.index("text"), names.index("_gone")
        texts, lines, lost = [], [], []
        for text, gone in zip(b.column(text_at), b.column(gone_at), strict=True):
            text = text.as_py()
            lines.append(text.count("\n") + 1 if text else 0)
            text, n = strip(text, set(gone.as_py() or ()))
            texts.append(text)
            lost.append(n)
        cols = [pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(len(names)) if i != gone_at]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], [*(x for x in names if x != "_gone"), "_lines", "_lost"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` (``doc_id, text, ...``) without repeated chunks, plus ``_lines`` and ``_lost`` (lines before, lines removed).

    Null texts stay null. A row with a null id loses its own repeats only, and nothing is removed because
    of it. Rows that repeat an id count as one document: they do not remove each other's chunks. A document
    of removed chunks only keeps an empty text. An empty table gives an empty result. Columns of ``docs``
    that are named like a result are replaced by it.
    """
    docs = replaced(docs, OWN)
    docs = docs.select(*[as_kind(docs, c, c, {"doc_id": "bigint", "text": "string"}.get(c, docs.schema[c].dataType.simpleString())) for c in docs.columns])
    named, rest = docs.where("doc_id is not null"), docs.where("doc_id is null")
    held = durable(named.select("doc_id", "text").mapInArrow(_name_batches, "doc_id long, name binary"))
    shared = held.groupBy("name").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).where("first_id <> last_id")
    met = durable(hot_join(held, durable(shared.select("name", "first_id", "n")), "name", "n"))
    wanted = met.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("name").alias("_names"))
    # all columns and a left join, as below, so that both passes read one exchange of the texts
    found = named.join(wanted, F.col("doc_id") == F.col("_id"), "left").mapInArrow(_chunk_batches, "name binary, chunk binary")
    unlike = found.groupBy("name").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select("name", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = met.where("doc_id > first_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(unlike, ["name", "salt"], "left_anti").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("name").alias("_gone"))
    kept = named.join(gone, F.col("doc_id") == F.col("_id"), "left").drop("_id").unionByName(rest.withColumn("_gone", F.lit(None).cast("array<binary>")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_gone")
    return kept.mapInArrow(_strip_batches, f"{schema}, _lines long, _lost long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and digest of all of ``documents`` after line dedup."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_lost").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
