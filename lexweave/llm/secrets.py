"""Secret scan: Aho-Corasick prefilter, anchored expressions near hits, embedded checksums.

One pass over the rows, no shuffle. Every text is read whole. A keyword automaton finds the
places where a keyword-led secret can begin; only there the anchored expressions are tried.
Vendor tokens that embed a CRC-32 (six base-62 digits over the thirty before them) count only if
the checksum agrees. Hex runs have no keyword and are matched directly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.columns import trimmed
from lexweave.session import table

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")
VENDOR = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VENDOR_KEYS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, keys in (("assign", ASSIGN_KEYS), ("access", ("akia",)), ("vendor", VENDOR_KEYS)):
        for k in keys:
            a.add_word(k, (kind, len(k)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """Lower case with every offset kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def scan(text: str | None, keys: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    if not text:
        return []
    past = {"assign": 0, "access": 0, "vendor": 0}
    for last, (kind, n) in keys.iter(lowered(text)):
        at = last - n + 1
        if at < past[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                past[kind] = m.end()
                if len(m[2]) >= MIN_VALUE:
                    found.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                past[kind] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    found.append((at, 1, m.end()))
        elif (m := VENDOR.match(text, at)) and checksum(m[1]) == m[2]:
            past[kind] = m.end()
            found.append((at, KINDS.index("npm" if text[at] == "n" else "github"), m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@trimmed
def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = automaton()
    for b in batches:
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py(), keys)] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, SPANS)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` for every row of ``docs``.

    Null and empty texts give no spans. Repeated rows and null ids each give a row of their own.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_scan_batches, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of all spans in ``documents``."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS))
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
