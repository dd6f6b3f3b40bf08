"""Suffix-array dedup of repeated byte strings, exact over all documents.

A byte goes if a string of ``LENGTH`` (50) bytes that covers it also starts in a document of a smaller id.

Every window of 50 bytes has an anchor: its string of ``SEED`` bytes with the smallest hash, the leftmost of
equals. Equal windows have equal anchors at the same place. Neighbouring windows share an anchor; such a
run of windows, 50 to 80 bytes, is a *stretch*. So all that can be equal meets by the anchor's hash:

1. Each document's anchor hashes meet by hash. An anchor that stands in one document only is done with;
   in natural text that is most of them.
2. Documents with shared anchors give the stretches of these, which meet by anchor as bytes. Equal
   stretches need no more work: all but the smallest document lose all their windows. Where the same anchor
   has unequal stretches (the ends of repeats), the shard's stretches are sorted into a suffix array by
   induced sorting, and windows that share 50 bytes with a neighbour form groups with a smallest id.
3. Windows that are repeats go back to their documents, which cut them out.

Rows are blobs: a task sends one for each shard, compressed and free of what it could settle alone, so an
anchor or a stretch that a third of all documents hold reaches its shard once for each task, not once for
each document. Answers go back as blobs for buckets of documents, by the hash of the id; the texts are
dealt to buckets once, and that exchange is read by both passes. The numbers of shards and buckets follow
the corpus, so each stays at about ``SHARD_BYTES`` of text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.columns import as_kind, trimmed
from lexweave.llm.suffixarray import common_prefixes, suffix_array
from lexweave.session import table

LENGTH, SEED = 50, 20
SPAN = LENGTH - SEED + 1
LONGEST = LENGTH + SPAN - 1
SHARD_BYTES = 6_000_000
#: Texts are hashed together up to this many bytes (arrays stay in cache), and settled together up to UNIT_BYTES.
CHUNK_BYTES, UNIT_BYTES = 1 << 18, 24_000_000
_BITS = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)
_CODE = np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def seed_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes at every place of ``x`` where they fit."""
    h1 = _CODE[x]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    h = h16[:-4] * _power(4) + h4[16:]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def stretches(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, last window) of every stretch of texts that lie together in ``x`` and end at ``ends``."""
    none = np.empty(0, np.int64)
    if len(x) < LENGTH:
        return none.astype(np.uint64), none, none
    if len(x) > int(_LOW):  # places must fit the low bits: a very long text is cut where windows overlap
        out, step = [], int(_LOW) - 2 * LENGTH
        for a in range(0, len(x) - LENGTH + 1, step):
            part = x[a : a + step + LENGTH - 1]
            h, s, e = stretches(part, np.append(ends[(ends > a) & (ends < a + len(part))] - a, len(part)))
            out.append((h, s + a, e + a))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))
    h = seed_hashes(x)
    m = ((h >> _BITS) << _BITS) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])
    m = np.minimum(m[: -(SPAN - 16)], m[SPAN - 16 :])
    at = (m & _LOW).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inner = ends[:-1][:, None] - np.arange(1, LENGTH)  # windows that run over the end of a text
    inner = inner[(inner >= starts[:-1][:, None])]
    at[inner[inner < len(at)]] = -1
    cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
    first, last = cut[:-1], cut[1:] - 1
    real = at[first] >= 0
    first, last = first[real], last[real]
    return h[at[first]], first, last


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of rows (doc_id, text), up to UNIT_BYTES at a time."""
    ids, texts, held = [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = _data(text)
            if len(data) < LENGTH:
                continue
            ids.append(doc)
            texts.append(data)
            held += len(data)
            if held >= UNIT_BYTES:
                yield np.array(ids), texts
                ids, texts, held = [], [], 0
    if ids:
        yield np.array(ids), texts


def _data(text: pa.StringScalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield a, i
            a, size = i, 0
        size += len(t)
    yield a, len(texts)


def _found(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash, text number, first window, last window within the text) of all stretches of ``texts``."""
    out = []
    for a, b in _chunks(texts):
        part = texts[a:b]
        ends = np.cumsum([len(t) for t in part])
        h, first, last = stretches(np.frombuffer(b"".join(part), np.uint8), ends)
        n = np.searchsorted(ends, first, "right")
        base = np.concatenate([[0], ends[:-1]])[n]
        out.append((h, n + a, first - base, last - base))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _groups(sorted_: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values."""
    return np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]]) if len(sorted_) else np.zeros(1, np.int64)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def buckets_of(docs: np.ndarray, n: int) -> np.ndarray:
    """``pmod(xxhash64(doc_id), n)`` as Spark has it."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, k: int) -> np.ndarray:
        return (x << np.uint64(k)) | (x >> np.uint64(64 - k))

    h = (np.uint64(42 + 8) + five) ^ (turned(docs.astype(np.int64).view(np.uint64) * two, 31) * one)
    h = turned(h, 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))).view(np.int64) % n


def _zip(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _zip_ints(x: np.ndarray) -> bytes:
    """Longs as differences, which are small where the order is that of documents and places."""
    return _zip(np.diff(x, prepend=0).tobytes())


def _unzip(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in column.to_pylist()), kind)


def _unzip_ints(column: pa.ChunkedArray) -> np.ndarray:
    parts = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in column.to_pylist())
    return np.concatenate([np.empty(0, np.int64), *map(np.cumsum, parts)])


def _parts(key: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of sorted values."""
    cut = _groups(key).tolist()
    return [(int(key[x]), x, y) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _table(kind: pa.Schema, **cols: list) -> pa.Table:
    """Columns by name; nulls for those that are not given."""
    n = len(next(iter(cols.values())))
    return pa.table([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in kind], schema=kind)


#: ``part``: a shard, or past the shards a bucket whose answers only pass through.
ANCHORS = pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("h", pa.binary()), ("several", pa.binary())])
SHARED = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("h", pa.binary())])


def _dealt_anchors(doc: np.ndarray, h: np.ndarray, buckets: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """(bucket, documents, hashes) for the buckets of these documents."""
    own = buckets_of(doc, buckets)
    by = np.lexsort((doc, own))
    doc, h, parts = doc[by], h[by], _parts(own[by])
    return [k for k, _, _ in parts], [_zip_ints(doc[a:b]) for _, a, b in parts], [h[a:b].tobytes() for _, a, b in parts]


@trimmed
def _anchor_batches(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Anchors for their shards; those that several documents of a unit share are settled here."""
    for ids, texts in _units(batches):
        h, n, _, _ = _found(texts)
        doc = ids[n]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        cut = _groups(h)
        several = np.diff(cut) > 1
        first = cut[:-1]
        by = np.lexsort((doc[first], _shard(h[first], shards)))
        i, flags, parts = first[by], several[by], _parts(_shard(h[first[by]], shards))
        blobs = [[f(i[a:b], a, b) for _, a, b in parts] for f in (lambda j, *_: _zip_ints(doc[j]), lambda j, *_: h[j].tobytes(), lambda _, a, b: _zip(flags[a:b].tobytes()))]
        yield from _table(ANCHORS, part=[k for k, _, _ in parts], docs=blobs[0], h=blobs[1], several=blobs[2]).to_batches()
        inside = np.repeat(several, np.diff(cut))
        buckets, docs, hs = _dealt_anchors(doc[inside], h[inside], shards)
        yield from _table(ANCHORS, part=[shards + k for k in buckets], docs=docs, h=hs).to_batches()


def _shared_anchors(rows: pa.Table, shards: int) -> pa.Table:
    """A shard's anchors that more than one document holds, for the buckets of these documents."""
    part = rows.column("part")[0].as_py()
    if part >= shards:
        return _table(SHARED, bucket=[part - shards] * rows.num_rows, docs=rows.column("docs").to_pylist(), h=rows.column("h").to_pylist())
    h, doc, several = np.frombuffer(b"".join(rows.column("h").to_pylist()), np.uint64), _unzip_ints(rows.column("docs")), _unzip(rows.column("several"), bool)
    order = np.argsort(h, kind="stable")
    h, doc, several = h[order], doc[order], several[order]
    cut = _groups(h)
    shared = np.repeat((np.diff(cut) > 1) | np.logical_or.reduceat(several, cut[:-1]), np.diff(cut)) & ~several
    buckets, docs, hs = _dealt_anchors(doc[shared], h[shared], shards)
    return _table(SHARED, bucket=buckets, docs=docs, h=hs)


STRETCHES = pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("h", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary()), ("tags", pa.binary())])
REPEATED = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("places", pa.binary()), ("tags", pa.binary())])
CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _padded(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The strings of ``x`` as rows of LONGEST bytes, zeros behind."""
    x = np.concatenate([x, np.zeros(LONGEST, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(x, LONGEST)[starts]
    return np.where(np.arange(LONGEST) < sizes[:, None], rows, np.uint8(0))


def _same(h: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers by content: equal for rows of equal anchor, size and bytes, in order of the anchor's hash."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    key = h.copy()
    for k in range(words.shape[1]):
        key = (key ^ words[:, k]) * _MIX
        key ^= key >> np.uint64(32)
    order = np.lexsort((key, h))
    a, b = order[:-1], order[1:]
    new = np.ones(len(h), bool)
    new[1:] = (h[a] != h[b]) | (sizes[a] != sizes[b]) | (words[a] != words[b]).any(axis=1)
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _tags(ids: list[int], texts: list[bytes]) -> np.ndarray:
    """0 for a text that is the only one of its id; else a hash of the text, which tells it from the others."""
    several = Counter(ids)
    return np.array([xxhash.xxh3_64_intdigest(t) >> 1 | 1 if several[i] > 1 else 0 for i, t in zip(ids, texts, strict=True)], np.int64)


def _stretches(docs: pa.Table, shared: pa.Table, shards: int) -> pa.Table:
    """The stretches of a bucket's shared anchors; what a smaller id of the bucket repeats is settled here."""
    long = [(i, t) for i, t in zip(docs.column("doc_id").to_pylist(), map(_data, docs.column("text")), strict=True) if len(t) >= LENGTH]
    if not long or not shared.num_rows:
        return STRETCHES.empty_table()
    ids, texts = np.array([i for i, _ in long]), [t for _, t in long]
    tags = _tags(ids.tolist(), texts)
    h, n, first, last = _found(texts)
    keep = np.isin(_pair(ids[n], h), _pair(_unzip_ints(shared.column("docs")), np.frombuffer(b"".join(shared.column("h").to_pylist()), np.uint64)))
    h, n, first, last = h[keep], n[keep], first[keep], last[keep]
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sizes = last - first + LENGTH
    rows = _padded(np.frombuffer(b"".join(texts), np.uint8), base[n] + first, sizes)
    same, doc, tag = _same(h, rows, sizes), ids[n], tags[n]
    least = np.full(same.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    gone = doc > least[same]
    i = np.flatnonzero(~gone)
    own = _shard(h[i], shards)
    by = np.argsort(own, kind="stable")
    i, parts = i[by], _parts(own[by])
    out: list[list] = [[], [], [], [], [], [], []]
    for k, a, b in parts:
        j = i[a:b]
        inside = np.arange(LONGEST) < sizes[j][:, None]
        for col, v in zip(out, (k, _zip_ints(doc[j]), h[j].tobytes(), _zip_ints(first[j]), _zip(sizes[j].astype(np.uint8).tobytes()), _zip(rows[j][inside].tobytes()), _zip_ints(tag[j])), strict=True):
            col.append(v)
    buckets, runs, places, marks = _dealt_runs(doc[gone], tag[gone], first[gone], last[gone], shards)
    settled = _table(STRETCHES, part=[shards + k for k in buckets], docs=runs, places=places, tags=marks)
    return pa.concat_tables([_table(STRETCHES, **dict(zip(STRETCHES.names, out, strict=True))), settled])


def _pair(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of document and anchor; two that meet by chance only add a stretch that shares nothing."""
    x = (doc.view(np.uint64) + np.uint64(1)) * _MIX
    return h ^ x ^ (x >> np.uint64(29))


def _dealt_runs(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int) -> tuple[list[int], list[bytes], list[bytes], list[bytes]]:
    """(bucket, documents, pairs of first and last window, tags) for the buckets of these documents."""
    own = buckets_of(doc, buckets)
    by = np.lexsort((first, tag, doc, own))
    doc, tag, pairs, parts = doc[by], tag[by], np.column_stack([first[by], last[by]]), _parts(own[by])
    return [k for k, _, _ in parts], [_zip_ints(doc[a:b]) for _, a, b in parts], [_zip(pairs[a:b].tobytes()) for _, a, b in parts], [_zip_ints(tag[a:b]) for _, a, b in parts]


def _repeated_windows(rows: pa.Table, shards: int) -> pa.Table:
    """A shard's windows that a smaller id repeats, for the buckets of the documents that lose them."""
    part = rows.column("part")[0].as_py()
    if part >= shards:
        return _table(REPEATED, bucket=[part - shards] * rows.num_rows, docs=rows.column("docs").to_pylist(), places=rows.column("places").to_pylist(), tags=rows.column("tags").to_pylist())
    h = np.frombuffer(b"".join(rows.column("h").to_pylist()), np.uint64)
    doc, tag, first = (_unzip_ints(rows.column(c)) for c in ("docs", "tags", "places"))
    sizes, text = _unzip(rows.column("sizes"), np.uint8), _unzip(rows.column("bytes"), np.uint8)
    sizes = sizes.astype(np.int64)
    rows_ = _padded(text, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    same = _same(h, rows_, sizes)
    least = np.full(same.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    gone = doc > least[same]
    found = [(doc[gone], tag[gone], first[gone], first[gone] + sizes[gone] - LENGTH)]
    one = np.unique(same, return_index=True)[1]  # a stretch of each content, in order of the anchors
    cut = _groups(h[one])
    ends = np.repeat(np.diff(cut) > 1, np.diff(cut))
    if ends.any():
        one = one[ends]
        windows, row, at = _window_groups(rows_[one], sizes[one])
        smallest = np.full(windows.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, windows, least[same[one]][row])
        bad = smallest[windows] < least[same[one]][row]
        # windows that repeat, by content; every document that holds the content first loses them
        row, at = row[bad], at[bad]
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        begin = np.ones(len(row), bool)
        begin[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        i = np.flatnonzero(begin)
        a, b, content = at[i], at[np.append(i[1:], len(at)) - 1] if len(i) else at[i], same[one][row[i]]
        holders = np.flatnonzero(~gone & np.isin(same, content))
        holders = holders[np.argsort(same[holders], kind="stable")]
        low, high = np.searchsorted(same[holders], content, "left"), np.searchsorted(same[holders], content, "right")
        k = np.repeat(np.arange(len(content)), high - low)
        who = holders[np.arange(len(k)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[k]]
        found.append((doc[who], tag[who], first[who] + a[k], first[who] + b[k]))
    buckets, docs, places, marks = _dealt_runs(*(np.concatenate(z) for z in zip(*found, strict=True)), shards)
    return _table(REPEATED, bucket=buckets, docs=docs, places=places, tags=marks)


def _window_groups(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, row, place) of every window of LENGTH bytes of the rows; windows of a group are equal. By suffix array."""
    inside = np.arange(LONGEST) < sizes[:, None]
    width = sizes + 1
    begin = np.concatenate([[0], np.cumsum(width)[:-1]])
    s = np.zeros(int(width.sum()), np.int16)  # 0 between rows, bytes from 1
    row = np.repeat(np.arange(len(sizes)), width)
    at = np.arange(len(s)) - begin[row]
    s[at < sizes[row]] = rows[inside].astype(np.int16) + 1
    order = suffix_array(s)
    shared = common_prefixes(s, order, LENGTH)
    fits = at + LENGTH <= sizes[row]
    group = np.cumsum(shared[order] < LENGTH)
    use = fits[order]
    return group[use] - 1, row[order[use]], at[order[use]]


def _cut(docs: pa.Table, repeated: pa.Table) -> pa.Table:
    """The documents of a bucket without the windows that are repeats."""
    who, marks = _unzip_ints(repeated.column("docs")), _unzip_ints(repeated.column("tags"))
    runs = _unzip(repeated.column("places"), np.int64).reshape(-1, 2)
    order = np.argsort(who, kind="stable")
    who, marks, runs = who[order], marks[order], runs[order]
    out: list[list] = [[], [], [], []]
    ids, texts = docs.column("doc_id").to_pylist(), list(map(_data, docs.column("text")))
    long = [k for k, t in enumerate(texts) if len(t) >= LENGTH]
    tags = dict(zip(long, _tags([ids[k] for k in long], [texts[k] for k in long]).tolist(), strict=True))
    for k, (doc, data) in enumerate(zip(ids, texts, strict=True)):
        left, n, removed, spans = data, len(data), 0, 0
        own = runs[:0]
        if doc is not None and k in tags:
            a, b = np.searchsorted(who, doc, "left"), np.searchsorted(who, doc, "right")
            own = runs[a:b][marks[a:b] == tags[k]]
        if len(own):
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, own[:, 0], 1)
            np.add.at(step, own[:, 1] + LENGTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            removed = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        for col, v in zip(out, (n, removed, spans, left), strict=True):
            col.append(v)
    return pa.table([docs.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], schema=CUT)


@trimmed
def _whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _cut(pa.table(b), REPEATED.empty_table()).to_batches()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: the bytes that stay) for every row of ``docs``.

    Null texts are empty ones. Rows that repeat an id are equal in rank, whether their texts are equal or not:
    they do not remove each other's bytes, and each loses what it itself repeats. A row with a null id loses
    nothing and removes nothing. Other columns are not read. An empty table gives an empty result.
    """
    slim = docs.select(as_kind(docs, id_col, "doc_id", "bigint"), as_kind(docs, text_col, "text", "string"))
    named = slim.where("doc_id is not null")
    shards = max(1, -(-(named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // SHARD_BYTES))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(shards).cast("long")).alias("bucket")
    dealt = named.select("doc_id", "text", bucket).groupBy("bucket")
    anchors = named.mapInArrow(partial(_anchor_batches, shards=shards), "part long, docs binary, h binary, several binary")
    shared = anchors.groupBy("part").applyInArrow(_with(_shared_anchors, shards), "bucket long, docs binary, h binary")
    found = dealt.cogroup(shared.groupBy("bucket")).applyInArrow(_with(_stretches, shards), "part long, docs binary, h binary, places binary, sizes binary, bytes binary, tags binary")
    repeated = found.groupBy("part").applyInArrow(_with(_repeated_windows, shards), "bucket long, docs binary, places binary, tags binary")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    cut = dealt.cogroup(repeated.groupBy("bucket")).applyInArrow(_cut, out)
    return cut.unionByName(slim.where("doc_id is null").mapInArrow(_whole_batches, out))


def _with(f, shards: int):
    """``f`` with the number of shards; Spark counts the arguments of the function that it gets."""
    if f is _stretches:
        return lambda docs, shared: f(docs, shared, shards)
    return lambda rows: f(rows, shards)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of all of ``documents``."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
