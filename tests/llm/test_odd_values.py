"""Values, not counts, on the odd table: nulls, empty and long texts, ties, repeated rows, rows that share an id, clashing names."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lexweave.llm import decontaminate, htmltext, language, linededup, quality, registry, secrets, simhash, substrings, tokens, toxicity
from lexweave.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark, odd):
    return [(r["doc_id"], r["text"]) for r in table(spark, odd, "documents").select("doc_id", "text").collect()]


def _same(got, want) -> None:
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_secrets(spark, odd, rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    want = []
    for doc, text in rows:
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))
        want.append((doc, *(sum(s[2] == n for s in spans) for n, _, _ in kinds), hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in spans).encode()).hexdigest()))
    got = secrets.query(spark, odd).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    _same(map(tuple, got), want)
    assert sum(w[1] for w in want) and sum(w[2] for w in want)


def test_simhash(spark, odd, rows):
    prints = []
    for _, text in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
        prints.append(sum(1 << k for k in range(64) if 2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > len(h)) if grams else 0)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in group}
    _same(map(tuple, simhash.query(spark, odd).collect()), [(d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)])


def test_substrings(spark, odd, rows):
    held = [(d, {t[k : k + 50] for k in range(len(t) - 49)}) for d, t in ((d, (x or "").encode()) for d, x in rows)]
    want = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        known = [h for d, h in held if doc is not None and d is not None and d < doc]
        for k in range(len(b) - 49):
            if any(b[k : k + 50] in h for h in known):
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    _same(map(tuple, substrings.query(spark, odd).collect()), want)


def test_quality(spark, odd, rows):
    want = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        under = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(under), len(words) < 20 or 100 * len(under) > 30 * len(words)))
    got = quality.query(spark, odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    _same([tuple(r)[:7] for r in got], want)
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_language_and_toxicity(spark, odd, rows):
    texts = {d: t for d, t in rows}
    for r in language.query(spark, odd).collect():
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or "")), r
        assert 0 <= r["score"] <= 1
    scores: dict = {}
    docs = table(spark, odd, "documents")
    for r in toxicity.score(docs, toxicity.train(docs, table(spark, odd, "labels"))).collect():
        assert scores.setdefault(frozenset(re.findall(r"[^\W\d_]+", (r["text"] or "").lower())), r["_p_toxic"]) == r["_p_toxic"]


def test_line_dedup(spark, odd, rows):
    first: dict[str, int] = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for _, _, c in linededup.chunks(text or ""):
            if linededup.multi_line(c):
                first.setdefault(c, doc)
    want = []
    for doc, text in rows:
        left, seen = [], set()
        for _, _, c in linededup.chunks(text or ""):
            if linededup.multi_line(c):
                if c in seen or (doc is not None and first[c] < doc):
                    continue
                seen.add(c)
            left.append(c)
        want.append((doc, None if text is None else "\n".join(left)))
    _same([(r["doc_id"], r["text"]) for r in linededup.dedup_lines(table(spark, odd, "documents")).collect()], want)


def test_decontamination(spark, odd, rows):
    items = sorted({(r["item_id"], r["text"]) for r in table(spark, odd, "benchmark").collect() if r["item_id"] is not None and r["text"]})
    want = []
    for doc, text in rows:
        own, best = decontaminate.WORD.findall((text or "").lower()), (0.0, None)
        for item, t in items:
            words = decontaminate.WORD.findall(t.lower())
            number: dict[str, int] = {}
            a, b = (np.array([number.setdefault(w, len(number) + 1) for w in x], np.int64) for x in (own, words))
            share = decontaminate.tiled(a, b) / len(words) if len(words) >= 5 and len(own) >= 5 else 0.0
            if share >= decontaminate.THRESHOLD and share > best[0]:
                best = (share, item)
        want.append((doc, best[0] > 0, best[0], best[1]))
    _same(map(tuple, decontaminate.query(spark, odd).collect()), want)


def test_pages(spark, odd):
    got = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in htmltext.query(spark, odd).collect()}
    article = "plain text without markup but long enough to be an article of its own"
    assert {(1, "u", "", 0), (2, None, "", 0), (None, "u", article, len(article)), (5, "u", "deep text here", 14), (5, "u", "a", 1)} <= got
    (broken,) = (g for g in got if g[0] == 3)
    assert broken[2].startswith("x < y")


def test_packing(spark, odd, rows):
    encode = tokens.encoder(tokens.public_tokenizers.path("byte_bpe_50k.json"))
    pieces = registry.QUERIES["op10_packing"](spark, odd).collect()
    want = Counter()
    for doc, text in rows:
        n = len(encode(text or "")) // 4 + 1
        want.update((doc, at, min(2048, n - at), n) for at in range(0, n, 2048))
    assert Counter((p["doc_id"], p["start"], p["length"], p["doc_tokens"]) for p in pieces) == want
    taken: dict[int, list[tuple[int, int]]] = {}
    for p in pieces:
        taken.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in taken.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
