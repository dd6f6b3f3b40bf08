"""Operators that SQL cannot express, held against plain Python over whole small tables."""

from __future__ import annotations

import hashlib
import html
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import decontaminate, htmltext, language, linededup, packing, quality, secrets, simhash, substrings, suffixarray, toxicity
from lexweave.operators.graph import connected_components
from lexweave.session import table


@pytest.fixture(scope="module")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet")


def test_secrets(spark, small, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    got = {r["doc_id"]: r for r in secrets.query(spark, small).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m))
        joined = ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]


def test_secret_checksums():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good, keys = "ghp_" + body + secrets.checksum(body), secrets.automaton()
    assert secrets.scan(f"x {good} y", keys) == [("github", 2, 2 + len(good))]
    assert secrets.scan("ghp_" + body + "000000", keys) == []
    assert [s[0] for s in secrets.scan("İİ TOKEN:abcdef", keys)] == ["assign"]
    assert secrets.scan("secrettoken=abcdef", keys)[0][1] == 6


def _print(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _components(n: int, links) -> list[int]:
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_simhash(spark, small, docs):
    docs = docs.sort_values("doc_id").reset_index(drop=True)
    prints = [_print(t) for t in docs.text]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    least = [int(docs.doc_id[k]) for k in _components(len(prints), near)]
    got = {r["doc_id"]: r for r in simhash.query(spark, small).collect()}
    assert [got[i]["fingerprint"] for i in docs.doc_id] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in docs.doc_id] == least


def test_simhash_links_in_groups_over_the_bound(spark):
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([rng.integers(0, 1 << 21, simhash.GROUP + 900), rng.integers(0, 1 << 62, 500)])).astype(np.uint64)
    x = np.unique(np.concatenate([x, x[-300:] ^ np.uint64((1 << 3) | (1 << 30) | (1 << 60)), x[-200:] ^ np.uint64(0b1111 << 40)]))
    links = [(int(i), int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3)]
    want = _components(len(x), links)
    prints = spark.createDataFrame(pd.DataFrame({"fp": x.view(np.int64)}))
    parts = {r["node"]: r["component"] for r in connected_components(simhash.links(prints)).collect()}
    got = [parts.get(int(v), int(v)) for v in x.view(np.int64)]
    assert len({(a, b) for a, b in zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_substrings(spark, small, docs):
    docs, seen, want = docs.sort_values("doc_id"), {}, {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        b = t.encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in substrings.query(spark, small).collect()} == want


def test_substrings_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(2)
    p, q, r = ("".join(map(chr, rng.integers(97, 123, 300))) for _ in range(3))
    rows = [(1, p), (2, "lead " + p), (2, q), (2, q), (3, q[100:] + r), (3, r + p[:80]), (3, ""), (None, p), (4, r[:49] + "é" + r[49:]), (5, None)]
    got = [tuple(x) for x in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = []
    for doc, text in rows:
        b = (text or "").encode()
        known = {o[k : k + 50] for d, t in rows if d is not None and doc is not None and d < doc for o in [(t or "").encode()] for k in range(len(o) - 49)}
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if b[k : k + 50] in known:
                gone[k : k + 50] = True
        want.append((doc, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("kind", ["few", "many", "periodic", "alternating"])
def test_suffix_array_of_long_texts(kind):
    rng = np.random.default_rng(4)
    s = {"few": rng.integers(0, 2, 20_000), "many": np.tile(rng.integers(0, 250, 4000), 5), "periodic": np.tile([1, 2, 0], 5000), "alternating": np.tile([1, 0], 6000)}[kind]
    raw = bytes(s.astype(np.uint8))
    assert suffixarray.suffix_array(s).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_buckets_are_those_of_spark(spark):
    ids = [0, 1, -1, 17, 1 << 62, -(1 << 63)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(97).cast("long"))).collect()]
    assert substrings.buckets_of(np.array(ids), 97).tolist() == got


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array(seed):
    s = np.random.default_rng(seed).integers(0, 1 + seed, 300)
    array = suffixarray.suffix_array(s)
    assert array.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    shared = suffixarray.common_prefixes(s, array, 12)
    for a, b in zip(array[:-1], array[1:], strict=True):
        n = next((k for k in range(12) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), 12)
        assert shared[b] == n


def test_quality(spark, small, docs):
    got = {r["doc_id"]: r for r in quality.query(spark, small).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        n, under = Counter(windows), set()
        for k, w in enumerate(windows):
            if n[w] > 1:
                under.update(range(k, k + 8))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 20 or 100 * len(under) > 30 * len(words)
        assert tuple(got[i][:7]) == (i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(under), failed)
        assert not (failed and got[i]["kept"])
    good = pd.read_parquet(f"{small}/labels.parquet").query("quality == 1").doc_id
    assert sum(got[i]["kept"] for i in good) >= 0.9 * sum(not got[i]["base_failed"] for i in good)


def test_quality_rejects_bad_labels_beside_copies(spark):
    rng = np.random.default_rng(3)
    clean, junk = [f"clean{i}" for i in range(300)], [f"junk{i}" for i in range(300)]
    copy = " ".join(f"copy{i}" for i in range(80))
    rows = []
    for i in range(600):
        kind = "copy" if i % 5 == 0 else "bad" if i % 5 == 1 else "good"
        words = rng.choice(clean, 80).tolist() if kind == "good" else rng.choice(clean, 56).tolist() + rng.choice(junk, 24).tolist()
        rows.append((i, copy if kind == "copy" else " ".join(rng.permutation(words)), kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    # half of the documents have labels; the others are judged as unseen
    got = quality.rate(docs, spark.createDataFrame([(i, int(k != "bad")) for i, _, k in rows if i % 2], "doc_id long, quality int"))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    for seen in (0, 1):
        assert sum(kept[i] for i, _, k in rows if k == "bad" and i % 2 == seen) <= 0.05 * 60
        assert sum(not kept[i] for i, _, k in rows if k != "bad" and i % 2 == seen) <= 0.05 * 240
    for one in (0, 1):
        got = quality.rate(docs, spark.createDataFrame([(i, one) for i, _, _ in rows], "doc_id long, quality int"))
        assert all(r["kept"] != r["base_failed"] for r in got.collect())


@pytest.mark.parametrize("seed", range(12))
def test_quality_threshold(seed):
    rng = np.random.default_rng(seed)
    good, bad = (Counter(np.round(rng.normal(m, 6, int(rng.integers(0, 400)))).astype(int).tolist()) for m in (seed, -seed))
    n, m = sum(good.values()), sum(bad.values())
    most, least = 0.0, -np.inf
    for cell in range(-60, 61):
        lost, caught = (sum(v for c, v in counts.items() if c < cell) for counts in (good, bad))
        if n and m and lost <= quality.GOOD_LOST * n and caught / m - lost / n > 0 and caught / m - lost / n >= most:
            most, least = caught / m - lost / n, cell * quality.GRID
    assert quality.threshold(good, bad) == least


def test_quality_scores_labels_without_their_fold(spark, small):
    labels = table(spark, small, "labels")
    base, sample = quality.rules(table(spark, small, "documents")).select("doc_id", "grams"), quality.trusted_sample(labels)
    every, held_out = quality.learn(base, sample)
    grams = {r["doc_id"]: r["grams"] for r in base.collect()}
    good = {r["doc_id"]: r["fold"] for r in sample.where("quality = 1").select("doc_id", quality._fold().alias("fold")).collect()}
    assert set(good.values()) == set(range(quality.FOLDS))
    raw = np.bincount(np.concatenate(list(grams.values())), minlength=quality.BUCKETS) + 1.0
    for fold in (None, *range(quality.FOLDS)):
        target = np.bincount(np.concatenate([grams[i] for i, f in good.items() if f != fold]), minlength=quality.BUCKETS) + 1.0
        got = every if fold is None else held_out[fold * quality.BUCKETS : (fold + 1) * quality.BUCKETS]
        assert np.allclose(got, np.log(target / target.sum()) - np.log(raw / raw.sum()))


def test_language_held_out(spark, small, docs):
    rows = language.query(spark, small).join(spark.createDataFrame(docs[["doc_id", "lang"]]), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rows = toxicity.score(docs.select("doc_id", "text"), chain).join(labels.where("doc_id % 2 = 1"), "doc_id").select(toxicity.rejected().alias("p"), "toxic").collect()
    hit = sum(r["p"] and r["toxic"] for r in rows)
    assert hit >= 0.8 * sum(r["toxic"] for r in rows)
    assert sum(r["p"] and not r["toxic"] for r in rows) <= 0.01 * len(rows)


def _line_chunks(text: str) -> list[tuple[str, bool]]:
    """(chunk, whether it may go) by the rule, a stretch of short lines at a time."""
    lines, spans, i = text.split("\n"), [], 0
    filled = [k for k, x in enumerate(lines) if x.strip()]
    while i < len(filled):
        if len(lines[filled[i]]) >= 80:
            spans.append((filled[i], filled[i], 2))
            i += 1
            continue
        stretch = []
        while i < len(filled) and len(lines[filled[i]]) < 80:
            stretch.append(filled[i])
            i += 1
        h, start, equal = [xxhash.xxh64_intdigest(lines[k].encode()) for k in stretch], 0, 0
        for k in range(len(stretch)):
            if 1 <= k < len(stretch) - 2:
                equal = equal + 1 if h[k] == h[k - 1] else 0
            if k == len(stretch) - 1 or (1 <= k < len(stretch) - 2 and (h[k - 1] > h[k] < h[k + 1] or equal % 2)):
                spans.append((stretch[start], stretch[k], k - start + 1))
                start = k + 1
    out, at = [], 0
    for a, b, n in spans:
        if at < a:
            out.append(("\n".join(lines[at:a]), False))
        out.append(("\n".join(lines[a : b + 1]), n >= 2))
        at = b + 1
    return [*out, ("\n".join(lines[at:]), False)] if at < len(lines) else out


def test_line_dedup(spark, small, docs):
    docs = docs.sort_values("doc_id")
    first: dict[str, int] = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        for c, may_go in _line_chunks(t):
            if may_go:
                first.setdefault(c, i)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table(spark, small, "documents")).collect()}
    gone = 0
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        left, seen = [], set()
        for c, may_go in _line_chunks(t):
            if may_go:
                if first[c] < i or c in seen:
                    gone += 1
                    continue
                seen.add(c)
            left.append(c)
        assert got[i] == "\n".join(left)
    assert gone


def test_line_chunks_survive_shifts():
    text = [f"line {i} of a longer text" for i in range(60)]
    a, b = ({c for _, _, c in linededup.chunks("\n".join(x))} for x in (text, ["new first line", *text]))
    assert len(a & b) >= 0.8 * len(a)


def _tiles(a: list[str], b: list[str]) -> int:
    """Words of ``b`` under a greedy tiling, the slow way."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if best < decontaminate.MIN_TILE:
            return covered
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                covered += best


def test_decontamination():
    rng = np.random.default_rng(3)
    item = [f"w{i}" for i in rng.integers(0, 30, 40)]
    block = decontaminate.Block([(7, " ".join(item))])
    for _ in range(20):
        cut = int(rng.integers(8, 32))
        doc = [f"x{i}" for i in rng.integers(0, 9, 20)] + item[cut:] + ["gap"] * int(rng.integers(0, 3)) + item[:cut] + [f"w{i}" for i in rng.integers(0, 30, 20)]
        (found,) = block.coverage(" ".join(doc), 0.1)
        assert found == (7, _tiles(doc, item) / len(item))


def test_tiling_of_few_words():
    rng = np.random.default_rng(1)
    for _ in range(150):
        few = int(rng.integers(1, 6))
        a, b = rng.integers(1, few + 1, int(rng.integers(1, 50))), rng.integers(1, few + 1, int(rng.integers(1, 35)))
        if rng.random() < 0.5:
            cut = int(rng.integers(0, len(a)))
            b = np.concatenate([b, a[cut : cut + 20]])
        assert decontaminate.tiled(a, b) == _tiles(a.tolist(), b.tolist())


def test_repetitive_texts_are_tiled_in_linear_time():
    block = decontaminate.Block([(1, "a " * 5000), (2, "a b " * 100)])
    began = time.perf_counter()
    assert list(block.coverage("a " * 500_000, 0.6)) == [(1, 1.0)]
    assert time.perf_counter() - began < 20


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 30)) for _ in range(30)]
    docs = [(i, " ".join(f"x{x}" for x in rng.integers(0, 50, 40)) + " " + t[: int(len(t) * cut)]) for i, (t, cut) in enumerate(zip(texts, rng.random(30), strict=True))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    whole = decontaminate.coverages(*frames).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1000)
    assert sorted(decontaminate.coverages(*frames).collect()) == sorted(whole)
    for i, text, item, share in whole:
        best = max((_tiles(text.split(), t.split()) / 30, -n) for n, t in enumerate(texts))
        assert (share, item) == ((best[0], -best[1]) if best[0] >= decontaminate.THRESHOLD else (0.0, None))


def test_leaks_are_found_and_nothing_else(spark, small, docs):
    items = pd.read_parquet(f"{small}/benchmark.parquet").text
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.query(spark, small).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert got[i] == any(x in t for x in items)


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>A&nbsp;headline &amp; more</h1></header><p>First  paragraph
    with <b>bold</b> text<br>and a break.</p><div class="share">Share this</div><p>Second &lt;one&gt;.</p><!-- no --><section class="comments"><p>Great post!</p></section></article>
    <aside>Related</aside><form>Mail <input></form><script>var a = "<p>x</p>";</script><footer>&copy; 2024</footer></body></html>"""
    assert htmltext.main_text(page) == "A headline & more\nFirst paragraph with bold text and a break.\nSecond <one>."
    assert htmltext.main_text(None) == ""


TEXT = "This is a long clear paragraph of an article about the history of bridges, with many words and details. " * 3
ARTICLE = f"<h1>Bridges</h1><p>{TEXT}</p><p>{TEXT}</p>"
PLAIN_ARTICLE = "\n".join(["Bridges", TEXT.strip(), TEXT.strip()])
NAV, FOOTER = "<nav><a href=x>Home</a> <a href=y>News</a></nav>", "<footer>Us</footer>"


@pytest.mark.parametrize(
    "body",
    [
        f"{NAV}<div class='content no-sidebar'>{ARTICLE}</div>{FOOTER}",
        f"<form id='aspnetForm'>{NAV}<div id='main'>{ARTICLE}</div></form>{FOOTER}",
        f"<form action='/x'>{ARTICLE}</form>{FOOTER}",
        f"{NAV}<div class='social-issues'>{ARTICLE}</div>{FOOTER}",
        f"{NAV}<article class='legal-analysis'>{ARTICLE}</article>{FOOTER}",
        f"{NAV}<div id='page-header-image-wrapper'>{ARTICLE}</div>{FOOTER}",
        f"{NAV}<article>{ARTICLE}</article><div class='responses'><div class='response'><p>{TEXT}</p></div><div><p>{TEXT * 3}</p></div></div>{FOOTER}",
        f"{NAV}<article>{ARTICLE}<section class='feedback'><p>{TEXT}</p></section></article>{FOOTER}",
        f"{NAV}<main>{ARTICLE}</main><div class='sidebar'><article><h3>Teaser</h3><p>A short teaser text</p></article></div>{FOOTER}",
        f"<header class='site-header'><p>A tagline of the site</p></header><article><header>{ARTICLE}</header></article><div class='related-stories'><p>Another story</p></div>{FOOTER}",
    ],
)
def test_html_of_odd_names(body):
    assert htmltext.main_text(f"<body>{body}</body>") == PLAIN_ARTICLE


def test_html_of_short_and_of_long_pages():
    assert htmltext.main_text("<div><h2>News</h2><p>Yes.</p></div>") == "News\nYes."
    began = time.perf_counter()
    text = htmltext.main_text("<body>" + "".join(f"<p>paragraph {i} {TEXT}</p>" if i % 3 else f"<p><a href=x>link {i}</a></p>" for i in range(100_000)))
    assert text.count("\n") > 60_000 and time.perf_counter() - began < 20


def test_html_of_all_pages(spark, small):
    """Word for word the articles of the pages, whose markup says where they are."""
    pages = {r["page_id"]: r["html"] for r in table(spark, small, "pages").collect()}
    for r in htmltext.query(spark, small).collect():
        page = pages[r["page_id"]]
        article = page[page.index("<article>") : page.rindex("</article>")]
        article = re.sub(r"<(script|style).*?</\1>|<!--.*?-->|<[^>]*>", " ", article, flags=re.DOTALL)
        assert html.unescape(article).split() == r["text"].split() and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("seed", range(50))
def test_minimum_cut(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(0, 2, 9).tolist()
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 9, 14), rng.integers(0, 9, 14), rng.random(14), strict=True) if a != b]

    def cost(x) -> float:
        return sum(max(0, s) * (not k) + max(0, -s) * k for s, k in zip(scores, x, strict=True)) + sum(w * (x[a] != x[b]) for a, b, w in edges)

    assert abs(cost(htmltext.minimum_cut(scores, edges)) - min(cost([m >> i & 1 == 1 for i in range(9)]) for m in range(512))) < 1e-6


def test_packing(spark, small, docs):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*e.ids, 1] for i, e in zip(docs.doc_id, t.encode_batch(docs.text.tolist(), add_special_tokens=False), strict=True)}
    pieces = packing.query(spark, small).toPandas()
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist() and g.length.sum() == len(ids[i])
        for a, n, crc in zip(g.start, g.length, g.ids_crc32, strict=True):
            assert crc == zlib.crc32(np.array(ids[i][a : a + n], "<u4").tobytes())
    assert set(pieces.doc_id) == set(docs.doc_id)
    used = defaultdict(int)
    for s, o, n in pieces.sort_values(["sequence_id", "offset"])[["sequence_id", "offset", "length"]].itertuples(index=False):
        assert o == used[s]
        used[s] += n
    assert max(used.values()) <= packing.SIZE
    assert sum(used.values()) >= 0.95 * packing.SIZE * len(used)


def test_packing_plan_uses_each_length_up():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 2049), 300, replace=False), rng.integers(1, 5000, 300), strict=True)}
    packs = packing.plan_packs(histogram)
    n = Counter()
    for pattern, count in packs:
        assert sum(pattern) <= packing.SIZE and count > 0
        for k in pattern:
            n[k] += count
    assert n == histogram and len(packs) <= 2 * packing.SIZE


def _first_of_groups(ids: list[int], linked) -> set[int]:
    """The smallest id of each group of ids that links connect."""
    left, first = sorted(ids), set()
    while left:
        at, *left = left
        first.add(at)
        front = [at]
        while front:
            one = front.pop()
            near = [x for x in left if linked(one, x)]
            front += near
            left = [x for x in left if x not in near]
    return first


def test_pipeline(spark, small, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    whole = table(spark, small, "documents")
    first = stages["toxicity"](spark, whole, small)
    labels = table(spark, small, "labels").where("toxic = 1").select("doc_id")
    assert first.columns == whole.columns
    assert first.join(labels, "doc_id").count() <= 0.5 * labels.join(whole, "doc_id").count()
    assert first.count() >= 0.85 * whole.count()

    text = dict(zip(docs.doc_id.tolist(), docs.text, strict=True))
    prints = {i: simhash.fingerprint(t) for i, t in text.items()}
    left = _first_of_groups(list(text), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 3)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text[i])) for i in left}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    left = _first_of_groups(list(left), lambda x, y: len(shingles[x] & shingles[y]) >= 0.8 * max(1, len(shingles[x] | shingles[y])))
    third = stages["simhash_dedup"](spark, whole, small)
    assert {r[0] for r in third.select("doc_id").collect()} == left

    items = [decontaminate.WORD.findall(t.lower()) for t in pd.read_parquet(f"{small}/benchmark.parquet").text]
    grams, number = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in items], defaultdict(lambda: len(number) + 1)
    leaked = set()
    for i, t in text.items():
        own = decontaminate.WORD.findall(t.lower())
        mine = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        if any(mine & g and decontaminate.tiled(np.array([number[w] for w in own]), np.array([number[w] for w in x])) >= 0.6 * len(x) for x, g in zip(items, grams, strict=True)):
            leaked.add(i)
    fourth = stages["decontamination"](spark, whole, small)
    assert leaked and {r[0] for r in fourth.select("doc_id").collect()} == set(text) - leaked

    last = corpus_pipeline.run(spark, small)
    assert last.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 0 < last.select("doc_id").distinct().count() < whole.count()
