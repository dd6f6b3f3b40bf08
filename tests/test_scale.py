"""Steps whose cost must grow with the input: what they move, and the same results as the plain rule."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from lexweave.functions import english
from lexweave.operators import analysis, kb, learn, names, neardup, ngrams, sentences, values
from lexweave.plans import patterns


def _bag(text: str) -> Counter:
    w = ["", "", *text.split()]
    return Counter(zip(w, w[1:], w[2:], strict=False))


def test_near_duplicates_write_one_row_a_document_and_deal_groups_to_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    origin = [[rnd.choice(words) for _ in range(n)] for n in (30, 150, 150, 260)] + [["again"] * 120]
    rows = []
    for k in range(90):
        own = list(origin[k % 5])
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        rows.append((k * 7 + 3, " ".join(own + own[: rnd.randrange(30)])))
    rows += [(1001, None), (1002, " "), (1003, rows[0][1])]
    tables = {}

    def spied(df, name):
        tables[name] = out = written(df, name)
        return out

    written = neardup.written
    monkeypatch.setattr(neardup, "written", spied)
    for name, n in (("ELEMENTS", 2000), ("BLOCK", 900), ("FEW", 10)):
        monkeypatch.setattr(neardup, name, n, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in neardup.containment_pairs(docs).collect()}
    monkeypatch.setattr(neardup, "FEW", 95, raising=False)  # documents may be broadcast, but not their places in blocks
    again = {(r["a"], r["b"]): round(r["score"], 9) for r in neardup.containment_pairs(docs).collect()}
    first = {}
    for i, t in rows:
        if t and t.strip():
            first[t] = min(i, first.get(t, i))
    bags = {i: _bag(t) for t, i in first.items()}
    want = {}
    for a, x in bags.items():
        for b, y in bags.items():
            n, m = x.total(), y.total()
            if a != b and n >= 0.5 * m and (n < m or (n == m and a < b)) and (x & y).total() / n >= 0.8:
                want[a, b] = round((x & y).total() / n, 9)
    assert got == again == want and len(want) > 300
    assert tables["bags"].count() == len(bags)


def test_alias_pairs_are_dealt_to_all_cores(spark, small):
    out = __spark_entry__.queries()["alias_self_join"](spark, small)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_close_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("xy"), rnd.choice([None, *range(9)])) for i in range(80)]
    got = kb.close_pairs(spark.createDataFrame(rows, "id long, g string, z int"), ["g"], "z", 2)
    want = {(i, j, abs(z - v)) for i, g, z in rows for j, h, v in rows if i < j and g == h and z is not None and v is not None and abs(z - v) <= 2}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_dictionary_matches_are_not_broadcast(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [(i % 50 if i else None, " ".join(rnd.choice("abc") for _ in range(9))) for i in range(60)]
    terms = [("a", 1), ("a b", 1), ("b a", 2), ("c c b", 1), ("b", 3), ("b", 1), ("c a c", 3)]
    found = []
    for i, text in texts:
        w = text.split()
        found += [(i, s, n, t, p) for t, p in {t: max(q for u, q in terms if u == t) for t, _ in terms}.items() for n in (len(t.split()),) for s in range(len(w) - n + 1) if w[s : s + n] == t.split()]
    rank = lambda m: (-m[4], -m[2], m[1], m[3])
    want = [m for m in found if m[0] is None or not any(o[0] == m[0] and o[1] < m[1] + m[2] and o[1] + o[2] > m[1] and rank(o) < rank(m) for o in found)]
    for few in (100, 2):
        monkeypatch.setattr(sentences, "FEW", few, raising=False)
        out = names.best_matches(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "term string, priority int"), 3)
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
        assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= (few == 100) * 2  # final and first plan


def test_rare_words_with_line_separators_like_their_sql(spark, tmp_path):
    text = " ".join(w + end for w in ("12", "1234", "AB", "ab", "A.", "Ab", "1") for end in ("", "\u0085", "\u2028", "\u2029", "\u000b", "\u2028x"))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = __spark_entry__.queries()["rare_words"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(__spark_entry__.oracle_sql()["rare_words"]).fetchall())


def test_tags_of_a_batch_are_those_of_each_sentence(spark):
    rnd = random.Random(6)
    pool = ["Ab", "ab", "x1", "Zed", "the", "12", *(f"w{i}" for i in range(20))]
    rows = [(i, 0, [rnd.choice(pool) for _ in range(rnd.randrange(12))]) for i in range(90)] + [(90, 0, None)]
    tagger = learn.train_tagger([(t, [rnd.choice(["O", "NAME", "NUM"]) for _ in t]) for _, _, t in rows[:40] if t], 2)
    tagger.weights = {k: float(round(v)) for k, v in tagger.weights.items()}  # ties
    out = learn.tagged(spark.createDataFrame(rows, "doc_id int, sent_no int, tokens array<string>"), tagger)
    want = {i: None if t is None else tagger.best(t)[0][1] for i, _, t in rows}
    assert {r["doc_id"]: r["tags"] for r in out.collect()} == want
    runs = []
    for i, tags in want.items():
        for k, t in enumerate(tags or []):
            if t != "O" and k and tags[k - 1] == t:
                runs[-1] = (*runs[-1][:4], k)
            elif t != "O":
                runs.append((i, 0, t, k, k))
    spans = learn.spans_of_tags(out)
    assert sorted(map(tuple, spans.select("doc_id", "sent_no", "type", "start", "end").collect())) == sorted(runs)
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()


def test_prose_and_tokens_take_time_in_proportion():
    t = time.monotonic()
    english.prose_regions("word , " * 8000)  # no stretch, and each start looked at all the rest
    assert english.english_tokens("word " * 80000 + "'' \"")[:2] == ["word", "word"]
    assert time.monotonic() - t < 2


def test_prose_regions_by_the_rule():
    rnd = random.Random(7)
    for _ in range(300):
        text = "".join(rnd.choice(["word", "a", "%", "x1", "\n", "12,3", "(b)", "\t"]) + " " for _ in range(rnd.randrange(80)))
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        bad = [english.is_junk(text[a:b]) or english._alone(text, a, b) for a, b in spans]
        find = english._last_junk(bad)
        for start in (i for i, x in enumerate(bad) if x):
            end = start
            for i in range(start, len(bad)):
                window = bad[max(start, i - 19) : i + 1]
                if sum(window) / len(window) < 0.5:
                    end = start if i - start < 4 else end
                    break
                end = i
            while end > start and not (bad[end] and bad[end - 1]):
                end -= 1
            assert find(start) == (end if end - start >= 4 else -1)


def test_words_are_cut_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for out in (ngrams.words(docs, lines=True), ngrams.bigrams(ngrams.words(docs, lines=True))):
        assert out._jdf.queryExecution().executedPlan().toString().count("split(t#") <= 1
        assert "filter(" not in out._jdf.queryExecution().executedPlan().toString()
    rows = [(1, "a  b,\n\n. \nC"), (2, None), (3, " "), (4, "")]
    cut = ngrams.words(spark.createDataFrame(rows, "doc_id long, text string"), lines=True)
    assert sorted((r["sent_no"], *r["words"]) for r in cut.collect()) == [(0, "a", "b"), (3, "c")]
    pairs = [("---NULL---", "a"), ("---NULL---", "c"), ("a", "b"), ("b", "---NULL---"), ("c", "---NULL---")]
    assert sorted(map(tuple, ngrams.bigrams(cut).collect())) == pairs


def test_times_are_attached_without_pairs(spark):
    rnd = random.Random(8)
    some = lambda n: rnd.choice([None, *range(n)])
    relations = [(some(3), some(2), k, some(9)) for k in range(60)]
    times = [(some(3), some(2), rnd.choice([None, *range(0, 9, 2)]), k) for k in range(30)]
    want = []
    for d, s, k, at in relations:
        met = [(t is None or at is None, abs(t - at) if None not in (t, at) else 0, t is None, t or 0, i) for e, v, t, i in times if None not in (d, s) and (e, v) == (d, s)]
        want.append((d, s, k, min(met)[-1] if met else None))
    out = analysis.attached_times(spark.createDataFrame(relations, "doc_id int, sent_no int, rel_id int, start int"), spark.createDataFrame(times, "doc_id int, sent_no int, start int, time_id int"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_nested_names_are_made_once(spark):
    rows = [(1, 0, 5), (1, 0, 5), (1, 1, 3), (1, 3, 5), (2, 0, 9), (2, 1, 1), (None, 0, 5), (None, 1, 2)]
    out = analysis.nested_names(spark.createDataFrame(rows, "doc_id int, start int, end int"))
    assert sorted(map(tuple, out.collect())) == [(1, 0, 5, 1, 3), (1, 0, 5, 3, 5), (2, 0, 9, 1, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].startswith("Project")


def test_trigrams_are_counted_in_their_row(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, *range(40)]) if k % 3 else 100 + k, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(30)))) for k in range(60)]
    want = []
    for i in {i for i, _ in rows}:
        bag = sum((_bag(t) for j, t in rows if i == j and t), Counter())
        if bag:
            want.append((i, len(bag), bag.total(), max(bag.values())))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (100, 3):
        monkeypatch.setattr(ngrams, "MOST_REPEATED", most, raising=False)
        assert sorted(map(repr, map(tuple, ngrams.trigram_counts(docs).collect()))) == sorted(map(repr, want))
    alone = ngrams.trigram_counts(docs.where("doc_id >= 100"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_patterns_cut_only_sentences_that_may_match(spark):
    cut = ["See the www.x.org now.", "a.b@c.de other", "nothing here", "The end.COM? (die)", "mail@x then die", "HTTPS://q w", "a . b @ c"]
    rows = [(k // 2, k % 2, t) for k, t in enumerate(cut)]
    s = patterns.PatternSet(spark.createDataFrame(rows, "doc_id int, sent_no int, sentence string")).add("(wordset art the The die)")
    value = patterns.COMPILERS["value"](s, [["type", "email", "url"], ["return", "x"]], ())
    url = [(re.compile(p, re.I | re.A)) for p in (*values.EMAIL_PATTERNS, *values.URL_PATTERNS)]
    assert sorted(map(tuple, value.collect())) == sorted((d, n, w) for d, n, t in rows for w in t.split() if any(p.search(w) for p in url))
    assert values.MAY_HOLD in value._jdf.queryExecution().optimizedPlan().toString()
    word = patterns.COMPILERS["word"](s, [["in", "art"]], ())
    assert sorted(map(tuple, word.collect())) == [(0, 0), (1, 1), (2, 0)]
    assert "Generate" not in word._jdf.queryExecution().optimizedPlan().toString()
    said = patterns.COMPILERS["word"](s, [["in", "art"], ["return", "w"]], ())
    assert sorted(map(tuple, said.collect())) == [(0, 0, "the"), (1, 1, "The"), (2, 0, "die")]


def test_word_classes_keep_no_table_of_all_bigrams(spark, monkeypatch):
    rnd = random.Random(11)
    lines = [[rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))] for _ in range(200)]
    n = Counter(p for w in lines for p in zip(w, w[1:], strict=False))
    first = Counter()
    for (a, _), k in n.items():
        first[a] += k
    top = [w for w, _ in sorted(first.items(), key=lambda x: (-x[1], x[0]))[:5]]
    seen = []
    monkeypatch.setattr(learn, "merge_classes", lambda c, k, f=learn.merge_classes: seen.append(c.copy()) or f(c, k))
    monkeypatch.setattr(learn, "durable", None)
    out = learn.word_classes(spark.createDataFrame([(k, 0, w) for k, w in enumerate(lines)], "doc_id int, sent_no int, words array<string>"), 5, 2)
    assert sorted(r["word"] for r in out.collect()) == sorted(top)
    assert seen[0].tolist() == [[n[a, b] for b in top] for a in top]


def test_maxent_hashes_its_rows_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def told(x):
        calls.add(1)
        return ["a", x]

    rows = spark.range(40, numPartitions=2).selectExpr("id", "cast(id % 2 as double) label", "cast(id % 4 as string) x")
    f = F.udf(told, "array<string>").asNondeterministic()
    model = learn.maxent(rows.withColumn("features", f("x")), rounds=5)
    assert calls.value == 40
    plain = rows.withColumn("features", F.array(F.lit("a"), "x"))
    assert all(r["class"] == r["label"] for r in learn.classified(model, plain).collect())
