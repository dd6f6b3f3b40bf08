"""Places where an operator once did less than its whole job."""

from __future__ import annotations

import random

import __spark_entry__
import corpus_pipeline
from lexweave.llm import linededup, simhash


def _left(first: str, second: str) -> str:
    """``second`` after ``first``, as dedup_lines leaves it."""
    gone = set(linededup.repeatable(first))
    return linededup.strip(second, gone)[0]


def test_passages_go_wherever_they_stand():
    rng = random.Random(4)

    def lines(n: int, words: int, name: str) -> list[str]:
        return [" ".join(f"{name}{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]

    for n, words in [(1, 60), (2, 30), (3, 20), (4, 15), (6, 12), (40, 4)]:
        for _ in range(20):
            passage = lines(n, words, "shared")
            texts = ["\n".join(lines(rng.randrange(4), 5, "own") + passage + lines(rng.randrange(4), 5, "own")) for _ in range(2)]
            left = _left(*texts)
            assert sum(w.startswith("shared") for w in left.split()) <= 50
            assert sum(w.startswith("own") for w in left.split()) == sum(w.startswith("own") for w in texts[1].split())


def test_a_repeated_paragraph_goes_and_a_repeated_heading_stays(spark):
    paragraph = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"heading\n{paragraph}\nfirst end"), (2, f"{paragraph}\n\nheading\n\n{paragraph}"), (3, paragraph)]
    got = {r["doc_id"]: (r["text"], r["_lost"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nheading\n", 2), 3: ("", 1)}


def test_pipeline_drops_documents_of_like_shingles(spark, small):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = [w if i % 70 else "changed" for i, w in enumerate(words)]  # 3 words: Jaccard over 0.8 on five words
    far = [w if i % 10 else "changed" for i, w in enumerate(words)]
    texts = [" ".join(x) for x in (words, near, far)]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 3
    docs = spark.createDataFrame([*enumerate(texts, 1), (None, texts[0]), (9, None), (10, "")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES:
        if name.endswith("_dedup"):
            docs = stage(spark, docs, small)
    assert {r["doc_id"] for r in docs.collect()} == {1, 3, None, 9}


def test_rows_that_share_an_id_but_are_unlike_stay(spark, small):
    rng = random.Random(7)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(3)]
    rows = [(1, long[0], "a"), (1, long[1], "b"), (1, long[1], "b"), (2, long[1], "c"), (2, long[2], "d"), (None, long[2], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    left = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, small)
    assert left.columns == docs.columns
    assert sorted(r["_row"] for r in left.collect()) == ["a", "b", "d", "e"]


def test_near_duplicates_tell_whom_a_representative_stands_for(spark, tmp_path):
    rows = [(1, "One text, twice."), (2, "Another"), (3, "one TEXT twice"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["near_duplicates_membership"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["rep_id"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
