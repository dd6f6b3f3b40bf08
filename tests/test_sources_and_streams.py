"""Readers, writers, queues and the pattern language on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexweave.operators.sentences import sentences
from lexweave.plans.patterns import PatternSet, parse
from lexweave.sources import readers, sinks
from lexweave.streaming import queues


def test_sgml_and_tags(spark, tmp_path):
    (tmp_path / "a.sgm").write_text("<DOC>\n<DOCID> one </DOCID><DATE>2004-07-09</DATE><TEXT><P>Fish &amp; chips</P></TEXT>\n</DOC>\n<DOC id='two'><TEXT>More</TEXT></DOC>\n")
    got = {r["doc_id"]: (r["text"], r["date"]) for r in readers.read(spark, "sgml", str(tmp_path)).collect()}
    assert got == {"one": ("Fish & chips", "2004-07-09"), "two": ("More", None)}
    found = readers.tags(spark.createDataFrame([(1, '<a href="x">y</a>')], "doc_id long, text string")).collect()
    assert [(r["closing"], r["tag"], r["attributes"]) for r in found] == [(False, "a", 'href="x"'), (True, "a", "")]


def test_segments_xml_lists(spark, tmp_path):
    (tmp_path / "s").write_text("<segment><guid>g1</guid><source>Hello &lt;b&gt;</source></segment>\n<segment><guid>g2</guid><text>T</text></segment>")
    assert {(r["doc_id"], r["text"]) for r in readers.read(spark, "segments", str(tmp_path / "s")).collect()} == {("g1", "Hello <b>"), ("g2", "T")}
    (tmp_path / "x.xml").write_text("<r><story id='7'><sentence>A.</sentence><sentence>B.</sentence></story></r>")
    assert [tuple(r) for r in readers.read(spark, "xml", str(tmp_path / "x.xml")).collect()] == [("7", "A.\nB.")]
    (tmp_path / "list").write_text(f"{tmp_path}/s\n\n")
    assert readers.read(spark, "list", str(tmp_path / "list")).first()["doc_id"] == "s"
    with pytest.raises(ValueError):
        readers.read(spark, "nothing", "")


def test_dates_in_ids(spark):
    rows = spark.createDataFrame([("AFP20040709.001",), ("x20049999",), (None,)], "doc_id string")
    assert [str(r["date"]) for r in readers.by_date_in_id(rows).collect()] == ["2004-07-09", "None", "None"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 2, "a & c"), (2, 1, None)], "doc_id long, start long, kind string")
    assert json.loads(sinks.as_json(rows).where("doc_id = 1").first()["value"])["items"] == [{"start": 2, "kind": "a & c"}, {"start": 5, "kind": "b"}]
    assert "a &amp; c" in sinks.as_xml(rows).where("doc_id = 1").first()["value"]
    sinks.write(rows, "lines", str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3
    table = str(tmp_path / "table")
    one = rows.where("kind = 'b'")
    assert [sinks.append_missing(x, table, "start") for x in (one, rows, rows)] == [1, 2, 0]
    text = spark.createDataFrame([("abcdef", [(1, 2), (3, 5)])], "t string, s array<struct<start: long, end: long>>")
    assert text.select(sinks.marked(F.col("t"), F.col("s"))).first()[0] == "a[b]c[de]f"


def test_queue_counts_each_row_once_and_keeps_what_fails(spark, tmp_path):
    source, out, dead, state = (str(tmp_path / x) for x in ("in", "out", "dead", "state"))
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    for part in (rows, rows.withColumn("doc_id", F.col("doc_id") + 10)):
        part.write.mode("append").parquet(source)
        queues.run_queue(queues.folder_stream(spark, source, "doc_id long, text string"), lambda b: b.withColumn("n", F.length("text")), F.col("text").isNotNull(), out, dead, state)
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 3, 11, 13]
    assert sorted(r["doc_id"] for r in spark.read.parquet(dead).collect()) == [2, 12]


def test_copies_across_batches(spark, tmp_path):
    source = str(tmp_path / "docs")
    for k in range(2):
        spark.createDataFrame([(10 * k + 1, "same"), (10 * k + 2, f"own {k}")], "doc_id long, text string").write.mode("append").parquet(source)
    out = queues.finished(queues.new_documents(queues.folder_stream(spark, source, "doc_id long, text string", files=1)), "append")
    assert sorted(r["text"] for r in out.collect()) == ["own 0", "own 1", "same"]


def test_patterns(spark):
    docs = spark.createDataFrame([(1, "Write to a@b.com now. Call 555-1234!"), (2, "Nothing here. The end."), (3, None)], "doc_id long, text string")
    base = sentences(docs)

    def run(text: str):
        return sorted(tuple(r) for r in PatternSet(base).add(text).matches().collect())

    assert run('(toplevel (value (type email phone) (return v)))') == [(1, 0, "a@b.com"), (1, 1, "555-1234!")][:1]
    assert run('(wordset w to @v) (toplevel (word (in w) (return x)))') == [(1, 0, "to")]
    assert run('(wordset v end.) (wordset w to @v) (toplevel (word (in w)))') == [(1, 0), (2, 1)]
    assert run('(toplevel (none-of (regex "[0-9]") (text "to")))') == [(2, 0), (2, 1)]
    assert run('(define d (text "end" RAW)) (toplevel (all-of (doc d) (text "Nothing" (return t))))') == [(2, 0, "Nothing")]
    for bad in ("(a", "a)", "(toplevel x)", "(define x x) (toplevel x)", "(toplevel (what))", "(thing)"):
        with pytest.raises(ValueError):
            run(bad)
    assert parse('(a "b \\" c" (d)) ; end')[0][1] == 'b " c'


def test_more_readers(spark, tmp_path):
    (tmp_path / "i").write_text("<b>One</b> &amp; two\r\n\r\n\r\n\r\nthree")
    assert readers.read(spark, "inqa", str(tmp_path / "i")).first()["text"] == "One & two\n\nthree"
    (tmp_path / "d").write_text('<html><meta name="date" content="2004"><body><p>First <i>a</i></p>\n<p>Second</p></body></html>')
    row = readers.read(spark, "dtra", str(tmp_path / "d")).first()
    assert (row["text"], row["meta"]) == ("First a\nSecond", {"date": "2004"})
    (tmp_path / "v.xml").write_text("<all><document id='v1'><s id='1'>A bc.</s><s id='2'>D.</s></document></all>")
    row = readers.read(spark, "viktrs", str(tmp_path / "v.xml")).first()
    assert (row["doc_id"], row["text"], [tuple(x) for x in row["sentences"]]) == ("v1", "A bc.\nD.", [(0, 5), (6, 8)])
    docs = spark.createDataFrame([(1, "<TURN speaker='x'>Hi</TURN><P>Para</P>")], "doc_id long, text string")
    assert [(r["region_no"], r["tag"], r["text"]) for r in readers.regions(docs, ("turn", "p")).collect()] == [(0, "turn", "Hi"), (1, "p", "Para")]
    (tmp_path / "w").write_text("# list\none\n two \n\none\n")
    assert {r[0] for r in readers.read_words(spark, str(tmp_path / "w")).collect()} == {"one", "two"}
    (tmp_path / "m").write_text("usa united states\nuk\n")
    assert {r["word"]: r["values"] for r in readers.read_word_map(spark, str(tmp_path / "m")).collect()} == {"usa": ["united", "states"], "uk": []}
    stories = spark.createDataFrame([(i,) for i in range(9, 0, -1)], "story_id int")
    assert [r[0] for r in readers.story_range(stories, 3, 5).collect()] == [3, 4, 5] and readers.story_range(stories, None, None).count() == 9
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:nothing:x", "select 1")


def test_parameters():
    assert readers.read_parameters("a: 1 # one\nb: %a%/x\nOVERRIDE a: 2\nc: 3\nUNSET c\nINCLUDE more", lambda _: "d: 4") == {"a": "2", "b": "1/x", "d": "4"}
    assert readers.read_parameters("x.prefix: p-\nx.list: a,b")["x.list"] == "p-a,p-b"
    for bad in ("a: 1\na: 2", "OVERRIDE a: 1", "UNSET a", "no colon", "parallel: x", "INCLUDE y"):
        with pytest.raises(ValueError):
            readers.read_parameters(bad)


def test_annotation_files(spark, tmp_path):
    mentions = spark.createDataFrame([(1, 10, "PER", 1, 0, 4, 'A & "B"'), (1, 10, "PER", 2, 9, 11, "he"), (2, None, "ORG", 3, 0, 1, "x")], "doc_id int, entity_id int, type string, mention_id int, start int, end int, text string")
    out = sinks.as_annotation_xml({"Mention": mentions})
    out.select("value").write.text(str(tmp_path / "x"))
    back = readers.read_annotations(spark, str(tmp_path / "x"), "Mention")
    assert {(r["mention_id"], r["text"], r["entity_id"]) for r in back.collect()} == {("1", 'A & "B"', "10"), ("2", "he", "10"), ("3", "x", None)}
    (one,) = sinks.as_entity_xml(mentions).collect()
    assert one["value"].count("<entity_mention") == 2 and one["value"].startswith('<source_file docid="1">\n  <entity entity_id="10" type="PER">')
    events = spark.createDataFrame([(7, "010", "A", None)], "doc_id int, code string, source string, target string")
    assert sinks.as_event_xml(events).first()["value"] == '<Events id="7">\n  <CodedEvent code="010" source="A"/>\n</Events>'
    segments = spark.createDataFrame([(1, 0, "Ann met Bob"), (1, 1, "no one")], "doc_id int, segment_no int, text string")
    spans = spark.createDataFrame([(1, 0, 8, 11, "PER"), (1, 0, 0, 3, "PER")], "doc_id int, segment_no int, start int, end int, type string")
    assert {r["value"] for r in sinks.as_aligned_text(segments, spans).collect()} == {"[Ann] met [Bob]", "no one"}


def test_upsert_and_retries(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        sinks.upsert(spark.createDataFrame(rows, "id int, v string"), path, "id")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    calls = []

    def fails_twice(_) -> None:
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")

    assert sinks.insert_with_retries(spark.range(1), fails_twice) == 3
    with pytest.raises(OSError):
        sinks.insert_with_retries(spark.range(1), lambda _: (_ for _ in ()).throw(OSError("no")))


def test_queue_that_fails_and_stages_and_feeding(spark, tmp_path):
    source, rows = str(tmp_path / "in"), spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string")
    assert queues.feed_queue(rows, source, "doc_id", None) == 9 and queues.feed_queue(rows, source, "doc_id", 9) == 9
    stream = queues.folder_stream(spark, source, "doc_id long, text string")

    def broken(batch):
        raise ValueError("no")

    queues.run_queue_with_retry(stream, broken, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 10
    stages = [("upper", lambda b: b.withColumn("text", F.upper("text"))), ("even", lambda b: b.where("doc_id % 2 = 0"))]
    assert queues.run_stages(spark, stages, source, "doc_id long, text string", str(tmp_path / "stages")) == {"upper": 10, "even": 5}
    assert queues.feed_queue(spark.createDataFrame([(10, "t")], "doc_id long, text string"), source, "doc_id", 9) == 10
    assert queues.run_stages(spark, stages, source, "doc_id long, text string", str(tmp_path / "stages")) == {"upper": 11, "even": 6}
