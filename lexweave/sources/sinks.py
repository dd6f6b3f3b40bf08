"""Writers of results: JSON, XML and text per document, tables with missing rows appended, annotated text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by_document(rows: DataFrame, key: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*others))).alias("items"))


def as_json(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, value``: one JSON object a document with the list of its rows."""
    return _by_document(rows, key).select(key, F.to_json(F.struct(key, "items")).alias("value"))


def as_xml(rows: DataFrame, key: str = "doc_id", row: str = "document") -> DataFrame:
    """``key, value``: one XML element a document."""
    return _by_document(rows, key).select(key, F.to_xml(F.struct(key, F.col("items").alias("item")), {"rowTag": row}).alias("value"))


def as_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, value``: a tab-separated line for each row."""
    return rows.select(key, F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("value"))


def _attributes(columns: list[str]) -> Column:
    """`` name="value"`` of every column that is not null, escaped."""

    def escaped(c: Column) -> Column:
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(mark), F.lit(name))
        return c

    return F.concat(*[F.coalesce(F.concat(F.lit(f' {c}="'), escaped(F.col(c).cast("string")), F.lit('"')), F.lit("")) for c in columns])


def as_annotation_xml(tables: dict[str, DataFrame], key: str = "doc_id", root: str = "Document") -> DataFrame:
    """``key, value``: one XML element a document with an element for each row of each table, by table name, then by what the row holds."""
    lines = None
    for name, rows in tables.items():
        own = rows.select(key, F.lit(name).alias("kind"), F.concat(F.lit(f"  <{name}"), _attributes([c for c in rows.columns if c != key]), F.lit("/>")).alias("line"))
        lines = own if lines is None else lines.unionByName(own)
    done = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "line"))).alias("l"))
    return done.select(key, F.concat(F.lit(f'<{root} id="'), F.col(key).cast("string"), F.lit('">\n'), F.array_join("l.line", "\n"), F.lit(f"\n</{root}>")).alias("value"))


def as_entity_xml(mentions: DataFrame, root: str = "source_file") -> DataFrame:
    """``doc_id, value``: entities with their mentions inside, as evaluation files have them: from ``doc_id, entity_id, type, mention_id, start, end, text``."""
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mention_id", F.concat(F.lit("    <entity_mention"), _attributes(["mention_id", "start", "end", "text"]), F.lit("/>")).alias("x")))), lambda m: m["x"]), "\n")
    entity = mentions.where("entity_id is not null").groupBy("doc_id", "entity_id").agg(F.min("type").alias("type"), inside.alias("m"))
    one = F.concat(F.lit("  <entity"), _attributes(["entity_id", "type"]), F.lit(">\n"), F.col("m"), F.lit("\n  </entity>"))
    done = entity.select("doc_id", "entity_id", one.alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "x"))).alias("l"))
    return done.select("doc_id", F.concat(F.lit(f'<{root} docid="'), F.col("doc_id").cast("string"), F.lit('">\n'), F.array_join("l.x", "\n"), F.lit(f"\n</{root}>")).alias("value"))


def as_event_xml(events: DataFrame) -> DataFrame:
    """``doc_id, value``: coded events as elements with their codes, actors and tense."""
    return as_annotation_xml({"CodedEvent": events}, root="Events")


def as_aligned_text(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, segment_no, value``: the text of each segment with its spans (``start, end, type``, apart) in square brackets."""
    by = ["doc_id", "segment_no"]
    sorted_ = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("spans"))
    met = segments.join(sorted_, by, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: int, end: int, type: string>>")))
    return met.select(*by, marked(F.col("text"), F.col("spans")).alias("value"))


def insert_with_retries(rows: DataFrame, write_to: Callable[[DataFrame], None], tries: int = 4) -> int:
    """Writes ``rows``, again after a failure, ``tries`` times at most; gives the number of the try that did it."""
    for k in range(1, tries + 1):
        try:
            write_to(rows)
            return k
        except Exception:
            if k == tries:
                raise
    raise ValueError("tries must be 1 or more")


def upsert(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the rows of the Parquet table at ``path`` whose key comes again and adds the others; the table is written anew beside the old one and put in its place."""
    spark = rows.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows.write.parquet(path)
        return
    all_ = old.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, gone = hadoop.Path(f"{path}.new"), hadoop.Path(f"{path}.old")
    all_.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(gone, True)
    fs.rename(hadoop.Path(path), gone)
    fs.rename(fresh, hadoop.Path(path))
    fs.delete(gone, True)


FORMS: dict[str, Callable[[DataFrame], DataFrame]] = {"json": as_json, "xml": as_xml, "lines": as_lines}


def write(rows: DataFrame, form: str, path: str, mode: str = "errorifexists") -> None:
    """Text files of a registered form; commits are atomic, so a failed write leaves no result."""
    FORMS[form](rows).select("value").write.mode(mode).text(path)


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the Parquet table at ``path`` lacks, and makes the table if there is none; gives their number."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], rows.select(key).schema)
    new = rows.join(known, key, "left_anti").dropDuplicates([key]).select(*rows.columns)
    count = new.count()
    new.write.mode("append").parquet(path)
    return count


def marked(text: Column, spans: Column, before: str = "[", after: str = "]") -> Column:
    """``text`` with marks around ``spans`` (sorted, apart; ``start``, ``end`` in code points, end exclusive)."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"].cast("int") - a["at"]), F.lit(before), F.substr(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), F.lit(after)).alias("out"), s["end"].cast("int").alias("at")),
    )
    return F.concat(done["out"], F.substr(text, done["at"] + 1))
