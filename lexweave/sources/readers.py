"""Document readers by format name. Each gives ``doc_id string, text string`` and what else its format holds.

Files are read by Spark, split and compressed as Spark can; markup is taken apart by expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = r"<(/?)([A-Za-z][A-Za-z0-9_.-]*)([^>]*)>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def inner(c: Column, tag: str) -> Column:
    """Text between the first pair of a tag; null without one."""
    return F.nullif(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))


def unescaped(c: Column) -> Column:
    for name, mark in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def without_tags(c: Column) -> Column:
    return F.trim(unescaped(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))


def attribute(c: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(c, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def tags(docs: DataFrame) -> DataFrame:
    """``doc_id, tag_no, closing, tag, attributes`` of every tag in ``text``, in order."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TAG), F.lit(0))).alias("tag_no", "raw"))
    return rows.select("doc_id", "tag_no", (F.regexp_extract("raw", TAG, 1) == "/").alias("closing"), F.lower(F.regexp_extract("raw", TAG, 2)).alias("tag"), F.trim(F.regexp_extract("raw", TAG, 3)).alias("attributes"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """A document for each file; its name is the id."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc_id"), F.col("value").alias("text"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file that lists paths, one a line. The list is read by the driver; the documents are not."""
    paths = [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]
    return read_whole(spark, paths) if paths else spark.createDataFrame([], "doc_id string, text string")


def read_sgml(spark: SparkSession, path: str) -> DataFrame:
    """``<DOC>`` elements, several a file: id, date and text from their tags."""
    raw = spark.read.option("lineSep", "</DOC>").text(path).where(F.col("value").rlike(r"(?i)<DOC\b"))
    value = F.col("value")
    doc_id = F.coalesce(F.trim(inner(value, "DOCID")), F.trim(inner(value, "DOCNO")), attribute(F.regexp_extract(value, r"(?is)<DOC\b[^>]*>", 0), "id"))
    return raw.select(doc_id.alias("doc_id"), without_tags(F.coalesce(inner(value, "TEXT"), value)).alias("text"), F.trim(F.coalesce(inner(value, "DATE_TIME"), inner(value, "DATETIME"), inner(value, "DATE"))).alias("date"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``<segment>`` elements, one document each: ``fields`` maps the names of their fields to values."""
    raw = spark.read.option("lineSep", "</segment>").text(path).where(F.col("value").contains("<segment"))
    pattern = r"(?s)<([A-Za-z_-]+)[^>]*>([^<]*)</"
    names, values = (F.regexp_extract_all("value", F.lit(pattern), F.lit(k)) for k in (1, 2))
    out = raw.select(F.map_from_arrays(names, F.transform(values, lambda v: F.trim(unescaped(v)))).alias("fields"))
    return out.select(F.col("fields")["guid"].alias("doc_id"), F.coalesce(F.col("fields")["source"], F.col("fields")["text"]).alias("text"), "fields")


def read_xml(spark: SparkSession, path: str, row: str = "story") -> DataFrame:
    """XML elements ``row`` with an ``id`` and any number of ``sentence`` s or a ``text``."""
    rows = spark.read.format("xml").option("rowTag", row).schema("_id string, id string, text string, sentence array<string>").load(path)
    return rows.select(F.coalesce("_id", "id").alias("doc_id"), F.coalesce("text", F.array_join("sentence", "\n")).alias("text"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("doc_id", F.col("doc_id").cast("string"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, text string, date string").json(path)


def regions(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``doc_id, region_no, tag, attributes, text``: elements of these names in ``text``, in order; their own markup goes."""
    pattern = rf"(?is)<({'|'.join(names)})\b([^>]*)>(.*?)</\1\s*>"
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("tag", "attributes", "body"), strict=True)])).alias("region_no", "r"))
    return rows.select("doc_id", "region_no", F.lower("r.tag").alias("tag"), F.trim("r.attributes").alias("attributes"), without_tags(F.col("r.body")).alias("text"))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return read_whole(spark, path)


def read_inqa(spark: SparkSession, path: str) -> DataFrame:
    """Clean text: entities and tags go, line ends of one kind, no more than one blank line in a row."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(without_tags(F.col("text")), r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return _raw(spark, path).select("doc_id", text.alias("text"))


def read_dtra(spark: SparkSession, path: str) -> DataFrame:
    """A document for each file, its paragraphs apart by lines; ``meta`` maps the names of ``<meta name= content=>`` to values. Its regions: ``regions(docs, ...)``."""
    metas = F.regexp_extract_all("text", F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    meta = F.map_from_entries(F.filter(F.transform(metas, lambda m: F.struct(attribute(m, "name").alias("key"), attribute(m, "content").alias("value"))), lambda e: e["key"].isNotNull()))
    body = F.coalesce(inner(F.col("text"), "body"), F.col("text"))
    paragraphs = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1)), lambda x: F.regexp_replace(without_tags(x), r"\s+", " "))
    return _raw(spark, path).select("doc_id", F.when(F.size(paragraphs) > 0, F.array_join(paragraphs, "\n")).otherwise(without_tags(body)).alias("text"), meta.alias("meta"))


def read_viktrs(spark: SparkSession, path: str) -> DataFrame:
    """XML stories ``<document id=>`` of sentences ``<s id=>``: the text, and ``sentences`` with their starts and ends in it."""
    rows = spark.read.format("xml").option("rowTag", "document").schema("_id string, s array<struct<_VALUE: string, _id: string>>").load(path)
    parts = F.transform("s", lambda x: F.trim(x["_VALUE"]))
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.aggregate(F.slice(parts, 1, k - 1), F.lit(0), lambda n, x: n + F.length(x) + 1))
    spans = F.zip_with(starts, parts, lambda a, x: F.struct(a.alias("start"), (a + F.length(x)).alias("end")))
    return rows.select(F.col("_id").alias("doc_id"), F.array_join(parts, "\n").alias("text"), F.when(F.size("s") > 0, spans).alias("sentences"))


def read_annotations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one kind of annotation from the XML that ``sinks.as_annotation_xml`` writes: every attribute is a column of strings."""
    names = F.regexp_extract_all("value", F.lit(r'([\w-]+)="([^"]*)"'), F.lit(1))
    values = F.transform(F.regexp_extract_all("value", F.lit(r'([\w-]+)="([^"]*)"'), F.lit(2)), unescaped)
    lines = spark.read.text(path).where(F.col("value").rlike(rf"^\s*<{kind}\b")).select(F.map_from_arrays(names, values).alias("a"))
    columns = sorted(r[0] for r in lines.select(F.explode(F.map_keys("a")).alias("k")).distinct().collect())
    return lines.select(*[F.element_at("a", F.lit(c)).alias(c) for c in columns])


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word`` of a list, one a line; blank lines and those that begin with # are none."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def read_word_map(spark: SparkSession, path: str) -> DataFrame:
    """``word, values`` of lines of a word, a blank, and its values."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(parts, 0).alias("word"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("values"))


def read_parameters(text: str, included: Callable[[str], str] | None = None) -> dict[str, str]:
    """A parameter file: ``key: value`` lines, ``#`` comments, ``INCLUDE name``, ``OVERRIDE key: value``, ``UNSET key``, ``%key%`` in values.

    A key that is set twice without OVERRIDE, an UNSET or OVERRIDE of one that is not there, and a line of no
    form raise ``ValueError``. ``key.list`` names that go with ``key.prefix`` are joined with it.
    """
    out: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        if line.startswith("INCLUDE "):
            if included is None:
                raise ValueError(f"line {number}: nothing to include from")
            for k, v in read_parameters(included(line[8:].strip()), included).items():
                if k in out:
                    raise ValueError(f"line {number}: {k} is set twice")
                out[k] = v
        elif line.startswith("UNSET "):
            if out.pop(line[6:].strip(), None) is None:
                raise ValueError(f"line {number}: nothing to unset")
        else:
            force = line.startswith("OVERRIDE ")
            key, colon, value = line.removeprefix("OVERRIDE ").partition(":")
            key = key.strip()
            if not colon or not key or " " in key:
                raise ValueError(f"line {number}: not a parameter: {line}")
            if (key in out) != force:
                raise ValueError(f"line {number}: {key} is {'not set' if force else 'set twice'}")
            for k, v in out.items():
                value = value.replace(f"%{k}%", v)
            out[key] = value.strip()
    for key in [k for k in out if k.endswith(".list")]:
        prefix = out.get(f"{key[:-5]}.prefix")
        if prefix is not None:
            out[key] = ",".join(f"{prefix}{x.strip()}" for x in out[key].split(","))
    if not out.get("parallel", "000").isdigit() or len(out.get("parallel", "000")) != 3:
        raise ValueError("parallel must be three digits")
    return out


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "whole": read_whole, "list": read_list, "sgml": read_sgml, "sgm": read_sgml, "segments": read_segments, "xml": read_xml, "icews_xmltext": read_xml, "viktrs": read_viktrs, "inqa": read_inqa, "dtra": read_dtra, "parquet": read_table, "json": read_json,
}
#: Connectors of databases by the scheme of a URL; new ones can be added.
DRIVERS = {"sqlite": "org.sqlite.JDBC", "mysql": "com.mysql.cj.jdbc.Driver", "postgresql": "org.postgresql.Driver", "oracle": "oracle.jdbc.OracleDriver"}



def read(spark: SparkSession, form: str, path: str) -> DataFrame:
    """Documents in a registered format; an unknown one raises ``ValueError``."""
    if form not in READERS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(sorted(READERS))}")
    return READERS[form](spark, path)


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A query of a database; with ``key`` and ``bounds`` (lowest, highest, parts) read in parts."""
    scheme = url.removeprefix("jdbc:").split(":", 1)[0]
    if scheme not in DRIVERS:
        raise ValueError(f"unknown database {scheme!r}; known: {', '.join(sorted(DRIVERS))}")
    reader = spark.read.format("jdbc").option("url", url).option("driver", DRIVERS[scheme])
    if key and bounds:
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", bounds[2]).load()
    return reader.option("query", query).load()


def by_date_in_id(docs: DataFrame) -> DataFrame:
    """``docs`` with ``date`` from the eight digits ``YYYYMMDD`` in its id; null where they are none."""
    return docs.withColumn("date", F.try_to_timestamp(F.regexp_extract(F.col("doc_id").cast("string"), r"((?:19|20)\d{6})", 1), F.lit("yyyyMMdd")).cast("date"))


def story_range(stories: DataFrame, first: int | None, last: int | None, key: str = "story_id") -> DataFrame:
    """Stories with an id from ``first`` to ``last``, in order; a bound that is not given is open."""
    for bound, holds in ((first, F.col(key) >= F.lit(first)), (last, F.col(key) <= F.lit(last))):
        stories = stories if bound is None else stories.where(holds)
    return stories.orderBy(key)
