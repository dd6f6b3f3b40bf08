"""Sentences, sections, dictionary matches and overlapping spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.text import tokens
from lexweave.session import table

#: A run of end marks, with a closing quote, ends a sentence where white space follows.
END = r"([.!?]+[\"']?)[ \t\n\r\f]+"
HEADER = r"^[A-Z][^.!?]{0,60}\z"
#: Terms that are broadcast at most.
FEW = 100_000


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sent_no, sentence``: trimmed sentences that are not blank, numbered from 0 with the blank ones counted."""
    cut = F.split(F.regexp_replace("text", END, "$1\u0001"), "\u0001")
    # what is blank is seen before the blanks are replaced: Spark computes again whatever a filter asks for
    rows = docs.select("doc_id", F.posexplode(cut).alias("sent_no", "sentence")).where(F.col("sentence").rlike(r"[^ \t\n\r\f]"))
    return rows.withColumn("sentence", F.trim(F.regexp_replace("sentence", r"[ \t\n\r\f]+", " ")))


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, section, header, n_lines``: lines after each header line (a short line that begins with a capital and has no end mark); section 0 lies before the first."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("is_header", F.col("line").rlike(HEADER)).withColumn("section", F.sum(F.col("is_header").cast("long")).over(order))
    return marked.groupBy("doc_id", "section").agg(F.max(F.when(F.col("is_header"), F.col("line"))).alias("header"), F.count_if(~F.col("is_header")).alias("n_lines"))


def dictionary_matches(texts: DataFrame, terms: DataFrame, most: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, start, length, term``, and columns of the term to keep: runs of up to ``most`` tokens of ``id, text`` that are a ``term``; a join by term.

    At most ``FEW`` terms are broadcast; Spark would judge them by the size of the file that they are made of.
    """
    terms = terms.select("term", *keep).distinct()
    terms = F.broadcast(terms) if terms.limit(FEW + 1).count() <= FEW else terms.hint("merge")
    runs = texts.select("id", tokens(F.lower("text")).alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i - 1).alias("start"), n.alias("length"), F.array_join(F.slice("w", i, n), " ").alias("term")))))
    return runs.select("id", F.explode(spans).alias("s")).select("id", "s.*").join(terms, "term").select("id", "start", "length", "term", *keep)


def without_overlaps(spans: DataFrame, by: str = "id") -> DataFrame:
    """Spans that no span of the same text overlaps that is longer, or as long and begins earlier."""
    end = F.col("start") + F.col("length")
    a, b = spans.withColumn("end", end), spans.select(by, F.col("start").alias("s2"), F.col("length").alias("l2"), end.alias("e2"))
    better = (F.col("s2") < F.col("end")) & (F.col("e2") > F.col("start")) & ((F.col("l2") > F.col("length")) | ((F.col("l2") == F.col("length")) & (F.col("s2") < F.col("start"))))
    return a.join(b.hint("merge"), (a[by] == b[by]) & better, "left_anti").drop("end")  # spans of a small file may be many


def name_similarity_pairs(names: DataFrame, threshold: float, score: Column | None = None) -> DataFrame:
    """``a, b, score``: distinct ``name`` s that share a token and are at least so similar by edit distance. Names meet by their tokens, not all with all."""
    rows = names.select("name").distinct().withColumn("t", F.explode(F.array_distinct(tokens("name"))))
    left, right = (rows.select(F.col("name").alias(k), "t") for k in ("a", "b"))
    pairs = left.join(right, "t").where("a < b").select("a", "b").distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    return pairs.withColumn("score", F.round(score if score is not None else 1 - F.levenshtein("a", "b") / longest, 6)).where(F.col("score") >= threshold)


def _q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(table(spark, sf_dir, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).alias("longest"))


def _q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(table(spark, sf_dir, "documents"))


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    terms = part.select(F.explode(F.array(F.element_at(F.split("p_name", " "), 1), F.col("p_name"))).alias("term"))
    return part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text")), terms.select(F.lower("term").alias("term"))


def _q_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_matches(*_names(spark, sf_dir), 2)


def _q_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_overlaps(dictionary_matches(*_names(spark, sf_dir), 2))


def _q_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_similarity_pairs(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), 0.6)


_DICT = """t AS (SELECT DISTINCT lower(x) AS term FROM (SELECT split_part(p_name, ' ', 1) AS x FROM part UNION ALL SELECT p_name FROM part)),
    w AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_brand || ' ' || p_name || ' ' || p_type), ' '), lambda z: z <> '') AS l FROM part),
    r AS (SELECT id, (i - 1)::INT AS start, n::INT AS length, array_to_string(l[i:i + n - 1], ' ') AS term FROM (SELECT id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM w, (VALUES (1), (2)) v(n))),
    m AS (SELECT r.* FROM r JOIN t USING (term))"""
QUERIES = {"sentences": _q_sentences, "sections": _q_sections, "dictionary_matches": _q_dictionary, "overlap_resolution": _q_overlaps, "similar_names": _q_similar}
ORACLE_SQL = {
    "sentences": r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]+["'']?)[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))) AS x FROM documents),
        n AS (SELECT doc_id, trim(regexp_replace(x, '[ \t\n\r\f]+', ' ', 'g')) AS x FROM s) SELECT doc_id, count(*) AS n, max(length(x))::INT AS longest FROM n WHERE x <> '' GROUP BY 1""",
    "sections": r"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, i, l[i] AS line, regexp_matches(l[i], '^[A-Z][^.!?]{0,60}$') AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM a)),
        c AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM b) SELECT doc_id, section::BIGINT AS section, max(line) FILTER (WHERE h) AS header, count(*) FILTER (WHERE NOT h) AS n_lines FROM c GROUP BY 1, 2""",
    "dictionary_matches": f"WITH {_DICT} SELECT * FROM m",
    "overlap_resolution": f"WITH {_DICT} SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.id = a.id AND b.start < a.start + a.length AND b.start + b.length > a.start AND (b.length > a.length OR (b.length = a.length AND b.start < a.start)))",
    "similar_names": """WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, unnest(string_split(name, ' ')) AS t FROM n)
        SELECT DISTINCT a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS score FROM t a JOIN t b USING (t) WHERE a.name < b.name AND round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) >= 0.6""",
}
