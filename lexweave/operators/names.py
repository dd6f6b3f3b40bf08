"""Names against dictionaries: the longest and weightiest patterns of a text, and names that are alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.text import similarity, tokens
from lexweave.operators.sentences import dictionary_matches
from lexweave.session import table

#: Score of a name that equals one of an actor's names.
EQUAL = 0.98


def best_matches(texts: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """Matches ``id, start, length, term, priority`` of ``terms`` (``term, priority``) in ``id, text`` that no better one overlaps: of a higher priority, then longer, then earlier, then by term."""
    best = terms.groupBy("term").agg(F.max("priority").alias("priority"))
    found = dictionary_matches(texts, best, most, ("priority",))
    rank = F.struct(-F.col("priority"), -F.col("length"), F.col("start"), F.col("term"))
    row = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"), rank.alias("r"))
    # matches that overlap begin within ``most`` tokens of each other: a window, as matches of a small file may be many
    near = Window.partitionBy("id").orderBy("start").rangeBetween(1 - most, most - 1)
    better = F.exists("near", lambda x: (x["s"] < F.col("start") + F.col("length")) & (x["e"] > F.col("start")) & (x["r"] < F.col("rank")))
    seen = found.withColumn("rank", rank).withColumn("near", F.collect_list(row).over(near))
    return seen.where(~better | F.col("id").isNull()).select("id", "start", "length", "term", "priority")


def close_actors(names: DataFrame, actors: DataFrame, equivalents: DataFrame, threshold: float) -> DataFrame:
    """``name, type, actor, score``: the best score of each actor of a name's type, by equality of an equivalent name or by edit distance.

    Names are in lower case with single blanks. Lengths must be within ``threshold`` of each other, and so must the
    similarity. Nothing is missed: two strings within k edits share, undisplaced by more than k, one of k + 1 parts
    of either, so actors meet names by such parts and never all with all.
    """
    clean = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    own = names.select(clean.alias("name"), "type").distinct()
    known = actors.select(clean.alias("pattern"), "type", "actor").distinct()
    equal = own.withColumn("e", F.col("name")).unionByName(own.join(equivalents.select(F.lower("name").alias("name"), F.lower("other").alias("e")), "name").select("name", "type", "e"))
    exact = equal.join(known.withColumnRenamed("pattern", "e"), ["e", "type"]).select("name", "type", "actor", F.lit(EQUAL).alias("score"))
    size = F.length("pattern")
    edits = F.floor(F.lit(1 - threshold) * size / threshold).cast("int")  # the longest name within the ratio allows most
    part = F.expr("int(ceil(len / (k + 1)))")
    cut = known.where(size > 0).withColumn("len", size).withColumn("k", edits).withColumn("w", part).select("pattern", "type", "actor", "len", F.explode(F.sequence(F.lit(0), F.floor((F.col("len") - 1) / F.col("w")).cast("int"))).alias("i"), "w").withColumn("piece", F.substr("pattern", F.col("i") * F.col("w") + 1, F.col("w")))
    low, high = F.ceil(F.length("name") * threshold - 1e-9).cast("int"), F.floor(F.length("name") / threshold + 1e-9).cast("int")
    lengths = own.where(F.length("name") > 0).select("name", "type", F.explode(F.sequence(low, high)).alias("len")).where("len > 0").withColumn("k", F.floor(F.lit(1 - threshold) * F.col("len") / threshold).cast("int")).withColumn("w", part)
    at = lengths.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("len") - 1) / F.col("w")).cast("int"))).alias("i")).select("*", F.explode(F.expr("sequence(-k, k)")).alias("off")).withColumn("from", F.col("i") * F.col("w") + F.col("off"))
    wide = F.least("w", F.col("len") - F.col("i") * F.col("w"))
    asked = at.where("from >= 0").withColumn("piece", F.substr("name", F.col("from") + 1, wide)).where(F.length("piece") == wide).select("name", "type", "len", "i", "piece").distinct()
    pairs = asked.join(cut.select("pattern", "type", "actor", "len", "i", "piece"), ["type", "len", "i", "piece"]).select("name", "type", "pattern", "actor").distinct()
    near = pairs.withColumn("score", similarity(F.col("name"), F.col("pattern"))).where(F.col("score") >= threshold - 1e-12).select("name", "type", "actor", "score")
    return exact.unionByName(near).groupBy("name", "type", "actor").agg(F.max("score").alias("score"))


def transliterated(names: DataFrame, letters: dict[str, str]) -> DataFrame:
    """``name, latin``: names with each letter replaced by a table; letters without an entry stay."""
    out = F.col("name")
    for old, new in letters.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return names.select("name", out.alias("latin"))


def abbreviations(names: DataFrame, table_: DataFrame, back: bool = False) -> DataFrame:
    """``word, other``: short forms of words, or with ``back`` the words of short forms."""
    old, new = ("short", "word") if back else ("word", "short")
    return names.select("word").distinct().join(table_.select(F.col(old).alias("word"), F.col(new).alias("other")).distinct(), "word")


def listed_names(sentences: DataFrame, names: DataFrame, most: int = 4) -> DataFrame:
    """``doc_id, sent_no, start, length, term, type``: names of a list (``term, type, priority``) in sentences, the best where they overlap."""
    texts = sentences.select(F.struct("doc_id", "sent_no").alias("id"), F.col("sentence").alias("text"))
    found = best_matches(texts, names, most)
    return found.join(names.select("term", "type").distinct(), "term").select("id.*", "start", "length", "term", "type")


def _q_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    texts = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text"))
    terms = part.select(F.lower("p_name").alias("term"), F.lit(1).alias("priority")).unionByName(part.select(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("term"), F.when(F.col("p_name").like("b%"), 2).otherwise(1).alias("priority"))).groupBy("term").agg(F.max("priority").alias("priority"))
    return best_matches(texts, terms, 2)


def _q_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.substring("p_brand", 7, 2)).alias("name"), F.substring("p_type", 1, 3).alias("type"), F.col("p_partkey").alias("actor"))
    names = part.where("actor % 4 = 0").select("name", "type")
    actors = part.where("actor % 4 = 1")
    equivalents = part.where("actor % 8 = 0").select("name", F.regexp_replace("name", "^[a-z]+", "bright").alias("other"))
    return close_actors(names, actors, equivalents, 0.8).withColumn("score", F.round("score", 6))


QUERIES = {"dictionary_best": _q_best, "close_actors": _q_close}
ORACLE_SQL = {
    "dictionary_best": """WITH t AS (SELECT term, max(priority) AS priority FROM (SELECT lower(p_name) AS term, 1 AS priority FROM part UNION ALL SELECT lower(split_part(p_name, ' ', 1)), CASE WHEN p_name LIKE 'b%' THEN 2 ELSE 1 END FROM part) GROUP BY 1),
        w AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_brand || ' ' || p_name || ' ' || p_type), ' '), lambda z: z <> '') AS l FROM part),
        r AS (SELECT id, (i - 1)::INT AS start, n::INT AS length, array_to_string(l[i:i + n - 1], ' ') AS term FROM (SELECT id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM w, (VALUES (1), (2)) v(n))), m AS (SELECT r.*, priority FROM r JOIN t USING (term))
        SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.id = a.id AND b.start < a.start + a.length AND b.start + b.length > a.start AND (-b.priority, -b.length, b.start, b.term) < (-a.priority, -a.length, a.start, a.term))""",
    "close_actors": """WITH p AS (SELECT p_name || ' ' || p_brand[7:8] AS name, p_type[1:3] AS type, p_partkey AS actor FROM part), n AS (SELECT DISTINCT name, type FROM p WHERE actor % 4 = 0), a AS (SELECT DISTINCT name AS pattern, type, actor FROM p WHERE actor % 4 = 1),
        e AS (SELECT name, type, name AS e FROM n UNION SELECT n.name, type, regexp_replace(n.name, '^[a-z]+', 'bright') FROM n WHERE name IN (SELECT name FROM p WHERE actor % 8 = 0)),
        s AS (SELECT e.name, e.type, actor, 0.98::DOUBLE AS score FROM e JOIN a ON a.type = e.type AND a.pattern = e.e UNION ALL SELECT n.name, n.type, actor, 1 - levenshtein(n.name, pattern) / greatest(length(n.name), length(pattern)) FROM n JOIN a ON a.type = n.type
            WHERE length(n.name) / length(pattern) >= 0.8 AND length(pattern) / length(n.name) >= 0.8 AND 1 - levenshtein(n.name, pattern) / greatest(length(n.name), length(pattern)) >= 0.8 - 1e-12)
        SELECT name, type, actor, round(max(score), 6) AS score FROM s GROUP BY 1, 2, 3""",
}
