"""Lookups in dictionaries, gazetteers and feature tables: scans by weight and class, aliases, places, best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import mathx
from lexweave.session import table


def weighted_features(features: DataFrame, least: float, absolute: bool = True, alphabet: int | None = None) -> DataFrame:
    """Rows of ``name, weight, alphabet`` whose weight, or its absolute value, reaches ``least``; of one alphabet, if given."""
    weight = F.abs("weight") if absolute else F.col("weight")
    found = features.where(weight >= least)
    return found if alphabet is None else found.where(F.col("alphabet") == alphabet)


def features_of_class(features: DataFrame, kind: str) -> DataFrame:
    """Rows whose name is ``kind(...)``."""
    return features.where(F.startswith("name", F.lit(f"{kind}(")))


def topics_of_documents(wide: DataFrame, n: int) -> DataFrame:
    """``doc_id, rank, topic, weight`` from the columns ``topic0, weight0, ...`` of a row a document; missing topics give no row."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rank"), F.col(f"topic{k}").alias("topic"), F.col(f"weight{k}").alias("weight")) for k in range(n)])
    return wide.select("doc_id", F.inline(pairs)).where("topic is not null")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def date_literal(day: Column, dialect: str) -> Column:
    """A date as a SQL literal: ``DD-MON-YY`` for oracle, else ``YYYY-MM-DD``, in quotes."""
    text = F.upper(F.date_format(day, "dd-MMM-yy")) if dialect == "oracle" else F.date_format(day, "yyyy-MM-dd")
    return F.concat(F.lit("'"), text, F.lit("'"))


def appended_features(known: DataFrame, more: DataFrame) -> DataFrame:
    """``known`` and the rows of ``more`` whose ``idx`` lies above the largest known one."""
    top = known.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("_top"))
    return known.unionByName(more.crossJoin(F.broadcast(top)).where(F.col("idx") > F.col("_top")).select(*known.columns))  # one row


def aliases(names: DataFrame, table_: DataFrame, least: float) -> DataFrame:
    """``name, alias, score``: equivalents of lower-cased names that score ``least``; the name itself, at 1, where there is none."""
    known = table_.where(F.col("score") >= least).select(F.lower("name").alias("_key"), "alias", "score")
    met = names.select("name").distinct().join(known, F.lower("name") == F.col("_key"), "left")
    return met.select("name", F.coalesce("alias", F.lower("name")).alias("alias"), F.when(F.col("alias").isNull(), 1.0).otherwise(F.col("score")).alias("score"))


def linked_names(mentions: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """``name, other, score``: names of clusters that a coreference score of ``least`` links: mentions x scores x mentions."""
    a = mentions.select(F.col("cluster").alias("a"), F.col("name"))
    b = mentions.select(F.col("cluster").alias("b"), F.col("name").alias("other"))
    return scores.where(F.col("score") >= least).join(a, "a").join(b, "b").select("name", "other", "score")


def canonical_names(countries: DataFrame) -> DataFrame:
    """``alias, canonical``: every name of a country code with the one that is marked canonical."""
    own = countries.where("canonical").select("country_code", F.col("name").alias("canonical_name"))
    return countries.join(own, "country_code").select(F.col("name").alias("alias"), F.col("canonical_name").alias("canonical"))


def places(names: DataFrame, gazetteer: DataFrame, others: DataFrame) -> DataFrame:
    """``query, place_id`` and the place's columns: by name, or by ASCII name where the country is known, or by other names; each place once for a query."""
    own = gazetteer.where("name is not null").select(F.col("name").alias("query"), "place_id")
    ascii_ = gazetteer.where("country_code is not null").select(F.col("ascii_name").alias("query"), "place_id")
    keys = own.unionByName(ascii_).unionByName(others.select(F.col("name").alias("query"), "place_id"))
    return names.select("query").distinct().join(keys, "query").distinct().join(gazetteer, "place_id")


def best_places(found: DataFrame, order: list[Column]) -> DataFrame:
    """``query, places``: the ids of a query's places, best first."""
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", "place_id"))).alias("p")).select("query", F.col("p.place_id").alias("places"))


def best_actors(matches: DataFrame) -> DataFrame:
    """The best actor of each entity of ``entity, actor, pattern_score, association, importance``: rounded-up pattern score and association first, then importance, then the smaller id."""
    best = F.min(F.struct((-(F.ceil("pattern_score") + F.col("association"))).alias("score"), (-F.col("importance")).alias("importance"), "actor"))
    return matches.groupBy("entity").agg(best.alias("b")).select("entity", F.col("b.actor").alias("actor"), (-F.col("b.score")).alias("score"))


def beam(rows: DataFrame, by: str, score: str, arrival: str, width: int) -> DataFrame:
    """The best ``width`` rows of each group; of equal scores the earlier arrival stands first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), arrival))).where(F.col("place") <= width)


def _q_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("("), "p_name", F.lit(")")).alias("name"), (F.col("p_retailprice") - 1400).alias("weight"), (F.col("p_size") % 3).cast("int").alias("alphabet"))
    return features_of_class(weighted_features(features, 300, True, 1), "Brand#11").unionByName(weighted_features(features, 450, False))


def _q_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), *[F.when(F.col("c_custkey") % (k + 2) != 0, (F.col("c_nationkey") + k) % 12).alias(f"topic{k}") for k in range(4)], *[mathx.round_scaled(F.col("c_acctbal") / (k + 1), 3).alias(f"weight{k}") for k in range(4)])
    return topics_of_documents(wide, 4)


def _q_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", date_literal(day, "oracle").alias("oracle"), date_literal(day, "sqlite").alias("sqlite"))


def _q_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("name")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name"))
    return appended_features(s, c)


def _q_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    known = part.where("p_size % 2 = 0").select(F.upper("p_name").alias("name"), F.col("p_type").alias("alias"), (F.col("p_size") / 50).alias("score"))
    return aliases(part.select(F.col("p_name").alias("name")), known, 0.6).distinct()


def _q_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cluster"), F.col("s_name").alias("name"))
    scores = table(spark, sf_dir, "lineitem").where("l_suppkey < l_partkey").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.round(F.max("l_discount"), 2).alias("score"))
    return linked_names(mentions, scores, 0.05)


def _q_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("country_code"), F.lit(False).alias("canonical")).unionByName(region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("country_code"), F.lit(True).alias("canonical")))
    return canonical_names(names)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    code = F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey"))
    gazetteer = c.select(F.col("c_custkey").alias("place_id"), F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.concat(F.lit("n"), (F.col("c_custkey") % 30).cast("string")).alias("ascii_name"), code.alias("country_code"), F.col("c_acctbal").alias("population"))
    others = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), (F.col("s_suppkey") % 20).cast("string")).alias("name"), F.col("s_suppkey").alias("place_id"))
    return places(gazetteer.select(F.col("name").alias("query")), gazetteer, others)


def _q_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("query", "place_id", "country_code")


def _q_best_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_places(_places(spark, sf_dir), [F.col("country_code").isNull(), F.desc("population"), F.asc("place_id")])
    return best.select("query", F.array_join(F.transform(F.slice("places", 1, 5), lambda x: x.cast("string")), ",").alias("places"))


def _q_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries with their actors, for a gazetteer of country names."""
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_suppkey", "s_name")


def _q_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return best_actors(li.select(F.col("l_orderkey").alias("entity"), F.col("l_suppkey").alias("actor"), (F.col("l_discount") * 30).alias("pattern_score"), F.col("l_linenumber").cast("double").alias("association"), F.col("l_quantity").alias("importance")))


def _q_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_discount", (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey"))).alias("arrival")).distinct()
    return beam(li, "l_suppkey", "l_discount", "arrival", 5)


_GAZ = """g AS (SELECT c_custkey AS place_id, 'n' || (c_custkey % 40) AS name, 'n' || (c_custkey % 30) AS ascii_name, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS country_code, c_acctbal AS population FROM customer),
    q AS (SELECT DISTINCT name AS query FROM g), k AS (SELECT query, place_id FROM q, g WHERE g.name = query OR g.ascii_name = query AND g.country_code IS NOT NULL UNION SELECT query, s_suppkey FROM q JOIN supplier ON query = 'n' || (s_suppkey % 20)),
    f AS (SELECT query, g.* FROM k JOIN g USING (place_id))"""
QUERIES = {
    "feature_weights": _q_weights, "document_topics": _q_topics, "date_literals": _q_literals, "append_features": _q_appended, "alias_lookup": _q_aliases, "coreference_scores": _q_linked, "canonical_names": _q_canonical,
    "gazetteer_lookup": _q_places, "sorted_places": _q_best_places, "geo_join": _q_geo, "best_actor": _q_actors, "beam": _q_beam,
}
ORACLE_SQL = {
    "feature_weights": """WITH f AS (SELECT p_brand || '(' || p_name || ')' AS name, p_retailprice - 1400 AS weight, (p_size % 3)::INT AS alphabet FROM part)
        SELECT * FROM f WHERE abs(weight) >= 300 AND alphabet = 1 AND starts_with(name, 'Brand#11(') UNION ALL SELECT * FROM f WHERE weight >= 450""",
    "document_topics": "SELECT c_custkey AS doc_id, k::INT AS rank, ((c_nationkey + k) % 12)::INT AS topic, round(c_acctbal / (k + 1), 3) AS weight FROM customer, range(4) t(k) WHERE c_custkey % (k + 2) <> 0",
    "date_literals": "SELECT o_orderkey, '''' || upper(strftime(o_orderdate, '%d-%b-%y')) || '''' AS oracle, '''' || strftime(o_orderdate, '%Y-%m-%d') || '''' AS sqlite FROM orders",
    "append_features": "SELECT s_suppkey AS idx, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey > (SELECT max(s_suppkey) FROM supplier)",
    "alias_lookup": """WITH n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT lower(p_name) AS key, p_type AS alias, p_size / 50 AS score FROM part WHERE p_size % 2 = 0 AND p_size / 50 >= 0.6)
        SELECT DISTINCT n.name, coalesce(k.alias, lower(n.name)) AS alias, CASE WHEN k.alias IS NULL THEN 1.0 ELSE k.score END AS score FROM n LEFT JOIN k ON lower(n.name) = k.key""",
    "coreference_scores": "SELECT a.s_name AS name, b.s_name AS other, round(max(l_discount), 2) AS score FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey JOIN supplier b ON b.s_suppkey = l_partkey WHERE l_suppkey < l_partkey GROUP BY l_suppkey, l_partkey, 1, 2 HAVING round(max(l_discount), 2) >= 0.05",
    "canonical_names": "SELECT n_name AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name FROM region",
    "gazetteer_lookup": f"WITH {_GAZ} SELECT query, place_id, country_code FROM f",
    "sorted_places": f"WITH {_GAZ}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY country_code IS NULL, population DESC, place_id) AS n FROM f) SELECT query, string_agg(place_id::VARCHAR, ',' ORDER BY n) FILTER (WHERE n <= 5) AS places FROM r GROUP BY 1",
    "geo_join": "SELECT n_name, s_suppkey, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey",
    "best_actor": "SELECT l_orderkey AS entity, l_suppkey AS actor, ceil(l_discount * 30) + l_linenumber AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ceil(l_discount * 30) + l_linenumber DESC, l_quantity DESC, l_suppkey) = 1",
    "beam": "SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, arrival)::INT AS place FROM (SELECT DISTINCT l_suppkey, l_discount, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS arrival FROM lineitem) QUALIFY place <= 5",
}
