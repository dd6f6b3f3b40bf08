"""Facts to hypotheses, ranking and cutoffs; score combination and smoothing; precision and recall; coded events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.mathx import combine
from lexweave.session import table


def hypotheses(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key of ``doc, fact, score, score_group, day, reliable``: counts, best score, best (least) group, days, reliable documents.

    A document counts as reliable by its first fact, the one of the smallest id.
    """
    by_doc = facts.groupBy(*key, "doc").agg(F.min(F.struct("fact", "reliable")).alias("f"), F.count("*").alias("n"), F.max("score").alias("s"), F.min("score_group").alias("g"), F.min("day").alias("a"), F.max("day").alias("b"), F.max("fact").alias("i"))
    return by_doc.groupBy(*key).agg(F.sum("n").alias("n_facts"), F.count("*").alias("n_docs"), F.max("s").alias("best_score"), F.min("g").alias("best_group"), F.min("a").alias("oldest"), F.max("b").alias("newest"), F.count_if(F.col("f.reliable")).alias("n_reliable"), F.max("i").alias("newest_fact"))


def ranked(rows: DataFrame, slot: str, most: int) -> DataFrame:
    """The best ``most`` hypotheses of a slot: more facts, better score, newer fact first."""
    order = [F.desc("n_facts"), F.desc("best_score"), F.desc("newest_fact")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(slot).orderBy(*order))).where(F.col("rank") <= most)


#: Weights of neighbours by distance, by the size of the window. Fixed values.
SMOOTHING = {
    1: (1.0,),
    3: (1.0, 0.5),
    5: (1.0, 0.8, 0.5),
    7: (1.0, 0.9, 0.75, 0.5),
    9: (1.0, 0.95, 0.82, 0.70, 0.5),
    11: (1.0, 0.98, 0.90, 0.82, 0.7, 0.5),
}


def smoothing(size: int) -> tuple[float, ...]:
    """Weights of a window size; a size that has none smooths nothing."""
    return SMOOTHING.get(size, SMOOTHING[1])


def smoothed(rows: DataFrame, score: str, by: str, order: str, weights: tuple[float, ...]) -> Column:
    """The largest of a row's score and its neighbours', each weakened by its distance."""
    w = Window.partitionBy(by).orderBy(order)
    near = [x for d, c in enumerate(weights) if d for x in (F.coalesce(F.lag(score, d).over(w), F.lit(0.0)) * c, F.coalesce(F.lead(score, d).over(w), F.lit(0.0)) * c)]
    return F.greatest(F.col(score) * weights[0], *near) if near else F.col(score) * weights[0]


def near_mark(mark: Column, by: str, order: str, before: int, after: int) -> Column:
    """Whether a row within the given distances holds the mark."""
    return F.max(mark.cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(-before, after)) == 1


def precision_recall(system: DataFrame, gold: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Correct, spurious and missing rows by kind, with precision, recall and F; null where a denominator is 0."""
    s, g = (x.select(*key, kind).distinct().withColumn(m, F.lit(True)) for x, m in ((system, "_s"), (gold, "_g")))
    both = s.join(g, [*key, kind], "full").groupBy(kind).agg(F.count_if(F.expr("_s and _g")).alias("correct"), F.count_if(F.expr("_s and _g is null")).alias("spurious"), F.count_if(F.expr("_g and _s is null")).alias("missing"))
    c, p, r = F.col("correct"), F.col("correct") + F.col("spurious"), F.col("correct") + F.col("missing")
    return both.withColumns({"precision": F.round(c / F.nullif(p, F.lit(0)), 6), "recall": F.round(c / F.nullif(r, F.lit(0)), 6), "f": F.round(2 * c / F.nullif(p + r, F.lit(0)), 6)})


def histogram(values: DataFrame, column: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts by bin; the first and last take what lies beyond."""
    n = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / width))).cast("int")
    return values.where(F.col(column).isNotNull()).groupBy(n.alias("bin")).agg(F.count("*").alias("n"))


def unique_events(events: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """One event of each uniqueness group."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def overridden(events: DataFrame, overrides: DataFrame, within: list[str]) -> DataFrame:
    """Events that no event of an overriding type (``winner, loser``) stands beside in the same group."""
    losers = events.select(*within, F.col("event_type").alias("winner")).distinct().join(F.broadcast(overrides), "winner").select(*within, F.col("loser").alias("event_type")).distinct()
    return events.join(losers, [*within, "event_type"], "left_anti")


def promote(mentions: DataFrame, left: str, right: str, kind: str) -> DataFrame:
    """Relations of documents: mentions of equal ends and type, without those that relate a thing to itself."""
    return mentions.where(F.col(left) != F.col(right)).groupBy(left, right, kind).agg(F.count("*").alias("n"), F.min("mention").alias("first_mention"))


def type_frequency(mentions: DataFrame, by: list[str], kind: str, entity: str, least: int) -> DataFrame:
    """Mentions whose type has at least ``least`` distinct entities in the same group; a mention without entity never counts or matches."""
    counts = mentions.where(F.col(entity).isNotNull()).groupBy(*by, kind).agg(F.countDistinct(entity).alias("_n")).where(F.col("_n") >= least)
    return mentions.where(F.col(entity).isNotNull()).join(counts.drop("_n"), [*by, kind], "left_semi")


def _q_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    facts = li.select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("score_group"), F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") == "N").alias("reliable"))
    return ranked(hypotheses(facts, ["l_suppkey", "l_partkey"]), "l_suppkey", 3)


def _q_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 5 == 4, F.lit(-1.0)).otherwise(F.col("l_discount")))).alias("s"))
    top = F.when(F.col("l_orderkey") % 3 == 0, 0.25).when(F.col("l_orderkey") % 3 == 1, -1.0)
    ways = {"max": "max", "min": "min", "mult": "mult", "avg": "avg", "top": "mult-including-top"}
    return li.select("l_orderkey", *[F.round(combine(F.col("s"), ways[k]), 9).alias(k) for k in ways if k != "top"], *[F.round(combine(F.col("s"), ways[k], top), 9).alias(f"{k}_with_top") for k in ways])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") / 1000).alias("score"))


def _q_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", *[F.round(smoothed(t, "score", "conv_id", "turn", smoothing(n)), 9).alias(f"smoothed_{n}") for n in (*SMOOTHING, 4)], near_mark(F.col("role") == "system", "conv_id", "turn", 1, 1).alias("near_system"))


def _q_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "bad").otherwise("good").alias("kind"))
    docs = table(spark, sf_dir, "documents").join(gold.select("doc_id"), "doc_id", "left_semi")
    guess = docs.select("doc_id", F.when(F.regexp_count("text", F.lit(r"[|#$%&*!]")) > 10, "bad").otherwise("good").alias("kind"))
    return precision_recall(guess, gold, ["doc_id"], "kind")


def _q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "events"), "value", 0.0, 5.0, 20)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def _q_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_events(_events(spark, sf_dir), ["user_id", "event_type", "day"], [F.desc("value"), F.asc("event_id")]).select("event_id", "user_id", "event_type", "value")


def _q_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = spark.createDataFrame([("purchase", "click"), ("error", "view")], "winner string, loser string")
    return overridden(_events(spark, sf_dir), table_, ["user_id", "day"]).select("event_id")


def _q_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention"))
    return promote(m, "l_suppkey", "l_partkey", "l_returnflag")


def _q_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return type_frequency(m, ["l_orderkey"], "l_returnflag", "l_partkey", 3).select("l_orderkey", "l_linenumber")


def _q_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns back to the last turn of the user."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)).alias("distance"))


QUERIES = {"fact_hypotheses": _q_hypotheses, "score_combiners": _q_combined, "smoothed_scores": _q_smoothed, "precision_recall": _q_scored, "confidence_histogram": _q_histogram, "event_uniqueness": _q_unique, "event_override": _q_overridden, "relation_promotion": _q_promoted, "type_frequency": _q_frequency, "antecedent_distance": _q_distance}
_LI = "(l_orderkey * 10 + l_linenumber)"
ORACLE_SQL = {
    "fact_hypotheses": f"""WITH f AS (SELECT l_suppkey, l_partkey, l_orderkey AS doc, {_LI} AS fact, l_discount AS score, l_linenumber AS g, l_shipdate::DATE AS day, l_returnflag = 'N' AS rel FROM lineitem),
        o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey, doc ORDER BY fact) AS k FROM f),
        h AS (SELECT l_suppkey, l_partkey, count(*) AS n_facts, count(DISTINCT doc) AS n_docs, max(score) AS best_score, min(g) AS best_group, min(day) AS oldest, max(day) AS newest, count(*) FILTER (WHERE k = 1 AND rel) AS n_reliable, max(fact) AS newest_fact FROM o GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n_facts DESC, best_score DESC, newest_fact DESC)::INT AS rank FROM h QUALIFY rank <= 3""",
    "score_combiners": """WITH s AS (SELECT l_orderkey, CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE l_discount END AS d FROM lineitem),
        c AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 0.25 END AS t, count(d) = 0 AS none, greatest(0.0, max(d)) AS hi, least(1.0, min(d)) AS lo, product(d) AS pr, avg(d) AS av FROM s GROUP BY 1, 2)
        SELECT l_orderkey, round(CASE WHEN none THEN -1.0 ELSE hi END, 9) AS max, round(CASE WHEN none THEN -1.0 ELSE lo END, 9) AS min, round(CASE WHEN none THEN -1.0 ELSE pr END, 9) AS mult, round(coalesce(av, -1.0), 9) AS avg,
            round(coalesce(t, CASE WHEN none THEN -1.0 ELSE hi END), 9) AS max_with_top, round(coalesce(t, CASE WHEN none THEN -1.0 ELSE lo END), 9) AS min_with_top, round(coalesce(t, CASE WHEN none THEN -1.0 ELSE pr END), 9) AS mult_with_top,
            round(coalesce(t, av, -1.0), 9) AS avg_with_top, round(CASE WHEN none THEN coalesce(t, -1.0) ELSE pr * coalesce(t, 1.0) END, 9) AS top_with_top FROM c""",
    "smoothed_scores": f"""WITH t AS (SELECT conv_id, turn, role, length(text) / 1000 AS s FROM conversations),
        c(size, d, w) AS (VALUES (1, 0, 1.0), (3, 0, 1.0), (3, 1, 0.5), (5, 0, 1.0), (5, 1, 0.8), (5, 2, 0.5), (7, 0, 1.0), (7, 1, 0.9), (7, 2, 0.75), (7, 3, 0.5), (9, 0, 1.0), (9, 1, 0.95), (9, 2, 0.82), (9, 3, 0.70), (9, 4, 0.5),
            (11, 0, 1.0), (11, 1, 0.98), (11, 2, 0.90), (11, 3, 0.82), (11, 4, 0.7), (11, 5, 0.5), (4, 0, 1.0)),
        n AS (SELECT a.conv_id, a.turn, size, round(max(b.s * w::DOUBLE), 9) AS v FROM t a JOIN t b USING (conv_id) JOIN c ON d = abs(a.turn - b.turn) GROUP BY 1, 2, 3),
        m AS (SELECT conv_id, turn, max((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near_system FROM t)
        SELECT conv_id, turn, {", ".join(f"max(v) FILTER (WHERE size = {k}) AS smoothed_{k}" for k in (1, 3, 5, 7, 9, 11, 4))}, any_value(near_system) AS near_system FROM n JOIN m USING (conv_id, turn) GROUP BY 1, 2""",
    "precision_recall": r"""WITH g AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'bad' ELSE 'good' END AS kind FROM labels),
        s AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[|#$%&*!]')) > 10 THEN 'bad' ELSE 'good' END AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
        b AS (SELECT kind, s.doc_id IS NOT NULL AS a, g.doc_id IS NOT NULL AS c FROM (SELECT DISTINCT * FROM s) s FULL JOIN (SELECT DISTINCT * FROM g) g USING (doc_id, kind)),
        n AS (SELECT kind, count(*) FILTER (WHERE a AND c) AS correct, count(*) FILTER (WHERE a AND NOT c) AS spurious, count(*) FILTER (WHERE c AND NOT a) AS missing FROM b GROUP BY 1)
        SELECT *, round(correct / nullif(correct + spurious, 0), 6) AS precision, round(correct / nullif(correct + missing, 0), 6) AS recall, round(2 * correct / nullif(2 * correct + spurious + missing, 0), 6) AS f FROM n""",
    "confidence_histogram": "SELECT least(19, greatest(0, floor(value / 5.0)))::INT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "event_uniqueness": "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY value DESC, event_id) = 1",
    "event_override": """WITH o(winner, loser) AS (VALUES ('purchase', 'click'), ('error', 'view')) SELECT event_id FROM events e WHERE NOT EXISTS
        (SELECT 1 FROM events f JOIN o ON f.event_type = o.winner WHERE o.loser = e.event_type AND f.user_id = e.user_id AND f.ts::DATE = e.ts::DATE)""",
    "relation_promotion": f"SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS n, min({_LI}) AS first_mention FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2, 3",
    "type_frequency": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_returnflag) IN (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 3)",
    "antecedent_distance": "SELECT conv_id, turn, turn - max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS distance FROM conversations",
}
