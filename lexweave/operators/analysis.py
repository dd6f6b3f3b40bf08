"""Stages over annotations: filters, trees, facts, coded events, attachments, instances, names that contain names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.text import tokens
from lexweave.operators.graph import connected_components
from lexweave.plans import derived
from lexweave.session import table


def keyword_prefilter(sentences: DataFrame, keywords: list[str]) -> DataFrame:
    """Sentences that hold all the keywords: a cheap test before a costly pattern."""
    return sentences.where(reduce(lambda a, k: a & F.contains("sentence", F.lit(k)), keywords, F.lit(True)))


def slot_constraints(mentions: DataFrame, types: list[str] | None = None, mention_types: list[str] | None = None, subtypes: list[str] | None = None) -> DataFrame:
    """Mentions that a slot takes; a list that is not given takes all."""
    for column, values in (("type", types), ("mention_type", mention_types), ("subtype", subtypes)):
        mentions = mentions if values is None else mentions.where(F.col(column).isin(values))
    return mentions


def clutter_scores(rows: DataFrame, rules: dict[str, tuple[Column, float]]) -> DataFrame:
    """Rows with ``clutter``, a map of the names of the rules that hold to their scores."""
    hits = F.filter(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("key"), F.lit(score).alias("value"))) for name, (holds, score) in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("clutter", F.map_from_entries(hits))


def uncluttered(rows: DataFrame, least: float) -> DataFrame:
    """Rows without a clutter score of ``least``."""
    return rows.where(~F.exists(F.map_values("clutter"), lambda x: x >= least))


def generics(mentions: DataFrame) -> DataFrame:
    """Mentions with ``is_generic``: a description without article or number, or whose entity has no name."""
    named = F.max(F.when(F.col("mention_type") == "NAME", 1).otherwise(0)).over(Window.partitionBy("doc_id", "entity_id"))
    return mentions.withColumn("is_generic", (F.col("mention_type") != "NAME") & (F.col("entity_id").isNull() | (named == 0)))


def parse_nodes(nodes: DataFrame, tag: str | None = None, headword: list[str] | None = None, child: str | None = None, block_child: str | None = None) -> DataFrame:
    """Nodes ``node_id, parent_id, tag, headword`` by tag, head word, and the tags that children must or must not have: joins by parent."""
    found = nodes
    if tag is not None:
        found = found.where(F.col("tag") == tag)
    if headword is not None:
        found = found.where(F.col("headword").isin(headword))
    for kind, how in ((child, "left_semi"), (block_child, "left_anti")):
        if kind is not None:
            below = nodes.where(F.col("tag") == kind).select(F.col("parent_id").alias("_up"))
            found = found.join(below, F.col("node_id") == F.col("_up"), how)
    return found


def aligned(left: DataFrame, alignment: DataFrame, right: DataFrame) -> DataFrame:
    """``doc_id, start, end, other_doc, other_start, other_end``: spans of one document at the tokens that an alignment gives them in another."""
    inside = left.join(alignment, (left.doc_id == alignment.from_doc) & (alignment.from_token >= left.start) & (alignment.from_token <= left.end))
    spans = inside.groupBy("doc_id", "start", "end", F.col("to_doc").alias("other_doc")).agg(F.min("to_token").alias("other_start"), F.max("to_token").alias("other_end"))
    return spans.join(right.select(F.col("doc_id").alias("other_doc")).distinct(), "other_doc", "left_semi")


def connective_statistics(sentences: DataFrame, connectives: list[str]) -> DataFrame:
    """``connective, n, n_sentences, n_docs, n_first``: how often, where, and how often at the start of a sentence a connective stands."""
    rows = sentences.select("doc_id", "sent_no", F.posexplode(tokens(F.lower("sentence"))).alias("tok_no", "connective")).where(F.col("connective").isin(connectives))
    return rows.groupBy("connective").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "sent_no").alias("n_sentences"), F.countDistinct("doc_id").alias("n_docs"), F.count_if(F.col("tok_no") == 0).alias("n_first"))


def neighbours(props: DataFrame, arguments: DataFrame, cues: dict[str, str]) -> DataFrame:
    """Cause and effect: ``doc_id, cause, effect, cue`` from propositions whose predicate is a cue with a subject and an object; ``back`` turns them round."""
    role = {r: arguments.where((F.col("owner") == "prop") & (F.col("role") == r)).select(F.col("owner_id").alias("prop_id"), F.col("mention_id").alias(r)) for r in ("sub", "obj")}
    found = props.where(F.col("predicate").isin(list(cues))).join(role["sub"], "prop_id").join(role["obj"], "prop_id")
    back = F.col("predicate").isin([c for c, way in cues.items() if way == "back"])
    return found.select("doc_id", F.when(back, F.col("obj")).otherwise(F.col("sub")).alias("cause"), F.when(back, F.col("sub")).otherwise(F.col("obj")).alias("effect"), F.col("predicate").alias("cue"))


def facts_of(mentions: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, entity_id, fact_type, score, n``: fact patterns ``type, subtype, fact_type, score`` over the mentions of entities; the best score and the number of matches."""
    met = mentions.where("entity_id is not null").join(F.broadcast(patterns), ["type", "subtype"])
    return met.groupBy("doc_id", "entity_id", "fact_type").agg(F.max("score").alias("score"), F.count("*").alias("n"))


def attached_times(relations: DataFrame, times: DataFrame) -> DataFrame:
    """Relations ``doc_id, sent_no, rel_id, start`` with the time of their sentence that stands nearest; ties to the earlier one; null without one."""
    key = ["doc_id", "sent_no"]
    first = times.where("doc_id is not null and sent_no is not null").groupBy(*key, "start").agg(F.min("time_id").alias("time_id"))
    rows = relations.select(*key, "rel_id", "start", F.lit(True).alias("rel")).unionByName(first.withColumn("rel", F.lit(False)), allowMissingColumns=True)
    # the last time up to a relation and the first from it on, in passes over the sentence: relations and times are not paired
    here = F.when(~F.col("rel") & F.col("start").isNotNull(), F.struct(F.col("start").alias("t_start"), "time_id"))
    span = (Window.unboundedPreceding, Window.currentRow)
    before, after = (F.last(here, ignorenulls=True).over(Window.partitionBy(*key).orderBy(c).rangeBetween(*span)) for c in (F.asc("start"), F.desc("start")))
    any_ = F.min(F.when(~F.col("rel"), F.struct(F.isnull("start").alias("no"), F.col("start").alias("t_start"), "time_id"))).over(Window.partitionBy(*key))
    met = rows.withColumn("before", before).withColumn("after", after).withColumn("any", any_).where("rel")

    def far(side: str) -> Column:
        return F.when(F.col(side).isNotNull() & F.col("start").isNotNull(), F.struct(F.abs(F.col(f"{side}.t_start") - F.col("start")).alias("far"), F.col(f"{side}.t_start").alias("t_start"), F.col(f"{side}.time_id").alias("time_id")))

    best = met.withColumn("b", F.coalesce(F.least(far("before"), far("after")), F.struct(F.lit(None).cast("int").alias("far"), "any.t_start", "any.time_id")))
    return best.groupBy(*key, "rel_id").agg(F.min(F.struct(F.isnull("b.far").alias("no"), F.col("b"))).alias("b")).select(*key, "rel_id", F.col("b.b.time_id").alias("time_id"))


def coded_events(events: DataFrame, arguments: DataFrame, codes: DataFrame, actors: DataFrame) -> DataFrame:
    """``event_id, code, source, target, tense``: events with a code for their anchor, and the actors of their subject and object; an event without a source is none."""
    role = {r: arguments.where((F.col("owner") == "event") & (F.col("role") == r)).join(actors, "mention_id").groupBy(F.col("owner_id").alias("event_id")).agg(F.min("actor").alias(name)) for r, name in (("sub", "source"), ("obj", "target"))}
    return events.join(F.broadcast(codes), "anchor").join(role["sub"], "event_id").join(role["obj"], "event_id", "left").select("event_id", "code", "source", "target", tense(F.col("type"), F.lit(None)).alias("tense"))


def tense(verb: Column, days_ago: Column) -> Column:
    """``past``, ``ongoing`` or ``neutral`` by how long ago an event's time lies, else by the ending of its word."""
    return F.when(days_ago > 30, "past").when(days_ago.isNotNull(), "ongoing").when(verb.rlike("(F|ed)$"), "past").when(verb.rlike("(O|ing)$"), "ongoing").otherwise("neutral")


def instances(mentions: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, doc_id, sent_no, x, y``: fillers of a pattern's two slots (``pattern, x_type, y_type, keyword``) in one sentence, which holds the keyword as a head word.

    Combinations are those of one sentence, as few as its mentions.
    """
    x = mentions.join(F.broadcast(patterns), F.col("type") == F.col("x_type")).select("pattern", "doc_id", "sent_no", F.col("mention_id").alias("x"), "y_type", "keyword")
    y = mentions.select("doc_id", "sent_no", F.col("mention_id").alias("y"), F.col("type").alias("y_type"))
    held = mentions.select("doc_id", "sent_no", F.col("headword").alias("keyword")).distinct()
    return x.join(held, ["doc_id", "sent_no", "keyword"], "left_semi").join(y, ["doc_id", "sent_no", "y_type"]).where("x <> y").select("pattern", "doc_id", "sent_no", "x", "y")


def individuals(names: DataFrame) -> DataFrame:
    """``id, individual``: ids that share a strong name, and whatever these link; the smallest id stands for them."""
    first = names.groupBy("name").agg(F.min("id").alias("a"))
    found = connected_components(names.join(first, "name").select("a", F.col("id").alias("b")))
    return found.select(F.col("node").alias("id"), F.col("component").alias("individual"))


def nested_names(names: DataFrame) -> DataFrame:
    """``doc_id, start, end, inner_start, inner_end``: names that lie inside others of their document."""
    names = names.select("doc_id", "start", "end").distinct()  # so no pair comes twice
    inner = names.select(F.col("doc_id").alias("d"), F.col("start").alias("inner_start"), F.col("end").alias("inner_end"))
    inside = (F.col("doc_id") == F.col("d")) & (F.col("inner_start") >= F.col("start")) & (F.col("inner_end") <= F.col("end")) & ((F.col("inner_start") > F.col("start")) | (F.col("inner_end") < F.col("end")))
    return names.join(inner, inside).select("doc_id", "start", "end", "inner_start", "inner_end")


def metonymy(mentions: DataFrame, places: list[str], acts: list[str]) -> DataFrame:
    """Mentions with ``role``: a place that does what bodies do stands for its government."""
    return mentions.withColumn("role", F.when(F.col("type").isin(places) & F.col("headword").isin(acts), "ORG").otherwise(F.col("type")))


def node_match(query: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, score``: share of a query's nodes ``node, type, prior`` that a document has, each at its best: type agreement x prior x the document's weight."""
    met = nodes.join(F.broadcast(query.select("node", F.col("type").alias("q_type"), "prior")), "node").withColumn("s", F.when(F.col("type") == F.col("q_type"), 1.0).otherwise(0.5) * F.col("prior") * F.col("weight"))
    total = query.agg(F.sum("prior").alias("total"))
    return met.groupBy("doc_id", "node").agg(F.max("s").alias("s")).groupBy("doc_id").agg(F.sum("s").alias("s")).crossJoin(F.broadcast(total)).select("doc_id", (F.col("s") / F.col("total")).alias("score"))  # one row


def subset_aliases(names: DataFrame) -> DataFrame:
    """``name, alias``: names whose tokens are all in exactly one longest other name; ambiguous ones have none.

    Candidates meet by their rarest token, as all tokens of the shorter must be in the longer.
    """
    rows = names.select(F.lower("name").alias("name")).distinct().withColumn("t", F.array_sort(F.array_distinct(tokens(F.col("name")))))
    each = rows.select("name", "t", F.explode("t").alias("token"))
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    rarest = each.join(df, "token").groupBy("name").agg(F.min(F.struct("df", "token")).alias("r")).select("name", F.col("r.token").alias("token"))
    short = rows.join(rarest, "name").select(F.col("name").alias("short"), F.col("t").alias("own"), "token")
    pairs = short.join(each.select(F.col("name").alias("long"), F.col("t").alias("all"), "token"), "token").where((F.size("own") < F.size("all")) & (F.size(F.array_except("own", "all")) == 0))
    leaves = pairs.join(pairs.select(F.col("short").alias("long")).distinct(), "long", "left_anti")  # those that nothing holds in turn
    return leaves.groupBy("short").agg(F.count_distinct("long").alias("n"), F.min("long").alias("alias")).where("n = 1").select(F.col("short").alias("name"), "alias")


def relation_filter(rows: DataFrame, kind: str, column: str, value: float | list | None = None) -> DataFrame:
    """Rows by a decision: ``boolean`` true, ``discrete`` one of the values, ``cutoff`` at least the value."""
    c = F.col(column)
    return rows.where({"boolean": lambda: c, "discrete": lambda: c.isin(value), "cutoff": lambda: c >= value}[kind]())


def mention_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``doc_id, kind, n``: rows of each annotation table by document, as a report."""
    return reduce(DataFrame.unionByName, [t.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(kind).alias("kind"), "n") for kind, t in tables.items()])


def graph_lines(edges: DataFrame) -> DataFrame:
    """``doc_id, value``: a graph of each document in the DOT language, edges ``source, label, target`` in order."""
    line = F.format_string('  "%s" -> "%s" [label="%s"];', F.col("source").cast("string"), F.col("target").cast("string"), F.col("label"))
    rows = edges.groupBy("doc_id").agg(F.array_sort(F.collect_set(line)).alias("l"))
    return rows.select("doc_id", F.concat(F.lit("digraph {\n"), F.array_join("l", "\n"), F.lit("\n}")).alias("value"))


def _t(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return derived.annotation_tables(spark, sf_dir)


def _q_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("sentence"))
    return keyword_prefilter(turns, ["the", "in"]).select("conv_id", "turn")


def _q_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_constraints(_t(spark, sf_dir)["mention"], ["A", "R"], ["NAME"], ["F"]).select("mention_id")


def _q_clutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = clutter_scores(_t(spark, sf_dir)["mention"], {"pronoun": (F.col("mention_type") == "PRON", 0.4), "unresolved": (F.col("entity_id").isNull(), 0.9)})
    return uncluttered(m, 0.5).select("mention_id", F.coalesce(F.element_at("clutter", F.lit("pronoun")), F.lit(0.0)).alias("score"))


def _q_generics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generics(_t(spark, sf_dir)["mention"]).select("mention_id", "is_generic")


def _q_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes above their lines."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("o_orderstatus").alias("tag"), F.col("o_orderpriority").alias("headword"))
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey").alias("node_id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_id"), F.col("l_returnflag").alias("tag"), F.lit("x").alias("headword"))
    return parse_nodes(o.unionByName(li), "F", ["1-URGENT", "2-HIGH"], "A", "N").select("node_id", "headword")


def _q_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    alignment = li.select(F.col("l_orderkey").alias("from_doc"), F.col("l_linenumber").alias("from_token"), (F.col("l_orderkey") + 1).alias("to_doc"), (F.col("l_partkey") % 20).alias("to_token"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return aligned(docs.select("doc_id", F.lit(2).alias("start"), F.lit(4).alias("end")), alignment, docs)


CONNECTIVES = ["and", "the", "of", "und", "der", "et", "de"]


def _q_connectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_no"), F.col("text").alias("sentence"))
    return connective_statistics(turns, CONNECTIVES)


def _q_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return neighbours(t["prop"], t["argument"], {"urgent": "forth", "high": "back"})


def _q_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([("A", "F", "returned", 0.9), ("R", "F", "refused", 0.7), ("N", "O", "open", 0.5), ("N", "F", "open", 0.8)], "type string, subtype string, fact_type string, score double")
    return facts_of(_t(spark, sf_dir)["mention"], patterns)


def _q_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 20).alias("sent_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("start"), "l_returnflag").distinct()
    return attached_times(li.where("l_returnflag = 'A'").select("doc_id", "sent_no", F.col("id").alias("rel_id"), "start").groupBy("doc_id", "sent_no", "rel_id").agg(F.min("start").alias("start")), li.where("l_returnflag = 'R'").select("doc_id", "sent_no", F.col("id").alias("time_id"), "start"))


def _q_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    codes = spark.createDataFrame([("urgent", "010"), ("high", "020"), ("medium", "030")], "anchor string, code string")
    actors = t["mention"].where("entity_id % 3 <> 0").select("mention_id", F.col("entity_id").alias("actor"))
    return coded_events(t["event"], t["argument"], codes, actors)


def _q_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([(1, "A", "R", "w7"), (2, "N", "N", "w11")], "pattern int, x_type string, y_type string, keyword string")
    return instances(_t(spark, sf_dir)["mention"], patterns)


def _q_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array((F.col("c_custkey") % 17).cast("string"), F.concat(F.lit("x"), (F.col("c_custkey") * 7 % 40).cast("string")))).alias("name"))
    return individuals(c.where("not (name like 'x%' and id % 5 <> 0)"))


def _q_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 9).alias("end"))
    return nested_names(li.distinct())


def _q_metonymy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metonymy(_t(spark, sf_dir)["mention"], ["A"], ["w1", "w2", "w3"]).groupBy("type", "role").agg(F.count("*").alias("n"))


def _q_node_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = spark.createDataFrame([("w1", "A", 1.0), ("w2", "R", 0.5), ("w3", "N", 0.5)], "node string, type string, prior double")
    nodes = _t(spark, sf_dir)["mention"].select("doc_id", F.col("headword").alias("node"), "type", (F.col("level") / 3).alias("weight"))
    return node_match(query, nodes).withColumn("score", F.round("score", 6))


def _q_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 7 = 0")
    names = p.select(F.explode(F.array("p_name", F.concat_ws(" ", "p_name", F.element_at(F.split("p_type", " "), 1)), F.element_at(F.split("p_name", " "), 1))).alias("name"))
    return subset_aliases(names)


def _q_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("late", F.col("l_linenumber") > 3)
    return relation_filter(relation_filter(relation_filter(li, "boolean", "late"), "discrete", "l_returnflag", ["A", "R"]), "cutoff", "l_discount", 0.05).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def _q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return mention_counts({k: t[k] for k in ("mention", "prop", "event")})


def _q_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    edges = t["argument"].where("owner = 'event' and owner_id % 10 = 0").select(F.col("owner_id").alias("doc_id"), F.col("owner_id").alias("source"), F.col("role").alias("label"), F.col("mention_id").alias("target"))
    return graph_lines(edges)


QUERIES = {
    "keyword_prefilter": _q_keywords, "slot_constraints": _q_slots, "clutter_filter": _q_clutter, "generics": _q_generics, "parse_nodes": _q_nodes, "alignment_join": _q_aligned, "connective_statistics": _q_connectives, "cause_effect": _q_causes,
    "entity_facts": _q_facts, "time_attachment": _q_times, "coded_events": _q_coded, "pattern_instances": _q_instances, "individuals": _q_individuals, "nested_names": _q_nested, "metonymy": _q_metonymy, "node_match": _q_node_match,
    "subset_aliases": _q_subsets, "relation_filters": _q_filtered, "annotation_counts": _q_counts, "graph_export": _q_graph,
}
ORACLE_SQL = {
    "keyword_prefilter": "SELECT conv_id, turn FROM conversations WHERE contains(text, 'the') AND contains(text, 'in')",
    "slot_constraints": f"WITH {derived.SQL} SELECT mention_id FROM mention WHERE type IN ('A', 'R') AND mention_type = 'NAME' AND subtype = 'F'",
    "clutter_filter": f"WITH {derived.SQL} SELECT mention_id, CASE WHEN mention_type = 'PRON' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS score FROM mention WHERE entity_id IS NOT NULL",
    "generics": f"WITH {derived.SQL} SELECT mention_id, mention_type <> 'NAME' AND (entity_id IS NULL OR max((mention_type = 'NAME')::INT) OVER (PARTITION BY doc_id, entity_id) = 0) AS is_generic FROM mention",
    "parse_nodes": "SELECT 'o' || o_orderkey AS node_id, o_orderpriority AS headword FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')",
    "alignment_join": """SELECT l_orderkey AS doc_id, 2 AS start, 4 AS "end", l_orderkey + 1 AS other_doc, min(l_partkey % 20) AS other_start, max(l_partkey % 20) AS other_end FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey + 1 IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""",
    "connective_statistics": r"""WITH t AS (SELECT conv_id, turn, i - 1 AS k, l[i] AS w FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '') AS l FROM conversations)))
        SELECT w AS connective, count(*) AS n, count(DISTINCT (conv_id, turn)) AS n_sentences, count(DISTINCT conv_id) AS n_docs, count(*) FILTER (WHERE k = 0) AS n_first FROM t WHERE w IN ('and', 'the', 'of', 'und', 'der', 'et', 'de') GROUP BY 1""",
    "cause_effect": f"""WITH {derived.SQL}, a AS (SELECT * FROM argument WHERE owner = 'prop') SELECT doc_id, CASE predicate WHEN 'high' THEN o.mention_id ELSE s.mention_id END AS cause, CASE predicate WHEN 'high' THEN s.mention_id ELSE o.mention_id END AS effect, predicate AS cue
        FROM prop JOIN a s ON s.owner_id = prop_id AND s.role = 'sub' JOIN a o ON o.owner_id = prop_id AND o.role = 'obj' WHERE predicate IN ('urgent', 'high')""",
    "entity_facts": f"""WITH {derived.SQL}, p(type, subtype, fact_type, score) AS (VALUES ('A', 'F', 'returned', 0.9), ('R', 'F', 'refused', 0.7), ('N', 'O', 'open', 0.5), ('N', 'F', 'open', 0.8))
        SELECT doc_id, entity_id, fact_type, max(score::DOUBLE) AS score, count(*) AS n FROM mention JOIN p USING (type, subtype) WHERE entity_id IS NOT NULL GROUP BY 1, 2, 3""",
    "time_attachment": """WITH l AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey % 20 AS sent_no, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS start, l_returnflag AS f FROM lineitem), r AS (SELECT doc_id, sent_no, id AS rel_id, min(start) AS start FROM l WHERE f = 'A' GROUP BY 1, 2, 3)
        SELECT r.doc_id, r.sent_no, rel_id, t.id AS time_id FROM r LEFT JOIN (SELECT * FROM l WHERE f = 'R') t ON t.doc_id = r.doc_id AND t.sent_no = r.sent_no QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.sent_no, rel_id ORDER BY abs(t.start - r.start), t.start, t.id) = 1""",
    "coded_events": f"""WITH {derived.SQL}, c(anchor, code) AS (VALUES ('urgent', '010'), ('high', '020'), ('medium', '030')), x AS (SELECT owner_id, role, min(entity_id) AS actor FROM argument JOIN mention USING (mention_id) WHERE owner = 'event' AND entity_id % 3 <> 0 GROUP BY 1, 2)
        SELECT event_id, code, s.actor AS source, t.actor AS target, CASE WHEN ends_with(type, 'F') THEN 'past' WHEN ends_with(type, 'O') THEN 'ongoing' ELSE 'neutral' END AS tense FROM event JOIN c USING (anchor) JOIN x s ON s.owner_id = event_id AND s.role = 'sub' LEFT JOIN x t ON t.owner_id = event_id AND t.role = 'obj'""",
    "pattern_instances": f"""WITH {derived.SQL}, p(pattern, x_type, y_type, keyword) AS (VALUES (1, 'A', 'R', 'w7'), (2, 'N', 'N', 'w11'))
        SELECT pattern, x.doc_id, x.sent_no, x.mention_id AS x, y.mention_id AS y FROM p JOIN mention x ON x.type = x_type JOIN mention y ON y.type = y_type AND y.doc_id = x.doc_id AND y.sent_no = x.sent_no AND y.mention_id <> x.mention_id
        WHERE EXISTS (SELECT 1 FROM mention k WHERE k.doc_id = x.doc_id AND k.sent_no = x.sent_no AND k.headword = keyword)""",
    "individuals": """WITH RECURSIVE n AS (SELECT c_custkey AS id, (c_custkey % 17)::VARCHAR AS name FROM customer UNION ALL SELECT c_custkey, 'x' || (c_custkey * 7 % 40) FROM customer WHERE c_custkey % 5 = 0), e AS (SELECT DISTINCT min(id) OVER (PARTITION BY name) AS a, id AS b FROM n),
        f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t AS (SELECT DISTINCT id, id AS r FROM n UNION SELECT t.id, f.b FROM t JOIN f ON f.a = t.r) SELECT id, min(r) AS individual FROM t GROUP BY 1""",
    "nested_names": """WITH n AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS s, l_linenumber + trunc(l_quantity)::INT % 9 AS e FROM lineitem)
        SELECT DISTINCT a.doc_id, a.s AS start, a.e AS "end", b.s AS inner_start, b.e AS inner_end FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.s >= a.s AND b.e <= a.e AND (b.s > a.s OR b.e < a.e)""",
    "metonymy": f"WITH {derived.SQL} SELECT type, CASE WHEN type = 'A' AND headword IN ('w1', 'w2', 'w3') THEN 'ORG' ELSE type END AS role, count(*) AS n FROM mention GROUP BY 1, 2",
    "node_match": f"""WITH {derived.SQL}, q(node, t, prior) AS (VALUES ('w1', 'A', 1.0), ('w2', 'R', 0.5), ('w3', 'N', 0.5)), m AS (SELECT doc_id, node, max(CASE WHEN type = t THEN 1.0 ELSE 0.5 END * prior::DOUBLE * level / 3) AS s FROM mention JOIN q ON node = headword GROUP BY 1, 2)
        SELECT doc_id, round(sum(s) / 2.0, 6) AS score FROM m GROUP BY 1""",
    "subset_aliases": """WITH n AS (SELECT DISTINCT lower(x) AS name FROM (SELECT p_name AS x FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_name || ' ' || split_part(p_type, ' ', 1) FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 7 = 0)),
        t AS (SELECT name, list_distinct(string_split(name, ' ')) AS l FROM n), p AS (SELECT a.name AS s, b.name AS g FROM t a JOIN t b ON len(a.l) < len(b.l) AND list_has_all(b.l, a.l)), v AS (SELECT * FROM p WHERE g NOT IN (SELECT s FROM p))
        SELECT s AS name, min(g) AS alias FROM v GROUP BY 1 HAVING count(DISTINCT g) = 1""",
    "relation_filters": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber > 3 AND l_returnflag IN ('A', 'R') AND l_discount >= 0.05 GROUP BY 1",
    "annotation_counts": f"WITH {derived.SQL} SELECT doc_id, 'mention' AS kind, count(*) AS n FROM mention GROUP BY 1 UNION ALL SELECT doc_id, 'prop', count(*) FROM prop GROUP BY 1 UNION ALL SELECT doc_id, 'event', count(*) FROM event GROUP BY 1",
    "graph_export": f"""WITH {derived.SQL} SELECT owner_id AS doc_id, 'digraph {{' || chr(10) || array_to_string(list_sort(list(DISTINCT '  "' || owner_id || '" -> "' || mention_id || '" [label="' || role || '"];')), chr(10)) || chr(10) || '}}' AS value FROM argument WHERE owner = 'event' AND owner_id % 10 = 0 GROUP BY 1""",
}
