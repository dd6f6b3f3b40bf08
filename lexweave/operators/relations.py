"""Relations of documents: rewriting rules, filters that drop or add, promotion, linking, voting and scoring.

A relation is a row ``rel_id, predicate, args`` (role to value) ``, sources``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.operators.graph import connected_components
from lexweave.plans import derived
from lexweave.session import table


def _matches(predicate: str, roles: list[str]) -> Column:
    out = F.col("predicate") == predicate
    for r in roles:
        out = out & F.map_contains_key("args", r)
    return out


def _pairs(roles: dict[str, str | None]) -> Column:
    """``args`` with roles renamed; those without a new name are left out, and others keep theirs."""
    entries = F.map_entries("args")
    name = F.create_map(*[F.lit(x) for k, v in roles.items() for x in (k, v or "")]) if roles else None
    if name is None:
        return F.col("args")
    renamed = F.transform(entries, lambda e: F.struct(F.coalesce(name[e["key"]], e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(renamed, lambda e: e["key"] != ""))


def rename(relations: DataFrame, old: str, new: str, roles: dict[str, str | None], rule: str) -> DataFrame:
    """``rename``: relations of predicate ``old`` that have the roles get a new predicate and new role names; a role without one goes. The rule joins the sources."""
    hit = _matches(old, list(roles))
    return relations.select("rel_id", F.when(hit, new).otherwise(F.col("predicate")).alias("predicate"), F.when(hit, _pairs(roles)).otherwise(F.col("args")).alias("args"), F.when(hit, F.array_append("sources", rule)).otherwise(F.col("sources")).alias("sources"))


def retype(relations: DataFrame, predicate: str, role: str, kind: str) -> DataFrame:
    """``retype``: the value of a role gets a type, written before it."""
    typed = F.map_zip_with("args", F.create_map(F.lit(role), F.lit(f"{kind}:")), lambda k, v, t: F.when(v.isNotNull(), F.concat(F.coalesce(t, F.lit("")), v)))
    only = F.map_filter(typed, lambda k, v: v.isNotNull())
    return relations.withColumn("args", F.when(_matches(predicate, [role]), only).otherwise(F.col("args")))


def split(relations: DataFrame, predicate: str, outputs: list[tuple[str, dict[str, str]]], preserve: bool, rule: str) -> DataFrame:
    """``split``: a relation that has all roles of all outputs becomes the outputs, each with its own roles; those of fewer than two arguments are left out. The input stays if ``preserve``."""
    hit = _matches(predicate, sorted({r for _, roles in outputs for r in roles}))
    made = F.array(*[F.struct(F.lit(name).alias("predicate"), F.map_from_arrays(F.array(*map(F.lit, roles.values())), F.array(*[F.element_at("args", F.lit(r)) for r in roles])).alias("args"), F.lit(k + 1).alias("n")) for k, (name, roles) in enumerate(outputs)])
    parts = relations.where(hit).select("rel_id", "sources", F.explode(F.filter(made, lambda o: F.size(o["args"]) >= 2)).alias("o"))
    out = parts.select(F.concat_ws(".", "rel_id", F.col("o.n").cast("string")).alias("rel_id"), "o.predicate", "o.args", F.array_append("sources", rule).alias("sources"))
    return (relations if preserve else relations.where(~F.coalesce(hit, F.lit(False)))).unionByName(out)


def binarize(relations: DataFrame, predicate: str, subject: str, roles: dict[str, str]) -> DataFrame:
    """``binarize``: a relation of many arguments becomes one of two for each role, under the role's own predicate."""
    hit = F.coalesce(_matches(predicate, [subject]), F.lit(False))
    made = F.array(*[F.when(F.map_contains_key("args", r), F.struct(F.lit(name).alias("predicate"), F.create_map(F.lit(subject), F.element_at("args", F.lit(subject)), F.lit(r), F.element_at("args", F.lit(r))).alias("args"))) for r, name in roles.items()])
    out = relations.where(hit).select("rel_id", "sources", F.inline(F.filter(made, lambda x: x.isNotNull()))).select(F.concat_ws(".", "rel_id", "predicate").alias("rel_id"), "predicate", "args", "sources")
    return relations.where(~hit).unionByName(out)


def generate_individual(relations: DataFrame, predicate: str, role: str, kind: str) -> DataFrame:
    """``generate-individual``: adds a role whose value is a new individual, named by a digest of the relation's id."""
    name = F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("|", "rel_id", F.lit(role)), 256), 1, 16))
    return relations.withColumn("args", F.when(F.col("predicate") == predicate, F.map_concat("args", F.create_map(F.lit(role), name))).otherwise(F.col("args")))


def triples(relations: DataFrame, predicate: str, subject: str, object_: str) -> DataFrame:
    """``make-triple``: ``subject, predicate, object`` of the relations that have both roles."""
    return relations.where(_matches(predicate, [subject, object_])).select(F.element_at("args", F.lit(subject)).alias("subject"), "predicate", F.element_at("args", F.lit(object_)).alias("object"))


def delete(relations: DataFrame, predicate: str, having: dict[str, str] | None = None) -> DataFrame:
    """``delete``: without the relations of a predicate, of these values if given."""
    hit = F.col("predicate") == predicate
    for role, value in (having or {}).items():
        hit = hit & (F.element_at("args", F.lit(role)) == value)
    return relations.where(~F.coalesce(hit, F.lit(False)))


def caught(relations: DataFrame, before: DataFrame) -> DataFrame:
    """``catch``: the relations that no rule has touched, by id and predicate."""
    return relations.join(before.select("rel_id", "predicate"), ["rel_id", "predicate"], "left_semi")


def without_repeats(relations: DataFrame) -> DataFrame:
    """One relation of each predicate and arguments: the one of the smallest id; repeated values of a role count once by being a map."""
    key = F.array_sort(F.map_entries("args"))
    return relations.groupBy("predicate", key.alias("k")).agg(F.min("rel_id").alias("rel_id"), F.min_by("sources", "rel_id").alias("sources")).select("rel_id", "predicate", F.map_from_entries("k").alias("args"), "sources")


def removed(relations: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """A removal filter: relations that ``other`` has no match for."""
    return relations.join(other.select(*on).distinct(), on, "left_anti")


def inferred(relations: DataFrame, rule: DataFrame) -> DataFrame:
    """An adding filter: the relations that a rule gives and that are not there yet."""
    on = [c for c in relations.columns if c != "rel_id"]
    return relations.unionByName(rule.join(relations.select(*on), on, "left_anti"), allowMissingColumns=True)


def orderly_lives(dates: DataFrame) -> DataFrame:
    """Dated relations ``person, kind, day`` without conflict: a kind of one day only (birth, death) keeps nothing if it has several; nothing lies before birth or after death."""
    one = dates.where(F.col("kind").isin("birth", "death")).groupBy("person", "kind").agg(F.countDistinct("day").alias("n"), F.min("day").alias("day")).where("n = 1")
    lives = one.groupBy("person").agg(F.max(F.when(F.col("kind") == "birth", F.col("day"))).alias("born"), F.max(F.when(F.col("kind") == "death", F.col("day"))).alias("died"))
    sure = dates.where(~F.col("kind").isin("birth", "death")).unionByName(one.select("person", "kind", "day"))
    return sure.join(lives, "person", "left").where("(born is null or day >= born) and (died is null or day <= died)").select("person", "kind", "day")


def holds_throughout(spans: DataFrame) -> DataFrame:
    """Spans ``key, start, end`` of one fact that touch or overlap, as one span."""
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("start") > F.date_add(F.max("end").over(before), 1)).cast("int"), F.lit(1))
    return spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(Window.partitionBy("key").orderBy("start", "end"))).groupBy("key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def promoted(mentions: DataFrame, across_types: bool = False, events: DataFrame | None = None) -> DataFrame:
    """Relations of documents from mentions ``doc_id, mention, left, right, type, anchor``: by ends and, unless ``across_types``, by type.

    Identities, mentions without both ends, those of a thing with itself, and those whose anchor is that of an event are left out.
    """
    kept = mentions.where("left is not null and right is not null and left <> right").where(F.col("type") != "IDENTITY")
    if events is not None:
        kept = kept.join(events.select("doc_id", "anchor").distinct(), ["doc_id", "anchor"], "left_anti")
    by = ["doc_id", "left", "right", *([] if across_types else ["type"])]
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.min("mention").alias("first_mention"), F.min_by("type", "mention").alias("first_type"))


def promoted_values(values: DataFrame) -> DataFrame:
    """Values of documents from value mentions ``doc_id, type, text, mention``: one for each normalized text."""
    return values.groupBy("doc_id", "type", F.lower(F.trim("text")).alias("value")).agg(F.count("*").alias("n"), F.min("mention").alias("first_mention"))


def linked_events(mentions: DataFrame, least: int) -> DataFrame:
    """``event_id, component``: event mentions of a document and type that share ``least`` arguments, and whatever these link."""
    rows = mentions.select("doc_id", "type", "event_id", F.explode(F.array_distinct("args")).alias("arg"))
    a, b = rows.withColumnRenamed("event_id", "a"), rows.withColumnRenamed("event_id", "b")
    pairs = a.join(b, ["doc_id", "type", "arg"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = connected_components(pairs).withColumnRenamed("node", "event_id")
    return mentions.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("component", "event_id").alias("component"))


def consistent_date(votes: DataFrame) -> DataFrame:
    """``key, value, n``: of TIMEX values that say the same at different precision, the most precise of the set with most votes.

    A value belongs to the set of every more precise value that begins with it; ties go to the longer, then the smaller value.
    """
    counts = votes.groupBy("key", "value").agg(F.count("*").alias("n"))
    coarse = counts.select("key", F.col("value").alias("short"), F.col("n").alias("m"))
    # a date has few precisions: join by its own prefixes
    prefixes = F.array_distinct(F.array(F.substring("value", 1, 4), F.substring("value", 1, 7), F.col("value")))
    sets = counts.select("key", "value", F.explode(prefixes).alias("short")).join(coarse, ["key", "short"]).groupBy("key", "value").agg(F.sum("m").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.length("value")).alias("size"), "value"))
    return sets.groupBy("key").agg(best.alias("b")).select("key", F.col("b.value").alias("value"), (-F.col("b.n")).alias("n"))


def profile_confidence(facts: DataFrame, tables: dict[str, DataFrame], weights: dict[str, float], bins: list[float]) -> DataFrame:
    """``slot, hypothesis, confidence, bin``: the best of a hypothesis' facts by weighted correctness of their features.

    ``tables``: for each feature ``slot, value, correctness``; 0.5 for a value that has none. A hypothesis of over ten
    facts has 0.95 at least. ``bin``: how many of the thresholds it reaches.
    """
    for name, known in tables.items():
        facts = facts.join(F.broadcast(known.select("slot", F.col("value").alias(name), F.col("correctness").alias(f"_{name}"))), ["slot", name], "left")
    total = sum((F.coalesce(f"_{n}", F.lit(0.5)) * w for n, w in weights.items()), F.lit(0.0))
    out = facts.withColumn("_c", total).groupBy("slot", "hypothesis").agg(F.max("_c").alias("_c"), F.count("*").alias("n"))
    confidence = F.when(F.col("n") > 10, F.greatest("_c", F.lit(0.95))).otherwise(F.col("_c"))
    reached = sum((F.when(F.col("confidence") >= b, 1).otherwise(0) for b in bins), F.lit(0))
    return out.withColumn("confidence", confidence).select("slot", "hypothesis", "confidence", reached.alias("bin"))


def cut_profile(ranked: DataFrame, most: int, single: list[str]) -> DataFrame:
    """Hypotheses ``slot, hypothesis, rank, n_reliable, risky``, cut: ``most`` a slot; in the ``single`` slots a second one only with ten reliable facts and 0.3 of the first one's; risky ones not after five."""
    first = F.max(F.when(F.col("rank") == 1, F.col("n_reliable"))).over(Window.partitionBy("slot"))
    rows = ranked.withColumn("_first", first)
    second = (F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("n_reliable") >= 10) & (F.col("n_reliable") >= 0.3 * F.col("_first")))
    rows = rows.where((~F.col("slot").isin(single)) | second)
    return rows.where((F.col("rank") <= most) & ((F.col("rank") <= 5) | ~F.col("risky"))).drop("_first")


def merged_snippets(matches: DataFrame) -> DataFrame:
    """Matches ``doc_id, id, start, end, score`` without those that repeat a better one.

    A match goes if one of the same span, or one that holds it and is less than a fifth longer, scores more, or as much and has a smaller id.
    """
    size = F.col("end") - F.col("start") + 1
    a = matches.withColumn("_size", size)
    b = matches.select(F.col("doc_id").alias("d"), F.col("id").alias("i"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("score").alias("c"), size.alias("z"))
    near = (F.col("doc_id") == F.col("d")) & (((F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")) & (F.col("z") < 1.2 * F.col("_size"))) | ((F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e")) & (F.col("_size") < 1.2 * F.col("z"))))
    better = (F.col("c") > F.col("score")) | ((F.col("c") == F.col("score")) & (F.col("i") < F.col("id")))
    return a.join(b, near & better, "left_anti").drop("_size")


def pattern_scores(matches: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """``instance, score``: the logistic of the sum of the weights of an instance's features, above the threshold."""
    total = matches.join(weights, "feature").groupBy("instance").agg(F.sum("weight").alias("x"))
    return total.select("instance", (1 / (1 + F.exp(-F.col("x")))).alias("score")).where(F.col("score") > threshold)


def best_names(mentions: DataFrame) -> DataFrame:
    """``entity_id, name``: of an entity's mentions a name before a description before a pronoun, then the surer, then the longer, then the first."""
    rank = F.when(F.col("mention_type") == "NAME", 0).when(F.col("mention_type") == "DESC", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), (-F.length("text")).alias("l"), "mention_id", "text"))
    return mentions.where("entity_id is not null").groupBy("entity_id").agg(best.alias("b")).select("entity_id", F.col("b.text").alias("name"))


def negative_examples(candidates: DataFrame, positives: DataFrame, key: str, one_in: int) -> DataFrame:
    """Candidates that are no positives, one in ``one_in`` of them by the hash of the key: a sampling operator."""
    return candidates.join(positives.select(key), key, "left_anti").where(F.crc32(F.col(key).cast("string")) % one_in == 0)


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"))
    args = F.map_from_entries(F.filter(F.array(F.struct(F.lit("part"), F.concat(F.lit("p"), "p")), F.struct(F.lit("supplier"), F.concat(F.lit("s"), "s")), F.when(F.col("p") % 3 != 0, F.struct(F.lit("order"), F.concat(F.lit("o"), "l_orderkey")))), lambda x: x.isNotNull()))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("rel_id"), F.col("f").alias("predicate"), args.alias("args"), F.array(F.lit("text")).alias("sources"))


def _shown(relations: DataFrame) -> DataFrame:
    return relations.select("rel_id", "predicate", F.array_join(F.array_sort(F.transform(F.map_entries("args"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("args"), F.array_join("sources", ",").alias("sources"))


def _q_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rename(_relations(spark, sf_dir), "A", "offers", {"supplier": "seller", "part": "goods", "order": None}, "m1")
    return _shown(delete(retype(out, "N", "part", "Thing"), "R", {"supplier": "s1"}))


def _q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = split(_relations(spark, sf_dir), "A", [("sold-by", {"part": "goods", "supplier": "seller"}), ("ordered", {"part": "goods", "order": "order"}), ("lone", {"part": "goods"})], False, "m2")
    return _shown(binarize(out, "N", "part", {"supplier": "from", "order": "in"}))


def _q_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = generate_individual(_relations(spark, sf_dir), "R", "return", "Return")
    return triples(r, "R", "return", "part").select(F.length("subject").alias("n"), "predicate", "object").unionByName(triples(r, "N", "supplier", "order").select(F.length("subject").alias("n"), "predicate", "object"))


def _q_unrepeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = rename(_relations(spark, sf_dir), "N", "N", {"order": None, "supplier": None}, "m3")
    return _shown(without_repeats(short))


def _q_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 10 == 0, "birth").when(F.col("o_orderkey") % 10 == 1, "death").otherwise("held")
    return orderly_lives(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), kind.alias("kind"), F.to_date("o_orderdate").alias("day")).distinct())


def _q_throughout(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 200).cast("int")).alias("end"))
    return holds_throughout(o)


def _mentions_of_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("mention"), F.when(F.col("l_linenumber") != 7, F.col("l_partkey") % 10).alias("left"), (F.col("l_orderkey") % 10).alias("right"), F.when(F.col("l_returnflag") == "A", "IDENTITY").otherwise(F.col("l_returnflag")).alias("type"), F.col("l_linenumber").alias("anchor"))


def _q_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 5).cast("int").alias("anchor"))
    return promoted(_mentions_of_relations(spark, sf_dir), True, events)


def _q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return promoted_values(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("type"), F.concat(F.lit(" V"), (F.col("l_partkey") % 3).cast("string")).alias("text"), F.col("l_partkey").alias("mention")))


def _q_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("args"))
    m = li.select((F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_orderkey") % 3).alias("type"), F.col("l_orderkey").alias("event_id"), "args")
    return linked_events(m, 2)


def _q_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    value = F.date_format("o_orderdate", "yyyy-MM-dd")
    return consistent_date(o.select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, F.substring(value, 1, 4)).when(F.col("o_orderkey") % 3 == 1, F.substring(value, 1, 7)).otherwise(value).alias("value")))


def _q_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    facts = li.select(F.col("l_returnflag").alias("slot"), F.col("l_suppkey").alias("hypothesis"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"))
    known = {"status": li.groupBy(F.col("l_returnflag").alias("slot"), F.col("l_linestatus").alias("value")).agg(F.round(F.avg("l_tax") * 10, 4).alias("correctness")), "line": li.where("l_linenumber < 5").groupBy(F.col("l_returnflag").alias("slot"), F.col("l_linenumber").alias("value")).agg(F.round(F.avg("l_discount") * 10, 4).alias("correctness"))}
    return profile_confidence(facts, known, {"status": 0.5, "line": 0.5}, [0.4, 0.5, 0.9]).withColumn("confidence", F.round("confidence", 6))


def _q_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("slot"), F.col("l_suppkey").alias("hypothesis")).agg(F.count("*").alias("n_facts"), F.count_if(F.col("l_linestatus") == "F").alias("n_reliable"))
    ranked = li.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n_facts"), "hypothesis"))).withColumn("risky", F.col("hypothesis") % 2 == 0)
    return cut_profile(ranked, 8, ["A"])


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), (((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 10000) + F.col("l_suppkey")).alias("id"), (F.col("l_linenumber") * 2).alias("start"), (F.col("l_linenumber") * 2 + F.col("l_quantity").cast("int")).alias("end"), F.round("l_discount", 2).alias("score")).distinct()


def _q_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_snippets(_spans(spark, sf_dir))


def _q_pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    out = pattern_scores(li.select(F.col("l_orderkey").alias("instance"), F.col("l_partkey").alias("feature")), part.select(F.col("p_partkey").alias("feature"), ((F.col("p_size") - 25) / 20).alias("weight")), 0.55)
    return out.withColumn("score", F.round("score", 6))


def _q_best_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived.annotation_tables(spark, sf_dir)["mention"]
    return best_names(m.withColumn("confidence", (F.col("mention_id") % 7) / 7))


def _q_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_examples(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", 10)


_R = """r AS (SELECT l_orderkey || '-' || l_linenumber AS rel_id, min(l_returnflag) AS f, 'p' || min(l_partkey) AS p, 's' || min(l_suppkey) AS s, CASE WHEN min(l_partkey) % 3 <> 0 THEN 'o' || l_orderkey END AS o FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber)"""
QUERIES = {
    "relation_rename": _q_renamed, "relation_split": _q_split, "relation_triples": _q_triples, "relation_repeats": _q_unrepeated, "life_dates": _q_lives, "holds_throughout": _q_throughout, "promoted_relations": _q_promoted, "promoted_values": _q_values,
    "event_linking": _q_linked, "date_votes": _q_dates, "profile_confidence": _q_confidence, "profile_cutoff": _q_cut, "snippet_merging": _q_snippets, "pattern_scores": _q_pattern_scores, "best_names": _q_best_names, "negative_examples": _q_negatives,
}
ORACLE_SQL = {
    "relation_rename": f"""WITH {_R} SELECT rel_id, CASE WHEN f = 'A' AND o IS NOT NULL THEN 'offers' ELSE f END AS predicate,
            CASE WHEN f = 'A' AND o IS NOT NULL THEN 'goods=' || p || ',seller=' || s ELSE concat_ws(',', 'order=' || o, 'part=' || CASE WHEN f = 'N' THEN 'Thing:' ELSE '' END || p, 'supplier=' || s) END AS args,
            CASE WHEN f = 'A' AND o IS NOT NULL THEN 'text,m1' ELSE 'text' END AS sources FROM r WHERE NOT (f = 'R' AND s = 's1')""",
    "relation_split": f"""WITH {_R} SELECT rel_id, f AS predicate, concat_ws(',', 'order=' || o, 'part=' || p, 'supplier=' || s) AS args, 'text' AS sources FROM r WHERE f = 'R' OR (f = 'A' AND o IS NULL)
        UNION ALL SELECT rel_id || '.1', 'sold-by', 'goods=' || p || ',seller=' || s, 'text,m2' FROM r WHERE f = 'A' AND o IS NOT NULL UNION ALL SELECT rel_id || '.2', 'ordered', 'goods=' || p || ',order=' || o, 'text,m2' FROM r WHERE f = 'A' AND o IS NOT NULL
        UNION ALL SELECT rel_id || '.from', 'from', 'part=' || p || ',supplier=' || s, 'text' FROM r WHERE f = 'N' UNION ALL SELECT rel_id || '.in', 'in', 'order=' || o || ',part=' || p, 'text' FROM r WHERE f = 'N' AND o IS NOT NULL""",
    "relation_triples": f"WITH {_R} SELECT 23::INT AS n, 'R' AS predicate, p AS object FROM r WHERE f = 'R' UNION ALL SELECT length(s)::INT, 'N', o FROM r WHERE f = 'N' AND o IS NOT NULL",
    "relation_repeats": f"""WITH {_R}, x AS (SELECT rel_id, f AS predicate, CASE WHEN f = 'N' AND o IS NOT NULL THEN 'part=' || p ELSE concat_ws(',', 'order=' || o, 'part=' || p, 'supplier=' || s) END AS args, CASE WHEN f = 'N' AND o IS NOT NULL THEN 'text,m3' ELSE 'text' END AS sources FROM r)
        SELECT min(rel_id) AS rel_id, predicate, args, arg_min(sources, rel_id) AS sources FROM x GROUP BY predicate, args""",
    "life_dates": """WITH d AS (SELECT DISTINCT o_custkey AS person, CASE o_orderkey % 10 WHEN 0 THEN 'birth' WHEN 1 THEN 'death' ELSE 'held' END AS kind, o_orderdate::DATE AS day FROM orders),
        u AS (SELECT person, kind, min(day) AS day FROM d WHERE kind <> 'held' GROUP BY 1, 2 HAVING count(DISTINCT day) = 1), a AS (SELECT * FROM d WHERE kind = 'held' UNION ALL SELECT * FROM u)
        SELECT a.* FROM a LEFT JOIN u b ON b.person = a.person AND b.kind = 'birth' LEFT JOIN u c ON c.person = a.person AND c.kind = 'death' WHERE (b.day IS NULL OR a.day >= b.day) AND (c.day IS NULL OR a.day <= c.day)""",
    "holds_throughout": """WITH o AS (SELECT o_custkey AS key, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 200)::INT AS e FROM orders),
        n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM o),
        g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT key, min(s) AS start, max(e) AS "end" FROM g GROUP BY key, run""",
    "promoted_relations": """WITH m AS (SELECT l_suppkey AS doc_id, l_orderkey * 1000000 + l_partkey AS mention, CASE WHEN l_linenumber <> 7 THEN l_partkey % 10 END AS l, l_orderkey % 10 AS r, l_returnflag AS type, l_linenumber AS anchor FROM lineitem WHERE l_returnflag <> 'A')
        SELECT doc_id, l AS "left", r AS "right", count(*) AS n, min(mention) AS first_mention, arg_min(type, mention) AS first_type FROM m WHERE l IS NOT NULL AND l <> r AND anchor <> doc_id % 5 GROUP BY 1, 2, 3""",
    "promoted_values": "SELECT l_orderkey AS doc_id, l_returnflag AS type, 'v' || (l_partkey % 3) AS value, count(*) AS n, min(l_partkey) AS first_mention FROM lineitem GROUP BY 1, 2, 3",
    "event_linking": """WITH RECURSIVE a AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS s FROM lineitem), p AS (SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON x.s = y.s AND x.id <> y.id AND x.id % 100 = y.id % 100 AND x.id % 3 = y.id % 3 GROUP BY 1, 2 HAVING count(*) >= 2),
        t AS (SELECT DISTINCT id, id AS r FROM a UNION SELECT t.id, p.b FROM t JOIN p ON p.a = t.r) SELECT id AS event_id, min(r) AS component FROM t GROUP BY 1""",
    "date_votes": """WITH v AS (SELECT o_custkey AS key, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders), c AS (SELECT key, value, count(*) AS n FROM v GROUP BY 1, 2),
        s AS (SELECT a.key, a.value, sum(b.n)::BIGINT AS n FROM c a JOIN c b ON a.key = b.key AND starts_with(a.value, b.value) GROUP BY 1, 2) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, length(value) DESC, value) = 1""",
    "profile_confidence": """WITH a AS (SELECT l_returnflag AS slot, l_linestatus AS v, round(avg(l_tax) * 10, 4) AS c FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag AS slot, l_linenumber AS v, round(avg(l_discount) * 10, 4) AS c FROM lineitem WHERE l_linenumber < 5 GROUP BY 1, 2),
        f AS (SELECT l_returnflag AS slot, l_suppkey AS hypothesis, max(0.5 * coalesce(a.c, 0.5) + 0.5 * coalesce(b.c, 0.5)) AS c, count(*) AS n FROM lineitem LEFT JOIN a ON a.slot = l_returnflag AND a.v = l_linestatus LEFT JOIN b ON b.slot = l_returnflag AND b.v = l_linenumber GROUP BY 1, 2),
        g AS (SELECT slot, hypothesis, CASE WHEN n > 10 THEN greatest(c, 0.95) ELSE c END AS c FROM f) SELECT slot, hypothesis, round(c, 6) AS confidence, ((c >= 0.4)::INT + (c >= 0.5)::INT + (c >= 0.9)::INT)::INT AS bin FROM g""",
    "profile_cutoff": """WITH h AS (SELECT l_returnflag AS slot, l_suppkey AS hypothesis, count(*) AS n_facts, count(*) FILTER (WHERE l_linestatus = 'F') AS n_reliable FROM lineitem GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n_facts DESC, hypothesis)::INT AS rank, hypothesis % 2 = 0 AS risky FROM h), f AS (SELECT r.*, (SELECT n_reliable FROM r q WHERE q.slot = r.slot AND q.rank = 1) AS k FROM r)
        SELECT slot, hypothesis, n_facts, n_reliable, rank, risky FROM f WHERE (slot <> 'A' OR rank = 1 OR (rank = 2 AND n_reliable >= 10 AND n_reliable >= 0.3 * k)) AND rank <= 8 AND (rank <= 5 OR NOT risky)""",
    "snippet_merging": """WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, (l_partkey * 10 + l_linenumber) * 10000 + l_suppkey AS id, l_linenumber * 2 AS start, (l_linenumber * 2 + trunc(l_quantity))::INT AS e, round(l_discount, 2) AS score FROM lineitem)
        SELECT doc_id, id, start, e AS "end", score FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = a.doc_id AND ((b.start <= a.start AND b.e >= a.e AND b.e - b.start + 1 < 1.2 * (a.e - a.start + 1)) OR (a.start <= b.start AND a.e >= b.e AND a.e - a.start + 1 < 1.2 * (b.e - b.start + 1)))
            AND (b.score > a.score OR (b.score = a.score AND b.id < a.id)))""",
    "pattern_scores": "SELECT l_orderkey AS instance, round(1 / (1 + exp(-sum((p_size - 25) / 20))), 6) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING 1 / (1 + exp(-sum((p_size - 25) / 20))) > 0.55",
    "best_names": f"""WITH {derived.SQL} SELECT entity_id, text AS name FROM mention WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY CASE mention_type WHEN 'NAME' THEN 0 WHEN 'DESC' THEN 1 ELSE 2 END, (mention_id % 7) / 7 DESC, length(text) DESC, mention_id) = 1""",
}
