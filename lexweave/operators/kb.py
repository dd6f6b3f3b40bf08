"""Knowledge-base queries: validity joins, hierarchies, alternatives, best rows, and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.timex import valid_at
from lexweave.session import durable, shuffle_partitions, table


def validity_join(left: DataFrame, links: DataFrame, key: str, day: Column, start: str, end: str) -> DataFrame:
    """Rows of both sides with equal ``key`` whose link is valid on ``day``; the bounds are strict and open where null."""
    return left.join(links, key).where(valid_at(F.col(start), F.col(end), day))


def ancestors(nodes: DataFrame, bins: int) -> DataFrame:
    """``id, ancestor`` of a nested set ``id, lft, rgt``: every node that encloses a node, itself included.

    Enclosing intervals are dealt to the bins of ``lft`` that they span, so this is a join by bin and not a
    comparison of all pairs.
    """
    child = nodes.select("id", F.col("lft").alias("l"), F.col("rgt").alias("r"), F.floor(F.col("lft") / bins).alias("bin"))
    above = nodes.select(F.col("id").alias("ancestor"), "lft", "rgt", F.explode(F.sequence(F.floor(F.col("lft") / bins), F.floor(F.col("rgt") / bins))).alias("bin"))
    return child.join(above, "bin").where("lft <= l and rgt >= r").select("id", "ancestor").distinct()


def closure(parents: DataFrame) -> DataFrame:
    """``id, ancestor, depth`` for all chains of ``id, parent``; ``depth`` is the least number of steps, 1 for a parent.

    Chains double in length with every round, so a round is two joins by key and their number grows with the
    logarithm of the longest chain; cycles end as a pair keeps its least depth. Null ends are ignored.
    """
    known = durable(parents.where("id is not null and parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    size = known.agg(F.count("*"), F.sum("depth")).first()
    while True:
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        known = durable(known.unionByName(further).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        new = known.agg(F.count("*"), F.sum("depth")).first()
        if new == size:
            return known
        size = new


def common_ancestors(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, ancestor, steps``: the nearest common ancestor of pairs of nodes, themselves included; ties to the smallest."""
    up = closure(parents)
    nodes = parents.select(F.explode(F.array("id", "parent")).alias("id")).where("id is not null").distinct()
    known = up.unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    a, b = (known.select(F.col("id").alias(k), "ancestor", F.col("depth").alias(f"d_{k}")) for k in ("a", "b"))
    met = pairs.select("a", "b").distinct().join(a, "a").join(b, ["b", "ancestor"])
    best = F.min(F.struct((F.col("d_a") + F.col("d_b")).alias("steps"), "ancestor"))
    return met.groupBy("a", "b").agg(best.alias("n")).select("a", "b", "n.ancestor", "n.steps")


def linked_mentions(mentions: DataFrame) -> DataFrame:
    """``mention_id, linked``: names of a document and type with equal head words are one thing, named by its first; a pronoun or description is the last name of its type before it."""
    name = F.when(F.col("mention_type") == "NAME", F.min("mention_id").over(Window.partitionBy("doc_id", "type", "headword", "mention_type")))
    before = Window.partitionBy("doc_id", "type").orderBy("mention_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return mentions.withColumn("_name", name).select("mention_id", F.coalesce(F.last("_name", ignorenulls=True).over(before), F.col("mention_id")).alias("linked"))


def either_join(left: DataFrame, right: DataFrame, one: str, other: str, key: str) -> DataFrame:
    """``left`` joined with ``right`` where either of two columns equals ``key``: two joins by key.

    A pair that meets both ways comes once; repeated rows stay repeated, as in a join with OR.
    """
    again = F.coalesce(F.col(one) == F.col(key), F.lit(False))
    return left.join(right, F.col(one) == F.col(key)).unionByName(left.join(right, F.col(other) == F.col(key)).where(~again))


def best_row(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order; a window, as the order may be of any columns and directions."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where ``changes`` has the key, by null too; of several changes of a key the greatest value counts, nulls last."""
    new = changes.groupBy(F.col(key).alias("_key")).agg(F.max(column).alias("_new"))
    found = F.col("_key").isNotNull()
    return rows.join(new, F.col(key) == F.col("_key"), "left").withColumn(column, F.when(found, F.col("_new")).otherwise(F.col(column))).drop("_key", "_new")


def inserted(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of ``more`` whose key they lack."""
    return rows.unionByName(more.join(rows.select(key), key, "left_anti").select(*rows.columns))


def page(rows: DataFrame, order: list[Column], start: int, n: int) -> DataFrame:
    return rows.orderBy(*order).offset(start).limit(n)


def unspecified(c: Column, kind: str) -> Column:
    """Null as the typed getters give it: -1, -1.0, false or the empty string."""
    return F.coalesce(c, {"int": F.lit(-1), "double": F.lit(-1.0), "bool": F.lit(False), "string": F.lit("")}[kind])


def _day(c: str) -> Column:
    return F.to_date(c)


def _q_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", _day("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") != "O", F.date_add(_day("o_orderdate"), 400)).alias("end"))
    actors = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return validity_join(actors, links, "c_custkey", F.lit("1998-06-01").cast("date"), "start", "end").select("c_custkey", "c_name", "o_orderkey")


def _q_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), (F.col("r_regionkey") * 100).alias("lft"), (F.col("r_regionkey") * 100 + 99).alias("rgt"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), (F.col("n_regionkey") * 100 + 1 + 2 * F.col("n_nationkey")).alias("lft"), (F.col("n_regionkey") * 100 + 2 + 2 * F.col("n_nationkey")).alias("rgt"))
    return ancestors(region.unionByName(nation), 50)


def _q_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(t: str, a: str, p: str, b: str, q: str) -> DataFrame:
        return table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("id"), F.concat(F.lit(q), F.col(b).cast("string")).alias("parent"))

    edges = edge("orders", "o_orderkey", "o", "o_custkey", "c").unionByName(edge("customer", "c_custkey", "c", "c_nationkey", "n")).unionByName(edge("nation", "n_nationkey", "n", "n_regionkey", "r"))
    return closure(edges).groupBy("ancestor", "depth").agg(F.count("*").alias("n"))


def _q_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = nation.select(F.col("n_name").alias("id"), (F.col("n_regionkey") + 100).cast("string").alias("parent")).unionByName(region.select((F.col("r_regionkey") + 100).cast("string").alias("id"), F.lit("world").alias("parent")))
    pairs = nation.select(F.col("n_name").alias("a"), (F.col("n_nationkey") % 5).alias("k")).join(nation.select(F.col("n_name").alias("b"), (F.col("n_nationkey") % 5).alias("k")), "k").where("a <= b")
    return common_ancestors(edges, pairs)


def _q_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.plans.derived import annotation_tables

    return linked_mentions(annotation_tables(spark, sf_dir)["mention"].groupBy("mention_id", "doc_id", "mention_type", "headword").agg(F.min("type").alias("type")))


def _q_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 25).cast("int").alias("other_key"))
    c = c.unionByName(c.where("c_custkey % 7 = 0"))
    return either_join(c, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "c_nationkey", "other_key", "n_nationkey").select("c_custkey", "n_name")


def _q_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Richest customer of each nation, ties to the highest id; one pass with map-side combining."""
    best = F.max(F.struct("c_acctbal", "c_custkey", "c_name"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(best.alias("b")).select("c_nationkey", F.col("b.c_custkey"), F.col("b.c_name"), F.col("b.c_acctbal"))


def _q_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.avg("p_size").cast("long").alias("size"), F.count("*").alias("n"))


def _q_in_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = o.where("o_orderpriority = '1-URGENT'").select("o_custkey").union(o.where("o_totalprice > 400000").select("o_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(keys, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def _q_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select("s_nationkey", "s_suppkey")
    return table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", unspecified(F.col("s_suppkey"), "int").cast("long").alias("s_suppkey"))


def _q_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    met = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).where("c_mktsegment is not null")
    return met.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


def _q_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.endswith("p_name", F.lit(" ring"))).select("p_name").distinct()


def _q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 50)


def _q_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return updated(s, s.where("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, 0.0).alias("s_acctbal")), "s_suppkey", "s_acctbal")


def _q_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return inserted(s, c, "id")


def _q_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.count("p_partkey").alias("n"), F.max("p_partkey").alias("most"), (F.max("p_partkey") + 1 == F.count("p_partkey")).alias("dense"))


def close_pairs(rows: DataFrame, by: list[str], size: str, most: int) -> DataFrame:
    """``a, b, gap``: pairs ``a < b`` of ids of equal ``by`` whose integer ``size`` differs by ``gap``, ``most`` at most.

    Sizes meet by equality, the smaller moved up by each gap, so hardly a pair is made that is not wanted. There may be
    far more pairs than rows, so the rows of however small a table are dealt to all cores, and none go to the driver.
    """
    parts = max(shuffle_partitions(rows.sparkSession), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    x = rows.select(F.col("id").alias("x"), *by, F.col(size).cast("long").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("gap")).withColumn("_at", F.col("_at") + F.col("gap"))
    y = rows.select(F.col("id").alias("y"), *by, F.col(size).cast("long").alias("_at"))
    x, y = (z.repartition(parts, *by, "_at") for z in (x, y))
    met = x.join(y.hint("merge"), [*by, "_at"]).where((F.col("gap") > 0) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "gap")


def _q_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size")
    # sizes over 5 apart score less than 0.9; the score of a gap is a constant and not rounded for each pair
    scores = F.element_at(F.array(*[F.round(1 - F.lit(k) / 50, 6) for k in range(6)]), F.col("gap") + 1)
    return close_pairs(p, ["p_brand", "p_type"], "p_size", 5).select("a", "b", scores.alias("score"))


QUERIES = {"validity_join": _q_valid, "nested_set_ancestors": _q_nested, "parent_chain": _q_chain, "either_join": _q_either, "common_ancestors": _q_common, "mention_linking": _q_linked, "largest_per_group": _q_best, "average_duplicates": _q_average, "in_union": _q_in_union, "left_join": _q_left, "three_way_join": _q_three, "name_suffix": _q_suffix, "limit_offset": _q_page, "row_update": _q_update, "insert_missing": _q_insert, "density_check": _q_dense, "alias_self_join": _q_alias}
ORACLE_SQL = {
    "validity_join": "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS s, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 400 END AS e FROM orders) ON c_custkey = o_custkey WHERE s < DATE '1998-06-01' AND (e IS NULL OR e > DATE '1998-06-01')",
    "nested_set_ancestors": """WITH n AS (SELECT r_name AS id, r_regionkey * 100 AS l, r_regionkey * 100 + 99 AS r FROM region UNION ALL SELECT n_name, n_regionkey * 100 + 1 + 2 * n_nationkey, n_regionkey * 100 + 2 + 2 * n_nationkey FROM nation)
        SELECT DISTINCT c.id, p.id AS ancestor FROM n c, n p WHERE p.l <= c.l AND p.r >= c.r""",
    "parent_chain": """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS parent FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
        t AS (SELECT id, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT t.id, e.parent, depth + 1 FROM t JOIN e ON e.id = t.ancestor)
        SELECT ancestor, depth, count(*) AS n FROM t GROUP BY 1, 2""",
    "common_ancestors": """WITH n AS (SELECT n_name AS id, (n_regionkey + 100)::VARCHAR AS p, n_nationkey % 5 AS k FROM nation) SELECT x.id AS a, y.id AS b, CASE WHEN x.id = y.id THEN x.id WHEN x.p = y.p THEN x.p ELSE 'world' END AS ancestor,
        CASE WHEN x.id = y.id THEN 0 WHEN x.p = y.p THEN 2 ELSE 4 END AS steps FROM n x JOIN n y USING (k) WHERE x.id <= y.id""",
    "mention_linking": """WITH m AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS i, l_orderkey AS doc, min(l_returnflag) AS t, l_linenumber % 3 = 1 AS nm, l_partkey % 50 AS h FROM lineitem GROUP BY ALL),
        n AS (SELECT *, CASE WHEN nm THEN min(i) OVER (PARTITION BY doc, t, h, nm) END AS k FROM m) SELECT i AS mention_id, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY doc, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), i) AS linked FROM n""",
    "either_join": "SELECT c_custkey, n_name FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 7 = 0) JOIN nation ON c_nationkey = n_nationkey OR c_custkey % 25 = n_nationkey",
    "largest_per_group": "SELECT c_nationkey, c_custkey, c_name, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1",
    "average_duplicates": "SELECT p_name, trunc(avg(p_size))::BIGINT AS size, count(*) AS n FROM part GROUP BY 1",
    "in_union": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "left_join": "SELECT n_name, coalesce(s_suppkey, -1) AS s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON n_nationkey = s_nationkey",
    "three_way_join": "SELECT r_name, c_mktsegment, count(*) AS n FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_mktsegment IS NOT NULL GROUP BY 1, 2",
    "name_suffix": "SELECT DISTINCT p_name FROM part WHERE p_name LIKE '% ring'",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100",
    "row_update": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 0.0 WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier",
    "insert_missing": "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "density_check": "SELECT count(p_partkey) AS n, max(p_partkey) AS most, max(p_partkey) + 1 = count(p_partkey) AS dense FROM part",
    "alias_self_join": "SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - abs(a.p_size - b.p_size) / 50, 6) AS score FROM part a JOIN part b USING (p_brand, p_type) WHERE a.p_partkey < b.p_partkey AND round(1 - abs(a.p_size - b.p_size) / 50, 6) >= 0.9",
}
