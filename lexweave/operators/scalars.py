"""Text, date and number functions over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import english, mathx, text, timex
from lexweave.operators.sentences import sentences
from lexweave.session import table


def token_table(sentences_: DataFrame) -> DataFrame:
    """``doc_id, sent_no, tok_no, token`` by the English tokenizer."""
    return sentences_.select("doc_id", "sent_no", F.posexplode(english.udf(english.english_tokens, "array<string>")(F.col("sentence"))).alias("tok_no", "token"))


def token_counts(sentences_: DataFrame) -> DataFrame:
    """``doc_id, sent_no, n, last``: the number of tokens of each sentence and the greatest; counted in its row before sentences of one number meet."""
    rows = sentences_.select("doc_id", "sent_no", english.udf(english.english_tokens, "array<string>")(F.col("sentence")).alias("t"))
    return rows.select("doc_id", "sent_no", F.size("t").alias("n"), F.array_max("t").alias("last")).groupBy("doc_id", "sent_no").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def rule_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sent_no, sentence`` by the rules of ``english.sentence_spans``."""
    cut = english.udf(english.sentences_of, "array<string>")
    return docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("sent_no", "sentence"))


def prose_zones(docs: DataFrame) -> DataFrame:
    """``doc_id, region_no, start, end, prose``: stretches of prose and of none."""
    cut = english.udf(lambda t: [{"start": a, "end": b, "prose": p} for a, b, p in english.prose_regions(t)], "array<struct<start int, end int, prose boolean>>")
    return docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("region_no", "r")).select("doc_id", "region_no", "r.*")


def split_regions(regions: DataFrame, most: int) -> DataFrame:
    """``regions`` (``doc_id, region_no, text``) dealt to parts of about ``most`` characters: ``part_id, doc_id, region_no, start, text``.

    A region longer than that is cut; a part's characters begin at a multiple of ``most`` in the document, so parts
    are found without going through the others.
    """
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / most).cast("int")), lambda k: F.struct((k * most).alias("start"), F.substr("text", k * most + 1, F.lit(most)).alias("piece")))
    cut = regions.select("doc_id", "region_no", F.inline(pieces))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("region_no", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("part", F.floor(before / most)).select(F.concat_ws(".", "doc_id", F.lpad(F.col("part").cast("string"), 3, "0")).alias("part_id"), "doc_id", "region_no", "start", F.col("piece").alias("text"))


def merged_regions(parts: DataFrame) -> DataFrame:
    """``doc_id, text`` from the parts of ``split_regions``, in order."""
    rows = F.array_sort(F.collect_list(F.struct("region_no", "start", "text")))
    return parts.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.array_join("r.text", "").alias("text"))


def substituted(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements by regular expression."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def symbols(c: Column, names: dict[str, str], back: bool = False) -> Column:
    """Tokens replaced by name, or names by tokens; others stay."""
    pairs = [(v, k) if back else (k, v) for k, v in names.items()]
    table_ = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.coalesce(table_[c], c)


def windowed(tokens_: DataFrame, column: str = "token") -> DataFrame:
    """Tokens with the two before and the two after, null over the ends: features of a window."""
    w = Window.partitionBy("doc_id", "sent_no").orderBy("tok_no")
    return tokens_.select("*", *[F.lag(column, k).over(w).alias(f"before_{k}") for k in (1, 2)], *[F.lead(column, k).over(w).alias(f"after_{k}") for k in (1, 2)])


def _q_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("#1 "), "p_name", F.lit(" O'Neil–"), "p_type", F.lit("!!!!  ---- À"))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("x"), "p_name")
    first = F.element_at(F.split("p_name", " "), 1)
    high, low = text.split_hash(F.col("p_partkey") * 5_000_000_000)
    return p.select(
        "p_partkey", text.normalize_text(F.col("x")).alias("text"), text.normalize_name(F.col("x")).alias("name"), text.sql_literal(F.col("x")).alias("literal"), text.strip_accents(F.col("x")).alias("accents"),
        text.normalize_punctuation(F.col("x")).alias("punctuation"), text.squeeze_punctuation(F.col("x")).alias("squeezed"), text.squeeze_dashes(F.col("x")).alias("dashes"), text.whiteout_dashes(F.col("x")).alias("white"),
        text.is_sub_name(F.col("p_name"), first).alias("sub"), F.round(text.similarity(F.col("p_name"), F.reverse("p_name")), 6).alias("similar"), text.acronym(F.col("p_name")).alias("acronym"),
        F.element_at(text.cluster_prefixes(F.bin("p_partkey"), (4, 6)), 1).alias("cluster"), high.alias("high"), low.alias("low"), text.join_hash(high, low).alias("joined"),
    )


def _q_timex(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    kind = F.col("o_orderkey") % 5
    value = F.when(kind == 0, F.date_format(day, "yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM")).when(kind == 2, timex.iso_week(day)).when(kind == 3, F.date_format(day, "yyyy-MM-dd")).otherwise("XXXX")
    o = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("timex"), day.alias("day"))
    start, end = timex.period(F.col("timex"))
    low, high = F.lit("1997-01-15").cast("date"), F.lit("1998-12-31").cast("date")
    return o.select("o_orderkey", "timex", timex.granularity(F.col("timex")).alias("granularity"), start.alias("start"), end.alias("end"), timex.date_status(F.col("timex"), low, high).alias("status"), timex.to_year(F.col("timex")).alias("year"), timex.to_day(F.col("timex")).alias("ymd"), F.last_day("day").alias("month_end"), timex.plus_months(F.col("day"), 13).alias("later"))


def _q_query_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["yyyyMMdd", "MMMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "M/d/yyyy", "M-d-yy", "M/yyyy", "yyyy", "yyyy-MM-dd"]
    kind = F.col("o_orderkey") % len(forms)
    written = reduce(lambda c, k: c.when(kind == k, F.date_format("o_orderdate", forms[k])), range(1, len(forms)), F.when(kind == 0, F.date_format("o_orderdate", forms[0])))
    o = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return o.select("o_orderkey", "written", timex.query_date(F.col("written"), "start").alias("first"), timex.query_date(F.col("written"), "end").alias("last"))


def _q_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd-HH:mm:ss", "yyyyMMdd'T'HHmmss"]
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    kind = F.col("event_id") % len(forms)
    written = reduce(lambda c, k: c.when(kind == k, F.date_format("ts", forms[k])), range(1, len(forms)), F.when(kind == 0, F.date_format("ts", forms[0])))
    e = e.withColumn("written", F.concat(written, F.when(F.col("event_id") % 4 == 0, "+0200").when(F.col("event_id") % 4 == 1, "Z").otherwise("")))
    day, time, zone = timex.parse_time(F.col("written"))
    return e.select("event_id", day.alias("day"), time.alias("time"), zone.alias("zone"))


def _q_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a, b = F.when(F.col("l_linenumber") == 7, F.lit(-20000.0)).otherwise(-F.col("l_quantity")), -F.col("l_discount") * 100 - 1
    return li.select("l_orderkey", "l_linenumber", F.round(mathx.log_add(a, b), 9).alias("log_sum"), F.round(mathx.witten_bell(F.col("l_linenumber"), F.col("l_quantity"), F.lit(7), F.col("l_tax")), 9).alias("smoothed"), F.round(mathx.n_log_n(F.col("l_quantity")), 9).alias("nlogn"), F.round(mathx.bernoulli(F.col("l_linenumber") % 2 == 0, F.col("l_discount")), 9).alias("bernoulli"))


def _q_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rules = [(r"(\w+) (\w+)", "$2 <$1>"), (r"<a", "<A"), (r"\s+", "_")]
    names = {"ring": "R-1", "bolt": "B-2"}
    last = F.element_at(F.split("p_name", " "), -1)
    return p.select("p_partkey", substituted(F.col("p_name"), rules).alias("rewritten"), symbols(last, names).alias("symbol"), symbols(symbols(last, names), names, True).alias("back"))


def _q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("sent_no"), F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("tok_no", "token"))
    return windowed(p)


def _q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "(?<=\n)")).alias("region_no", "text"))
    parts = split_regions(docs, 500)
    return parts.groupBy("part_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.min("region_no").alias("first"))


def _q_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "(?<=\n)")).alias("region_no", "text"))
    return merged_regions(split_regions(docs, 300)).select("doc_id", F.sha2("text", 256).alias("digest"))


def _q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(sentences(table(spark, sf_dir, "documents")))


def _q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_sentences(table(spark, sf_dir, "documents"))


def _q_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words go through the program, each once."""
    words = table(spark, sf_dir, "documents").select(F.explode(text.tokens(text.normalize_text(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(english.udf(english.stem, "string")(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"))


def _q_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written out and read back."""
    small = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    names = F.array(*map(F.lit, small))
    tens = F.array(*map(F.lit, ["", "ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]))
    k = F.col("p_partkey")
    words = F.concat_ws(" ", F.get(names, (1 + k % 9).cast("int")), F.lit("million"), F.get(names, (1 + k % 8).cast("int")), F.lit("hundred"), F.get(tens, (1 + k % 7).cast("int")), F.lit("thousand"), F.format_number(k % 1000, 0))
    return table(spark, sf_dir, "part").select("p_partkey", english.udf(english.number_of, "long")(words).alias("number"))


def _q_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_zones(table(spark, sf_dir, "documents"))


_SPLIT = """r AS (SELECT doc_id, i - 1 AS region_no, CASE WHEN i < len(l) THEN l[i] || chr(10) ELSE l[i] END AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
QUERIES = {
    "text_functions": _q_text, "timex": _q_timex, "query_dates": _q_query_dates, "date_times": _q_times, "math_functions": _q_math, "rewrite_rules": _q_rules, "token_windows": _q_windows, "region_parts": _q_split, "region_merge": _q_merged,
    "english_tokens": _q_tokens, "rule_sentences": _q_sentences, "stems": _q_stems, "number_words": _q_numbers, "prose_zones": _q_prose,
}
ORACLE_SQL = {
    "text_functions": r"""WITH p AS (SELECT p_partkey, p_name, '#1 ' || p_name || ' O''Neil–' || p_type || '!!!!  ---- À' AS x FROM part), n AS (SELECT *, trim(lower(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'))) AS t FROM p)
        SELECT p_partkey, t AS text, regexp_replace(t, '^([^\p{L} ]+ )+', '') AS name, replace(x, '''', '''''') AS literal, replace(x, 'À', 'A') AS accents, replace(x, '–', '-') AS punctuation,
            replace(replace(x, '!!!!', '!'), '----', '--') AS squeezed, regexp_replace(x, '[-–]', '', 'g') AS dashes, regexp_replace(x, '[-–]', ' ', 'g') AS white, p_name <> split_part(p_name, ' ', 1) AND split_part(p_name, ' ', 1) NOT IN ('al', 'de', 'bin') AS sub,
            round(1 - levenshtein(p_name, reverse(p_name)) / length(p_name), 6) AS similar, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) AS acronym,
            CASE WHEN length(bin(p_partkey)) >= 4 THEN bin(p_partkey)[1:4] END AS cluster, p_partkey * 5000000000 >> 32 AS high, p_partkey * 5000000000 & 4294967295 AS low, p_partkey * 5000000000 AS joined FROM n""",
    "timex": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 5 AS k FROM orders),
        t AS (SELECT *, CASE k WHEN 0 THEN strftime(d, '%Y') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN strftime(d, '%G-W%V') WHEN 3 THEN strftime(d, '%Y-%m-%d') ELSE 'XXXX' END AS timex,
            CASE k WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN date_trunc('week', d) WHEN 3 THEN d END::DATE AS s,
            CASE k WHEN 0 THEN date_trunc('year', d) + INTERVAL 1 YEAR WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 2 THEN date_trunc('week', d) + INTERVAL 7 DAY WHEN 3 THEN d + INTERVAL 1 DAY END::DATE AS e FROM o)
        SELECT o_orderkey, timex, CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'week' WHEN 3 THEN 'day' END AS granularity, s AS start, e AS "end",
            CASE WHEN k = 4 THEN 'NOT_SPECIFIC' WHEN e <= DATE '1997-01-15' OR s > DATE '1998-12-31' THEN 'OUT_OF_RANGE' WHEN k = 0 AND NOT (s >= DATE '1997-01-15' AND e <= DATE '1999-01-01') THEN 'TOO_BROAD' ELSE 'IN_RANGE' END AS status,
            CASE WHEN k < 4 THEN timex[1:4] END AS year, CASE WHEN k = 3 THEN timex END AS ymd, last_day(d) AS month_end, (d + INTERVAL 13 MONTH)::DATE AS later FROM t""",
    "query_dates": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 9 AS k FROM orders)
        SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y%m%d') WHEN 1 THEN strftime(d, '%B %Y') WHEN 2 THEN strftime(d, '%-d %B %Y') WHEN 3 THEN strftime(d, '%B %-d, %Y') WHEN 4 THEN strftime(d, '%-m/%-d/%Y') WHEN 5 THEN strftime(d, '%-m-%-d-%y')
                WHEN 6 THEN strftime(d, '%-m/%Y') WHEN 7 THEN strftime(d, '%Y') ELSE strftime(d, '%Y-%m-%d') END AS written,
            CASE WHEN k IN (1, 6) THEN date_trunc('month', d) WHEN k = 7 THEN date_trunc('year', d) ELSE d END::DATE AS first, CASE WHEN k IN (1, 6) THEN last_day(d) WHEN k = 7 THEN date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY ELSE d END::DATE AS last FROM o""",
    "date_times": """SELECT event_id, ts::DATE AS day, CASE WHEN event_id % 6 >= 2 THEN strftime(ts, '%H:%M:%S') END AS time, CASE event_id % 4 WHEN 0 THEN '+0200' WHEN 1 THEN 'Z' END AS zone FROM events""",
    "math_functions": """WITH l AS (SELECT *, CASE WHEN l_linenumber = 7 THEN -20000.0 ELSE -l_quantity END AS a, -l_discount * 100 - 1 AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(CASE WHEN least(a, b) <= -10000 OR abs(a - b) > 20 THEN greatest(a, b) ELSE greatest(a, b) + ln(1 + exp(-abs(a - b))) END, 9) AS log_sum, round(l_linenumber / (l_quantity + 7) + 7 / (l_quantity + 7) * l_tax, 9) AS smoothed,
            round(l_quantity * log2(l_quantity), 9) AS nlogn, round(CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE 1 - l_discount END, 9) AS bernoulli FROM l""",
    "rewrite_rules": r"""SELECT p_partkey, replace(replace(regexp_replace(p_name, '(\w+) (\w+)', '\2 <\1>', 'g'), '<a', '<A'), ' ', '_') AS rewritten, CASE string_split(p_name, ' ')[-1] WHEN 'ring' THEN 'R-1' WHEN 'bolt' THEN 'B-2' ELSE string_split(p_name, ' ')[-1] END AS symbol, string_split(p_name, ' ')[-1] AS back FROM part""",
    "token_windows": """WITH t AS (SELECT p_brand AS doc_id, p_partkey AS sent_no, (i - 1)::INT AS tok_no, l[i] AS token FROM (SELECT p_brand, p_partkey, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(p_name || ' ' || p_type, ' ') AS l FROM part)))
        SELECT *, lag(token, 1) OVER w AS before_1, lag(token, 2) OVER w AS before_2, lead(token, 1) OVER w AS after_1, lead(token, 2) OVER w AS after_2 FROM t WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)""",
    "region_parts": f"""WITH {_SPLIT}, p AS (SELECT doc_id, region_no, k * 500 AS s, substr(t, (k * 500 + 1)::INT, 500) AS x FROM (SELECT *, unnest(range(0, (greatest(length(t) - 1, 0) // 500) + 1)) AS k FROM r)),
        b AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY region_no, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM p)
        SELECT doc_id || '.' || lpad((c // 500)::BIGINT::VARCHAR, 3, '0') AS part_id, count(*) AS n, sum(length(x))::BIGINT AS n_chars, min(region_no)::INT AS first FROM b GROUP BY 1""",
    "region_merge": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "number_words": "SELECT p_partkey, (1 + p_partkey % 9) * 1000000 + ((1 + p_partkey % 8) * 100 + (1 + p_partkey % 7) * 10) * 1000 + p_partkey % 1000 AS number FROM part",
}
