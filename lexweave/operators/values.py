"""Value mentions in white-space tokens: e-mail addresses, URLs and phone numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import tokens
from lexweave.session import table

# What a token must hold to be an address or a URL, and how phone numbers look.
EMAIL_PATTERNS = (r"(?i)@.*\.(com|gov|edu|org|mil|net)", r"(?i)@.*\.[A-Za-z][A-Za-z](\W|$)")
URL_PATTERNS = (r"(?i)https?\:", r"(?i)www\.", r"(?i)\.(com|gov|edu|org|mil|net)(\W|$)")
#: What any address or URL holds by these patterns.
MAY_HOLD = r"@|[hH][tT][tT][pP][sS]?:|[wW][wW][wW]\.|\.(?i:com|gov|edu|org|mil|net)"
SPORTS = r"scoreboard|scores|baseball|football|hockey|basketball|tennis|bowling|cricket|rugby|soccer|swimming|sports|wickets|team gp|standings|league|wild card|runner-up|seeded"
NO_PHONE = (
    r".*-.* .*",
    r"[012][0-9][0-9][0-9]\s*-?-?\s*[012][0-9][0-9][0-9]",
    r"[12][0-9][0-9][0-9]\s*--?\s*[01][0-9]\s*--?\s*[0123][0-9]",
    r"[01][0-9]\s*--?\s*[0123][0-9]\s*--?\s*[12][0-9][0-9][0-9]",
    r"[0-9]{5}\s*-\s*[0-9]{4}",
    r".*\([012][0-9]{3}\).*",
    r"\d{10}\d+",
    r".*[ -]+\d[ -]+\d[ -]+\d[ -]+.*",
    r".*\d+[ -]+\d+[ -]+\d+[ -]+\d+[ -]+\d+[ -]+\d+[ -]+.*",
    r"\(?(19|20)\d{6}\)?",
)
NO_PHONE_BEFORE = (
    r"isbn|serial|license|licence|patent|lottery|ebay| sn |number of|n. of|ref:|id:|total|=|uin:|pin:",
    r"(serial|lucky|ticket|inmate|case|item|smr|id|patent|license|licence)\s*-?(number|no.|#)",
)
PHONE = (
    r"\+? ?1? ?-?-? ?\(?[0-9]{3}\)?[ \-][0-9]{3}[ \-][0-9]{4}",
    r"[0-9]{3}[ \-][0-9]{4}",
    r"\+? ?1? ?-?-? ?\(?[0-9]{3}\)?[ \-][0-9]{3}[ \-][0-9]{4}/\d{3,4}",
    r"[0-9]{3}[ \-][0-9]{4}/\d{3,4}",
    r"001 \d{3} \d{7}",
    r"1?\.?[0-9]{3}\.[0-9]{3}\.[0-9]{4}",
    r"\+\d.*",
)
PHONE_BEFORE = r".*(fax|tel\.?|telephone|telefon|info:|phone|voice|mobile|cell|pager|contact|call|dial|gsm|sms|home|work| w\.? | h\.? )\.?\s*(number)?\s*:?\s*"
LIKELY_WHOLE = (r"\d{2,5}[ \-]\d{3,4}[ \-]\d{3,4}", r"\d{2} \d{2} \d{2} \d{2} \d{2}", r"\d{4} \d{1} \d{3} \d{3}")
LIKELY_INSIDE = (r"\d{4} \d{1} \d{6}", r"\d{7}\d? ?(\-\d\d+)?")
MIN_DIGITS, MAX_LENGTH, CONTEXT = 7, 25, 7

TYPES = ("email", "url")
PART = re.compile(r"[+0-9][-0-9./]*\Z")
LATER_PART = re.compile(r"[-0-9./]+\Z")


def _matcher(patterns: tuple[str, ...], flags: int = 0) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.ASCII | flags)


NO_PHONE_RE, PHONE_RE, LIKELY_WHOLE_RE, LIKELY_INSIDE_RE = map(_matcher, (NO_PHONE, PHONE, LIKELY_WHOLE, LIKELY_INSIDE))
NO_PHONE_BEFORE_RE, PHONE_BEFORE_RE, SPORTS_RE = (_matcher(x, re.IGNORECASE) for x in (NO_PHONE_BEFORE, (PHONE_BEFORE,), (SPORTS,)))


def value_type(token: Column) -> Column:
    """``email``, ``url`` or null; an address is no URL."""

    def holds(patterns: tuple[str, ...]) -> Column:
        out = token.rlike(patterns[0])
        for p in patterns[1:]:
            out = out | token.rlike(p)
        return out

    return F.when(holds(EMAIL_PATTERNS), "email").when(holds(URL_PATTERNS), "url")


def value_mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, tok_no, token, value_type``: one row for each token that is an address or a URL."""
    tok = docs.select("doc_id", "lang", F.posexplode_outer(tokens(F.col("text"))).alias("tok_no", "token"))
    return tok.withColumn("value_type", value_type(F.col("token"))).where(F.col("value_type").isNotNull())


def bracketed(text: str) -> list[str]:
    """White-space tokens with brackets, and a full stop at the end, as tokens of their own."""
    return [t for w in text.split() for t in re.findall(r"[()]|[^()]+?(?=\.?(?:[()]|\Z))|\.(?=[()]|\Z)", w)]


def phone_numbers(words: list[str]) -> list[tuple[int, int, str]]:
    """(first token, last token, number) of the phone numbers among ``words``, brackets being words of their own.

    A candidate is the longest run of tokens of digits and ``- . /`` (a plus may lead) and brackets. It is
    cut at loose brackets and full stops; what it looks like and the seven tokens before it decide.
    """
    out, at, whole = [], 0, None
    while at < len(words):
        start, end, closed = at, at, 0
        while end < len(words):
            w = words[end]
            if w == ")":
                if end == start:
                    break
                closed += 1
            elif w != "(" and not (PART if end == start else LATER_PART).match(w):
                break
            end += 1
        at = max(end, at + 1)
        last = end - 1
        if last < start:
            continue
        for mark in (")", "(", "."):
            if last > start and words[last] == mark:
                last -= 1
                closed -= mark == ")"
        if words[start] == "(" and closed <= 0 and start < last:
            start += 1
        number = " ".join(words[start : last + 1]).replace("( ", "(").replace(" )", ")").replace(" - ", "-").replace(" -", "-").replace("- ", "-")
        if sum(c.isdigit() for c in number) < MIN_DIGITS or len(number) > MAX_LENGTH:
            continue
        before = " ".join(words[max(0, start - CONTEXT) : start]) + " "
        if NO_PHONE_RE.fullmatch(number) or NO_PHONE_BEFORE_RE.search(before):
            continue
        if not (PHONE_RE.fullmatch(number) or PHONE_BEFORE_RE.search(before)):
            if "." in number:
                continue
            whole = " ".join(words) if whole is None else whole
            bare = number.replace("(", "").replace(")", "")
            if SPORTS_RE.search(whole) or not (LIKELY_WHOLE_RE.fullmatch(bare) or LIKELY_INSIDE_RE.search(bare)):
                continue
        out.append((start, last, number))
    return out


def _phone_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(doc, sent, *p) for doc, sent, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for p in phone_numbers(bracketed(text))]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "sent_no", "start", "end", "number"])


def phones(sentences: DataFrame) -> DataFrame:
    """``doc_id, sent_no, start, end, number`` of the phone numbers of ``doc_id, sent_no, sentence``; only sentences of enough digits leave the JVM."""
    kind = dict(sentences.dtypes)["doc_id"]
    near = sentences.where(F.regexp_count("sentence", F.lit("[0-9]")) >= MIN_DIGITS).select("doc_id", F.col("sent_no").cast("int").alias("sent_no"), "sentence")
    return near.mapInArrow(_phone_batches, f"doc_id {kind}, sent_no int, start int, end int, number string")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by language and type, zeros included."""
    docs = table(spark, sf_dir, "documents")
    kinds = spark.createDataFrame([(t,) for t in TYPES], "value_type string")
    grid = docs.select("lang").distinct().join(F.broadcast(kinds))
    counts = value_mentions(docs).groupBy("lang", "value_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return grid.join(counts, ["lang", "value_type"], "left").select("lang", "value_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _q_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.operators.sentences import sentences

    return phones(sentences(table(spark, sf_dir, "documents")))


QUERIES = {"value_counts": value_counts, "phone_numbers": _q_phones}
ORACLE_SQL = {
    "value_counts": r"""
        WITH tok AS (SELECT doc_id, lang, unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS token FROM documents),
        v AS (SELECT doc_id, lang, CASE WHEN regexp_matches(lower(token), '@.*\.(com|gov|edu|org|mil|net)') OR regexp_matches(token, '@.*\.[A-Za-z][A-Za-z]([^A-Za-z0-9_]|$)') THEN 'email'
            WHEN regexp_matches(lower(token), 'https?:') OR contains(lower(token), 'www.') OR regexp_matches(lower(token), '\.(com|gov|edu|org|mil|net)([^a-z0-9_]|$)') THEN 'url' END AS value_type FROM tok WHERE token <> ''),
        g AS (SELECT DISTINCT lang, value_type FROM documents, (VALUES ('email'), ('url')) t(value_type))
        SELECT g.lang, g.value_type, count(v.doc_id) AS n, count(DISTINCT v.doc_id) AS n_docs
        FROM g LEFT JOIN v ON g.lang = v.lang AND g.value_type = v.value_type GROUP BY 1, 2""",
}
