"""A pattern language in s-expressions, compiled to DataFrame plans over sentences.

A pattern gives matches ``doc_id, sent_no`` and a string column for each label that it returns.

    (text "words" [RAW] (return x))      the words stand in the sentence, apart by spaces; RAW: anywhere
    (regex "pattern" (return x))         the first match of a regular expression
    (word (in set) (return x))           tokens of a word set
    (value (type email url) (return x))  value mentions of these types
    (mention tests ... (return x))       mentions of the table ``mention``; see MENTION_TESTS
    (prop tests ... args ...)            propositions; also vprop, nprop, mprop, cprop, sprop, anyprop by kind
    (event tests ... args ...)           events; (relation ...) likewise
        (args (argument (role sub obj) p) ...)       each must be there and match p, a mention pattern
        (opt_args (argument ...) ...)                captured if it is there
        (block_args (argument ...) ...)              must not be there
    (quotation p (text "words"))         quotations whose speaker matches p and that hold the words
    (topic (threshold t) (window b f))   sentences whose score in ``topic``, or a neighbour's, reaches t
    (any-of p q ...), (union p q ...)    matches of any member; labels that a member lacks are null
    (all-of p q ...)                     elements that all members match; for text, the sentence: a join
    (intersection p q ...)               combinations of the members' matches in a sentence: a join
    (none-of p ...)                      elements that no member matches; for text, sentences: an anti join
    (negation p ...)                     sentences that no member matches: an anti join
    (doc p)                              sentences of documents that hold a match: a semi join
    (language lang ...) p                the pattern over documents of these languages only
    name                                 the pattern that the set defines by this name

A set is a list of ``(wordset name word ...)``, ``(define name pattern)`` and one ``(toplevel pattern)``.
Nothing is run here: Catalyst sees one plan and pushes, prunes and joins as it likes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.text import tokens
from lexweave.operators.sentences import sentences
from lexweave.operators.values import MAY_HOLD, phones, value_type
from lexweave.plans import derived
from lexweave.session import table

KEY = ("doc_id", "sent_no")
#: Words of a set that are looked for one by one at most.
FEW = 16
ATOM = re.compile(r'\s*(?:;[^\n]*\n\s*)*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|([^\s()"]+))')


class Quoted(str):
    """A string in quotes, as against a name."""


def parse(text: str) -> list:
    """The expressions of a text. Unbalanced brackets raise ``ValueError``."""
    stack, at = [[]], 0
    text = text.rstrip()
    while at < len(text):
        m = ATOM.match(text, at)
        if not m:
            raise ValueError(f"cannot read a pattern at {text[at : at + 30]!r}")
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise ValueError("a bracket closes that was not opened")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(Quoted(re.sub(r"\\(.)", r"\1", m[3])) if m[3] is not None else m[4])
    if len(stack) > 1:
        raise ValueError("a bracket is not closed")
    return stack[0]


@dataclass
class PatternSet:
    """Named word sets and patterns; ``sentences``: ``doc_id, sent_no, sentence``."""

    sentences: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    wordsets: dict[str, list[str]] = field(default_factory=dict)
    named: dict[str, object] = field(default_factory=dict)
    toplevel: object = None

    def add(self, text: str) -> PatternSet:
        for e in parse(text):
            if e[0] == "wordset":
                self.wordsets[e[1]] = [w for x in e[2:] for w in self.wordsets.get(x[1:], [x])]  # @other includes a set
            elif e[0] == "define":
                self.named[e[1]] = e[2]
            elif e[0] == "toplevel":
                self.toplevel = e[1]
            else:
                raise ValueError(f"unknown part of a pattern set: {e[0]}")
        return self

    def matches(self) -> DataFrame:
        """Matches of the top-level pattern, without repeats."""
        out = self.compiled(self.toplevel)
        return out.select([c for c in out.columns if not c.startswith("_")]).distinct()

    def compiled(self, e: object, inside: tuple[str, ...] = ()) -> DataFrame:
        if isinstance(e, str) and not isinstance(e, Quoted):
            if e not in self.named or e in inside:
                raise ValueError(f"unknown or circular name: {e}")
            return self.compiled(self.named[e], (*inside, e))
        kind = COMPILERS.get(e[0])
        if kind is None:
            raise ValueError(f"unknown pattern: {e[0]}")
        return kind(self, e[1:], inside)


def _option(parts: list, name: str) -> list:
    return next((p[1:] for p in parts if isinstance(p, list) and p[0] == name), [])


def _labelled(df: DataFrame, parts: list, found: str) -> DataFrame:
    return df.select(*KEY, *[F.col(found).alias(x) for x in _option(parts, "return")[:1]])


def _text(s: PatternSet, parts: list, _: tuple) -> DataFrame:
    hit = F.contains("sentence", F.lit(parts[0])) if "RAW" in parts else F.contains(F.concat(F.lit(" "), F.col("sentence"), F.lit(" ")), F.lit(f" {parts[0]} "))
    return _labelled(s.sentences.where(hit).withColumn("_found", F.lit(str(parts[0]))), parts, "_found")


def _regex(s: PatternSet, parts: list, _: tuple) -> DataFrame:
    return _labelled(s.sentences.where(F.col("sentence").rlike(parts[0])).withColumn("_found", F.regexp_extract("sentence", str(parts[0]), 0)), parts, "_found")


def _word(s: PatternSet, parts: list, _: tuple) -> DataFrame:
    words, wanted = F.explode_outer(tokens(F.col("sentence"))).alias("_found"), s.wordsets[_option(parts, "in")[0]]
    rows = s.sentences
    if 0 < len(wanted) <= FEW:  # only sentences that hold one anywhere are cut
        rows = rows.where(reduce(lambda a, b: a | b, [F.contains("sentence", F.lit(w)) for w in wanted]))
    if not _option(parts, "return"):  # whether one is there, without a row for each
        return rows.where(F.arrays_overlap(tokens(F.col("sentence")), F.array(*map(F.lit, wanted)).cast("array<string>"))).select(*KEY)
    return _labelled(rows.select(*KEY, words).where(F.col("_found").isin(wanted)), parts, "_found")


def _value(s: PatternSet, parts: list, _: tuple) -> DataFrame:
    types = _option(parts, "type")
    rows = s.sentences.where(F.col("sentence").rlike(MAY_HOLD))  # only these are cut
    found = rows.select(*KEY, F.explode_outer(tokens(F.col("sentence"))).alias("_found")).where(F.col("_found").rlike(MAY_HOLD)).where(value_type(F.col("_found")).isin(types))
    if "phone" in types:
        found = found.unionByName(phones(s.sentences).select(*KEY, F.col("number").alias("_found")))
    return _labelled(found, parts, "_found")


def words_of(s: PatternSet, parts: list) -> list[str]:
    """Words of a test: ``(in set)`` or the words themselves."""
    return [w for x in parts for w in (s.wordsets[x[1]] if isinstance(x, list) else [x])]


def _one_of(column: str) -> Callable[[PatternSet, list], Column]:
    return lambda s, parts: F.coalesce(F.col(column).isin(words_of(s, parts)), F.lit(False))


def _like(column: str) -> Callable[[PatternSet, list], Column]:
    return lambda s, parts: F.coalesce(F.col(column).rlike(str(parts[0])), F.lit(False))


def compared(c: Column, op: str, n: Column) -> Column:
    return {"==": c == n, "!=": c != n, "<": c < n, "<=": c <= n, ">": c > n, ">=": c >= n}[op]


#: Tests of elements by name; ``block_`` before a name turns it round. New ones can be added.
MENTION_TESTS: dict[str, Callable[[PatternSet, list], Column]] = {
    "acetype": _one_of("type"), "acesubtype": _one_of("subtype"), "mentiontype": _one_of("mention_type"), "headword": _one_of("headword"), "entitylabel": _one_of("label"),
    "regex": _like("text"), "head-regex": _like("headword"), "min-entitylevel": lambda s, parts: F.col("level") >= int(parts[0]),
}
PROP_TESTS = {"predicate": _one_of("predicate"), "require_status": _one_of("status"), "negation": _one_of("negation"), "modal": _one_of("modal"), "particle": _one_of("particle")}
EVENT_TESTS = {"fulltype": _one_of("type"), "basetype": lambda s, parts: F.element_at(F.split("type", r"\."), 1).isin(words_of(s, parts)), "anchor": _one_of("anchor"), "modality": _one_of("modality"), "tense": _one_of("tense")}
KINDS = {"vprop": "verb", "nprop": "noun", "mprop": "modifier", "cprop": "copula", "sprop": "set"}
FREQUENCY = {"doc_etype_freq": ["doc_id"], "sent_etype_freq": ["doc_id", "sent_no"]}


def _tested(s: PatternSet, df: DataFrame, parts: list, tests: dict) -> DataFrame:
    for p in parts:
        if isinstance(p, list) and p[0].removeprefix("block_") in tests:
            holds = tests[p[0].removeprefix("block_")](s, p[1:])
            df = df.where(~holds if p[0].startswith("block_") else holds)
    return df


def _mention(s: PatternSet, parts: list, _: tuple) -> DataFrame:
    rows = s.tables["mention"]
    found = _tested(s, rows, parts, MENTION_TESTS)
    for p in parts:
        if isinstance(p, list) and p[0] in FREQUENCY:  # distinct entities of the mention's type, around it
            by = [*FREQUENCY[p[0]], "type"]
            counts = rows.where("entity_id is not null").groupBy(*by).agg(F.countDistinct("entity_id").alias("_n"))
            found = found.where("entity_id is not null").join(counts.where(compared(F.col("_n"), p[1], F.lit(int(p[2])))).drop("_n"), by, "left_semi")
    return found.select(*KEY, F.col("mention_id").alias("_mention"), *[F.col("text").alias(x) for x in _option(parts, "return")[:1]])


def _with_arguments(s: PatternSet, found: DataFrame, owner: str, parts: list, inside: tuple) -> DataFrame:
    """Required arguments by an inner join, optional ones by a left join, blocked ones by an anti join."""
    own = s.tables["argument"].where(F.col("owner") == owner)

    def filled(e: list) -> DataFrame:
        roles = _option(e, "role")
        of_role = own.where(F.col("role").isin(roles)) if roles else own
        inner = [x for x in e[1:] if not (isinstance(x, list) and x[0] in ("role", "return"))]
        out = of_role.select(F.col("owner_id").alias("_owner"), F.col("mention_id").alias("_mention"))
        return out.join(s.compiled(inner[0], inside), "_mention").drop(*KEY, "_mention") if inner else out.drop("_mention")

    for e in _option(parts, "args"):
        found = found.join(filled(e), "_owner")
    for e in _option(parts, "opt_args"):
        found = found.join(filled(e), "_owner", "left")
    for e in _option(parts, "block_args"):
        found = found.join(filled(e).select("_owner").distinct(), "_owner", "left_anti")
    return found


def _owner(kind: str, tests: dict, shown: str) -> Callable[[PatternSet, list, tuple], DataFrame]:
    def compiled(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
        found = _tested(s, s.tables[kind], parts, tests)
        found = found.select(*KEY, F.col(f"{kind}_id").alias("_owner"), *[F.col(shown).alias(x) for x in _option(parts, "return")[:1]])
        return _with_arguments(s, found, kind, parts, inside).withColumnRenamed("_owner", f"_{kind}")

    return compiled


def _kind_of_prop(kind: str) -> Callable[[PatternSet, list, tuple], DataFrame]:
    def compiled(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
        own = PatternSet(s.sentences, s.tables | {"prop": s.tables["prop"].where(F.col("kind") == kind)}, s.wordsets, s.named)
        return COMPILERS["prop"](own, parts, inside)

    return compiled


def _quotation(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
    said = s.tables["quotation"].select(*KEY, F.col("speaker_id").alias("_mention"), F.col("quote").alias("sentence"))
    held = [p for p in parts if isinstance(p, list) and p[0] == "text"]
    for p in held:
        said = said.where(F.contains("sentence", F.lit(str(p[1]))))
    speaker = [p for p in parts if p not in held and not (isinstance(p, list) and p[0] == "return")]
    met = said.join(s.compiled(speaker[0], inside).drop(*KEY), "_mention") if speaker else said
    return met.select(*KEY, *[c for c in met.columns if c not in (*KEY, "_mention", "sentence")], *[F.col("sentence").alias(x) for x in _option(parts, "return")[:1]])


def _topic(s: PatternSet, parts: list, _: tuple) -> DataFrame:
    before, after = (int(x) for x in _option(parts, "window") or (0, 0))
    around = Window.partitionBy("doc_id").orderBy("sent_no").rowsBetween(-before, after)
    scored = s.sentences.select(*KEY).join(s.tables["topic"], list(KEY), "left").withColumn("_best", F.max("score").over(around))
    return scored.where(F.col("_best") >= float(_option(parts, "threshold")[0])).select(*KEY)


def _language(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
    names, inner = [p for p in parts if isinstance(p, str)], [p for p in parts if isinstance(p, list)]
    return s.compiled(inner[0], inside).join(s.tables["document"].where(F.col("lang").isin(names)).select("doc_id"), "doc_id", "left_semi")


def _any(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.compiled(p, inside) for p in parts])


def _joined(members: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, [*KEY, *(c for c in a.columns if c in b.columns and c not in KEY)]), members)


def _all(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
    return _joined([s.compiled(p, inside) for p in parts])


def _intersection(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
    members = [s.compiled(p, inside) for p in parts]
    return _joined([m.drop(*(c for c in m.columns if c.startswith("_"))) for m in members])


def _negation(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
    return s.sentences.select(*KEY).join(_any(s, parts, inside).select(*KEY), list(KEY), "left_anti")


def _none(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
    found = _any(s, parts, inside)
    for kind in ("mention", "prop", "event", "relation"):
        if f"_{kind}" in found.columns:
            return s.tables[kind].select(*KEY, F.col(f"{kind}_id").alias(f"_{kind}")).join(found.select(f"_{kind}"), f"_{kind}", "left_anti")
    return s.sentences.select(*KEY).join(found.select(*KEY), list(KEY), "left_anti")


def _doc(s: PatternSet, parts: list, inside: tuple) -> DataFrame:
    return s.sentences.select(*KEY).join(s.compiled(parts[0], inside).select("doc_id"), "doc_id", "left_semi")


#: Kinds of patterns by name; new ones can be added.
COMPILERS: dict[str, Callable[[PatternSet, list, tuple], DataFrame]] = {
    "text": _text, "regex": _regex, "re": _regex, "word": _word, "value": _value, "any-of": _any, "union": _any, "all-of": _all, "intersection": _intersection, "none-of": _none, "negation": _negation, "doc": _doc,
    "mention": _mention, "prop": _owner("prop", PROP_TESTS, "predicate"), "anyprop": _owner("prop", PROP_TESTS, "predicate"), "event": _owner("event", EVENT_TESTS, "anchor"), "relation": _owner("relation", EVENT_TESTS, "type"),
    "quotation": _quotation, "topic": _topic, "language": _language, **{name: _kind_of_prop(kind) for name, kind in KINDS.items()},
}


EXAMPLE = """
(wordset articles the The der die)
(define contact (any-of (value (type email) (return what)) (value (type url) (return what))))
(toplevel (all-of contact (doc (word (in articles))) (none-of (text "Licensed under"))))
"""


def _q_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet(sentences(table(spark, sf_dir, "documents"))).add(EXAMPLE).matches()


def _q_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PatternSet(sentences(table(spark, sf_dir, "documents"))).add('(toplevel (all-of (regex "[a-z]+tion [a-z]+ing" (return pair)) (regex "^[A-Z][a-z]+" (return first))))').matches()
    return found.groupBy("first", "pair").agg(F.count("*").alias("n"))


ARGUMENTS = """
(wordset first w1 w2 w3 w4 w5 w6 w7 w8 w9)
(define thing (any-of (mention (acetype A N) (mentiontype NAME) (return who)) (mention (acetype R) (headword (in first)) (return who))))
(toplevel (vprop (predicate urgent high) (block_require_status negative) (return verb)
    (args (argument (role sub) thing)) (opt_args (argument (role obj) (mention (subtype O) (return whom)))) (block_args (argument (role iobj) (mention (acetype A))))))
"""
EVENTS = """
(toplevel (event (basetype Order) (fulltype Order.O Order.P) (block_anchor low) (return anchor) (args (argument (role sub obj)
    (all-of (mention (min-entitylevel 2) (regex "w[0-9]$") (return who)) (none-of (mention (acetype R))) (mention (sent_etype_freq >= 2)))))))
"""


def _annotations(spark: SparkSession, sf_dir: str) -> PatternSet:
    tables = derived.annotation_tables(spark, sf_dir)
    return PatternSet(tables["sentence"], tables)


def _q_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotations(spark, sf_dir).add(ARGUMENTS).matches()


def _q_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotations(spark, sf_dir).add(EVENTS).matches()


def _speech(spark: SparkSession, sf_dir: str) -> PatternSet:
    """Turns as sentences and quotations; the speaker is a mention."""
    turns = table(spark, sf_dir, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("mention_id")
    said = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("sent_no"), F.col("text").alias("sentence"), key, "role")
    mention = said.select(*KEY, "mention_id", F.col("role").alias("text"), F.upper("role").alias("type"))
    scores = said.select(*KEY, (F.length("sentence") / 1000).alias("score"))
    return PatternSet(said.select(*KEY, "sentence"), {"mention": mention, "quotation": said.select(*KEY, F.col("mention_id").alias("speaker_id"), F.col("sentence").alias("quote")), "topic": scores})


def _q_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speech(spark, sf_dir).add('(toplevel (quotation (mention (acetype USER ASSISTANT) (return who)) (text "the") (return said)))').matches().select(*KEY, "who", F.length("said").alias("n"))


def _q_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speech(spark, sf_dir).add("(toplevel (all-of (topic (threshold 0.2) (window 1 2)) (negation (mention (acetype SYSTEM)))))").matches()


def _q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return PatternSet(sentences(docs), {"document": docs.select("doc_id", "lang")}).add('(toplevel (language en de (regex "[a-z]+ing" (return word))))').matches().groupBy("word").agg(F.count("*").alias("n"))


_S = r"""s AS (SELECT doc_id, i - 1 AS sent_no, trim(regexp_replace(l[i], '[ \t\n\r\f]+', ' ', 'g')) AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]+["'']?)[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents))),
    n AS (SELECT doc_id, sent_no::INT AS sent_no, x FROM s WHERE x <> '')"""
QUERIES = {"pattern_matches": _q_matches, "pattern_regex": _q_regex, "prop_patterns": _q_props, "event_patterns": _q_events, "quotation_patterns": _q_quotations, "topic_patterns": _q_topic, "language_patterns": _q_language}
ORACLE_SQL = {
    "pattern_matches": rf"""WITH {_S}, t AS (SELECT doc_id, sent_no, x, unnest(string_split(x, ' ')) AS w FROM n)
        SELECT DISTINCT doc_id, sent_no, w AS what FROM t WHERE (regexp_matches(lower(w), '@.*\.(com|gov|edu|org|mil|net)') OR regexp_matches(w, '@.*\.[A-Za-z][A-Za-z]([^A-Za-z0-9_]|$)')
            OR regexp_matches(lower(w), 'https?:') OR contains(lower(w), 'www.') OR regexp_matches(lower(w), '\.(com|gov|edu|org|mil|net)([^a-z0-9_]|$)'))
            AND doc_id IN (SELECT doc_id FROM t WHERE w IN ('the', 'The', 'der', 'die')) AND NOT contains(' ' || x || ' ', ' Licensed under ')""",
    "pattern_regex": rf"""WITH {_S}, m AS (SELECT DISTINCT doc_id, sent_no, regexp_extract(x, '[a-z]+tion [a-z]+ing') AS pair, regexp_extract(x, '^[A-Z][a-z]+') AS first FROM n WHERE regexp_matches(x, '[a-z]+tion [a-z]+ing') AND regexp_matches(x, '^[A-Z][a-z]+'))
        SELECT first, pair, count(*) AS n FROM m GROUP BY 1, 2""",
    "prop_patterns": f"""WITH {derived.SQL}, thing AS (SELECT * FROM mention WHERE (type IN ('A', 'N') AND mention_type = 'NAME') OR (type = 'R' AND headword IN ('w1', 'w2', 'w3', 'w4', 'w5', 'w6', 'w7', 'w8', 'w9'))),
        pa AS (SELECT * FROM argument WHERE owner = 'prop')
        SELECT DISTINCT p.doc_id, p.sent_no, p.predicate AS verb, t.text AS who, o.text AS whom FROM prop p JOIN pa a ON a.owner_id = p.prop_id AND a.role = 'sub' JOIN thing t ON t.mention_id = a.mention_id
        LEFT JOIN (SELECT owner_id, m.text FROM pa JOIN mention m USING (mention_id) WHERE role = 'obj') o ON o.owner_id = p.prop_id
        WHERE p.kind = 'verb' AND p.predicate IN ('urgent', 'high') AND p.status <> 'negative' AND p.prop_id NOT IN (SELECT owner_id FROM pa JOIN mention m USING (mention_id) WHERE role = 'iobj' AND m.type = 'A')""",
    "event_patterns": f"""WITH {derived.SQL}, f AS (SELECT doc_id, sent_no, type FROM mention GROUP BY ALL HAVING count(DISTINCT entity_id) >= 2)
        SELECT DISTINCT e.doc_id, e.sent_no, e.anchor, m.text AS who FROM event e JOIN argument a ON a.owner = 'event' AND a.owner_id = e.event_id AND a.role IN ('sub', 'obj') JOIN mention m ON m.mention_id = a.mention_id
        JOIN f ON f.doc_id = m.doc_id AND f.sent_no = m.sent_no AND f.type = m.type
        WHERE e.type IN ('Order.O', 'Order.P') AND e.anchor <> 'low' AND m.level >= 2 AND regexp_matches(m.text, 'w[0-9]$') AND m.type <> 'R' AND m.entity_id IS NOT NULL""",
    "quotation_patterns": "SELECT DISTINCT conv_id AS doc_id, turn::INT AS sent_no, role AS who, length(text)::INT AS n FROM conversations WHERE role IN ('user', 'assistant') AND contains(text, 'the')",
    "topic_patterns": """SELECT DISTINCT a.conv_id AS doc_id, a.turn::INT AS sent_no FROM conversations a JOIN (SELECT conv_id, turn, max(length(text) / 1000) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS best FROM conversations) b USING (conv_id, turn)
        WHERE best >= 0.2 AND role <> 'system'""",
    "language_patterns": rf"""WITH {_S} SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, sent_no, regexp_extract(x, '[a-z]+ing') AS word FROM n WHERE regexp_matches(x, '[a-z]+ing') AND doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de'))) GROUP BY 1""",
}
