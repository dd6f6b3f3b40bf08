"""Scalar text functions as column expressions; all run in whole-stage code on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"\p{L}\p{N}"
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
DASHES = r"[-\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}]"


def normalize_text(c: Column) -> Column:
    """Letters and digits in lower case; every run of other characters is one space; trimmed. Null stays null."""
    return F.trim(F.lower(F.regexp_replace(c, f"[^{ALNUM}]+", " ")))


def normalize_name(c: Column) -> Column:
    """Normalized text without leading words that hold no letter."""
    return F.regexp_replace(normalize_text(c), r"^([^\p{L} ]+ )+", "")


def sql_literal(c: Column) -> Column:
    """Apostrophes doubled, as a SQL string literal needs."""
    return F.replace(c, F.lit("'"), F.lit("''"))


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def remove_harmful(c: Column) -> Column:
    """Without control characters (but tab and line ends), joiners and byte order marks."""
    return F.regexp_replace(c, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{200B}-\x{200F}\x{FEFF}]", "")


def normalize_punctuation(c: Column) -> Column:
    """Typographic spaces, quotes and dashes to ASCII; the ellipsis to spaced dots; the fraction slash to a slash."""
    out = F.translate(c, " ‘’“”⁄", " ''\"\"/")
    return F.replace(F.regexp_replace(out, DASHES, "-"), F.lit("…"), F.lit(" ... "))


def squeeze_punctuation(c: Column) -> Column:
    """Runs of three or more of one mark are cut to one; hyphen runs to two hyphens."""
    out = F.regexp_replace(c, r"-{3,}", "--")
    for mark in ("!", r"\?", r"\*", "#", r"\$", "%", "&"):
        out = F.regexp_replace(out, mark + "{3,}", mark)
    return out


def tokens(c: Column) -> Column:
    """White-space tokens; an array of none for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")


def squeeze_dashes(c: Column) -> Column:
    return F.regexp_replace(c, DASHES, "")


def whiteout_dashes(c: Column) -> Column:
    return F.regexp_replace(c, DASHES, " ")


def is_sub_name(whole: Column, part: Column, trivial: tuple[str, ...] = ("al", "de", "bin")) -> Column:
    """``part`` is a proper leading or trailing run of the tokens of ``whole``, and not a particle."""
    inside = F.startswith(whole, F.concat(part, F.lit(" "))) | F.endswith(whole, F.concat(F.lit(" "), part))
    return inside & ~part.isin(*trivial) & (part != "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


#: Classes of words with a digit by what else they hold; the first that fits counts. Fixed values.
WITH_DIGIT = (("containsDigitAndAlpha", r"\p{L}"), ("containsDigitAndDash", "-"), ("containsDigitAndSlash", "/"), ("containsDigitAndComma", ","), ("containsDigitAndPeriod", r"\."))


def word_shape(w: Column, starts_sentence: Column | None = None) -> Column:
    """Class of a word by its digits, then by its case; the first rule that fits counts.

    A capital at the start of a sentence is a class of its own where ``starts_sentence`` says so. Patterns end in
    ``\\z``: ``$`` would also match before a last U+0085, U+2028 or U+2029.
    """
    out = F.when(w.rlike("^[0-9]{2}\\z"), "twoDigitNum").when(w.rlike("^[0-9]{4}\\z"), "fourDigitNum")
    for name, pattern in WITH_DIGIT:
        out = out.when(w.rlike("[0-9]") & w.rlike(pattern), name)
    out = out.when(w.rlike("[0-9]"), "otherNum").when(w.rlike(r"^\p{Lu}+\z"), "allCaps").when(w.rlike(r"^\p{Lu}\.\z"), "capPeriod")
    if starts_sentence is not None:
        out = out.when(w.rlike(r"^\p{Lu}") & starts_sentence, "firstWord")
    return out.when(w.rlike(r"^\p{Lu}"), "initCap").when(w.rlike(r"^\p{Ll}+\z"), "lowerCase").otherwise("other")


def acronym(c: Column) -> Column:
    """First letters of the words, in upper case."""
    return F.upper(F.array_join(F.transform(tokens(c), lambda w: F.substring(w, 1, 1)), ""))


def cluster_prefixes(bits: Column, sizes: tuple[int, ...] = (8, 12, 16, 20)) -> Column:
    """Prefixes of a bit string; null where it is shorter."""
    return F.array(*[F.when(F.length(bits) >= n, F.substring(bits, 1, n)) for n in sizes])


def split_hash(h: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a long."""
    return F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))


def join_hash(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low)
