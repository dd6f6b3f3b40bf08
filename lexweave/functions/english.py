"""Functions on English words and sentences that need a program: tokens, sentences, stems, number words, prose.

They are plain Python functions on one value; ``udf`` makes Arrow-batched column functions of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import date, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN, MAX_TOKENS = 100, 1000


def udf(f: Callable, kind: str) -> Callable[..., Column]:
    """A column function of ``f``, batch by batch; null gives null."""

    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(batch, kind)


# --- tokens

CONTRACTION = re.compile(r"(?i)(.+?)(n't|'(?:s|m|d|re|ve|ll))\Z")
PIECES = re.compile(r"``|''|\$|[,;?!](?!\d)|:(?=\Z)|\"|`|-LRB-|-RRB-")


def english_tokens(text: str) -> list[str]:
    """Tokens of a sentence: quotes open or close, contractions and money signs come apart, brackets have names.

    The last full stop stands alone; others stay with their words. A bracket around one word goes with it, double
    brackets go alone. Without a token the result is ``-empty-``; long tokens and sentences are cut.
    """
    if "(" in text:
        text = re.sub(r"\(\(([^()]*)\)\)", r"\1", text)
        text = re.sub(r"\s*\(\s*[^\s()]+\s*\)", " ", text)
    text = text.replace("(", " -LRB- ").replace(")", " -RRB- ")
    words = text.split()
    last = len(words) - 1
    while last >= 0 and words[last] in ("-RRB-", "''", '"'):
        last -= 1
    out: list[str] = []
    for n, word in enumerate(words):
        if word.isalnum():
            out.append(word)
            continue
        out += _known_tokens(word, n >= last) if len(word) <= MAX_TOKEN else _word_tokens(word, n >= last)
    out = [t[:MAX_TOKEN] for t in out if t][:MAX_TOKENS]
    return out or ["-empty-"]


@lru_cache(1 << 16)
def _known_tokens(word: str, last: bool) -> tuple[str, ...]:
    return tuple(_word_tokens(word, last))


def _word_tokens(word: str, last: bool) -> list[str]:
    if word in ("-LRB-", "-RRB-"):
        return [word]
    out: list[str] = []
    word = re.sub(r"\A\W+-(?=\w)", "", word) if word.startswith("*") else word
    if word and set(word) <= {"'"} and len(word) == 3:
        return ["'", "''"]
    if word and set(word) <= {'"'}:
        return ["``"] * len(word)
    while word and word[0] in "\"'`":  # an opening quote, or an apostrophe before a number
        size = 2 if word[:2] in ("''", "``") else 1
        rest, mark = word[size:], word[:size]
        if mark == '"' or mark == "``":
            out.append("``")
        elif rest and (rest[0].isalpha() or rest[0] in "\"'`"):
            out.append("``" if size == 2 else "`")
        else:
            out.append(mark)
        word = rest
    end: list[str] = []
    while word:
        if word.endswith(("''", '"')):
            cut = 2 if word.endswith("''") else 1
            end.insert(0, "''")
            word = word[:-cut]
        elif word[-1] in ",;?!:" or (word[-1] == "'" and not word.endswith("n't")):
            end.insert(0, word[-1])
            word = word[:-1]
        elif word[-1] == "." and last and not re.search(r"\.\w*\.\Z", word):
            end.insert(0, ".")
            word = word[:-1]
        else:
            break
    for k, part in enumerate(re.split(r"['’](?=[`'\"])", word)):
        if k:
            out.append("'")
        while part[:1] in ("`", '"'):
            out.append("`" if part[0] == "`" else "``")
            part = part[1:]
        out += _money(part)
    return out + end


def _money(word: str) -> list[str]:
    parts = re.findall(r"[^$]*\$|[^$]+", word)
    return [t for p in parts for t in (_contraction(p) if "$" not in p else [p])]


def _contraction(word: str) -> list[str]:
    m = CONTRACTION.match(word)
    return [m[1], m[2]] if m else [word]


def regex_tokens(text: str, rules: Iterable[tuple[str, str]]) -> list[str]:
    """White-space tokens after replacing by ordered rules (pattern, replacement); a blank in a replacement cuts."""
    for pattern, new in rules:
        text = re.sub(pattern, new, text)
    return text.split() or ["-empty-"]


def untokenized(tokens: list[str]) -> str:
    """Tokens as text: quotes and brackets as they were, no blank before a mark or a part of a contraction."""
    text = " ".join({"``": '"', "''": '"', "-LRB-": "(", "-RRB-": ")", "`": "'"}.get(t, t) for t in tokens)
    text = re.sub(r" (?=[.,;:?!)])|(?<=[($]) ", "", text)
    text = re.sub(r" (?=n't\b|'(?:s|m|d|re|ve|ll)\b)", "", text)
    return re.sub(r'"\s?([^"]*?)\s?"', r'"\1"', text)


# --- sentences

ABBREVIATIONS = frozenset("mr mrs ms dr prof st gen col lt sgt capt rep sen gov jr sr inc corp co ltd vs etc no vol fig jan feb mar apr jun jul aug sept oct nov dec u.s u.n".split())
LONG_BLANKS, LONG_SENTENCE = 200, 3000
STOP = re.compile(r"(\.{2,})|([.!?])(?=[\s\"')]|\Z)")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text.

    A run of full stops ends one, and so does an end mark before white space or a quote unless its word is an
    abbreviation; closing quotes and brackets go with it. So do 200 blanks. A sentence of over 3000 characters is cut
    at white space.
    """
    out, at = [], 0
    while at < len(text):
        start = at + len(text[at:]) - len(text[at:].lstrip()) if text[at : at + 1].isspace() else at
        if start >= len(text):
            break
        end = _end_of_sentence(text, start)
        out += _cut(text, start, end)
        at = end
    return out


def _end_of_sentence(text: str, start: int) -> int:
    at = start
    blanks = text.find(" " * LONG_BLANKS, start)
    while m := STOP.search(text, at):
        if 0 <= blanks < m.start():
            return blanks
        at = m.end()
        word = re.search(r"[\w.]*\Z", text[max(start, m.start() - 20) : m.start()])[0].lower()
        if m[2] == "." and (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha())) and text[at : at + 1].strip() == "" and at < len(text.rstrip()):
            continue
        while at < len(text) and text[at] in "\"')":
            at += 1
        return at
    return blanks if blanks >= 0 else len(text)


def _cut(text: str, start: int, end: int) -> list[tuple[int, int]]:
    out = []
    while end - start > LONG_SENTENCE:
        cut = text.rfind(" ", start + 1, start + LONG_SENTENCE)
        cut = cut if cut > start else start + LONG_SENTENCE
        out.append((start, cut))
        start = cut + len(text[cut:end]) - len(text[cut:end].lstrip())
    while end > start and text[end - 1].isspace():
        end -= 1
    return [*out, (start, end)] if end > start else out


def sentences_of(text: str) -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text)]


# --- numbers

SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
PLACES = {"hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}
NUMBERS = SMALL | TENS | PLACES | {"a": 1, "an": 1, "dozen": 12, "couple": 2}


def number_of(text: str) -> int:
    """The number that words, digits with commas, or both together say; 0 for other words."""
    total = group = 0
    for word in re.split(r"[-\s]+", text.strip().lower()):
        digits = word.replace(",", "")
        value = int(digits) if digits.isascii() and digits.isdigit() else NUMBERS.get(word, 0)
        if value == 100 and word == "hundred":
            group = max(group, 1) * 100
        elif value >= 1000 and word in PLACES:
            total, group = total + max(group, 1) * value, 0
        elif word == "dozen" and group:
            group *= 12
        else:
            group += value
    return total + group


# --- dates

WEEKDAYS = {w: n for n, w in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
MONTHS = {w: n for n, w in enumerate("january february march april may june july august september october november december".split(), 1)}
UNITS = "days? weeks? months? years?".split()
RELATIVE = re.compile(rf"(?i)\b(?:(today|yesterday|tomorrow)|(last|next|this)\s+({'|'.join([*WEEKDAYS, *MONTHS, 'week', 'month', 'year'])})|((?:[\w-]+\s)?[\w-]+)\s+({'|'.join(UNITS)})\s+(ago|later)|on\s+({'|'.join(WEEKDAYS)}))\b")


def _month(year: int, month: int) -> str:
    return f"{year + (month - 1) // 12:04d}-{(month - 1) % 12 + 1:02d}"


def relative_dates(text: str, day: date) -> list[tuple[int, int, str]]:
    """(start, end, TIMEX) of expressions such as *last Tuesday* or *three weeks ago*, seen from ``day``."""
    out = []
    for m in RELATIVE.finditer(text):
        plain, way, unit, count, units, side, weekday = (x.lower() if x else x for x in m.groups())
        start, step = m.start(), {"last": -1, "next": 1, "this": 0}.get(way, 0)
        if plain:
            value = (day + timedelta(days={"today": 0, "yesterday": -1, "tomorrow": 1}[plain])).isoformat()
        elif weekday or unit in WEEKDAYS:
            back = (day.weekday() - WEEKDAYS[weekday or unit]) % 7
            value = (day + timedelta(days=7 - back if step > 0 else -(back or 7) if weekday or step < 0 else -back)).isoformat()
        elif unit in MONTHS:
            past = MONTHS[unit] < day.month
            value = _month(day.year + (step if step < 0 and not past else 1 if step > 0 and (past or MONTHS[unit] == day.month) else 0), MONTHS[unit])
        else:
            n = step
            if units:
                words = count.split()
                n = number_of(count) if number_of(words[-1]) else 0
                if len(words) > 1 and not number_of(words[0]):
                    n, start = number_of(words[-1]), m.start() + m.group(4).index(" ") + 1
                n = -n if side == "ago" else n
                if not n:
                    continue
            name = (unit or units).rstrip("s")
            if name == "day":
                value = (day + timedelta(days=n)).isoformat()
            elif name == "week":
                year, week, _ = (day + timedelta(weeks=n)).isocalendar()
                value = f"{year}-W{week:02d}"
            else:
                value = _month(day.year, day.month + n) if name == "month" else f"{day.year + n:04d}"
        out.append((start, m.end(), value))
    return out


# --- stems


class _Stem:
    """A word on its way through the steps of Porter's algorithm (1980)."""

    def __init__(self, word: str) -> None:
        self.w = word

    def consonant(self, i: int) -> bool:
        c = self.w[i]
        return c not in "aeiou" and (c != "y" or i == 0 or not self.consonant(i - 1))

    def measure(self, n: int) -> int:
        """Changes from vowels to consonants in the first ``n`` letters."""
        kinds = [self.consonant(i) for i in range(n)]
        return sum(b and not a for a, b in zip(kinds[:-1], kinds[1:], strict=True))

    def vowel(self, n: int) -> bool:
        return any(not self.consonant(i) for i in range(n))

    def short(self, n: int) -> bool:
        """The first ``n`` letters end consonant, vowel, consonant, the last not w, x or y."""
        return n >= 3 and self.consonant(n - 1) and not self.consonant(n - 2) and self.consonant(n - 3) and self.w[n - 1] not in "wxy"

    def doubled(self) -> bool:
        return len(self.w) >= 2 and self.w[-1] == self.w[-2] and self.consonant(len(self.w) - 1)

    def swap(self, pairs: list[tuple[str, str]], least: int) -> bool:
        """Replaces the first of the endings that fits, if enough of the word is left before it."""
        for old, new in pairs:
            if self.w.endswith(old):
                n = len(self.w) - len(old)
                if self.measure(n) > least:
                    self.w = self.w[:n] + new
                return True
        return False


STEP_2 = [tuple(x.split(":")) for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split()]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def stem(word: str) -> str:
    """The stem of a lower-case word by Porter's algorithm; words of one or two letters are their own."""
    if len(word) <= 2:
        return word
    s = _Stem(word)
    if s.w.endswith("sses") or s.w.endswith("ies"):
        s.w = s.w[:-2]
    elif s.w.endswith("s") and not s.w.endswith("ss"):
        s.w = s.w[:-1]
    if s.w.endswith("eed"):
        if s.measure(len(s.w) - 3) > 0:
            s.w = s.w[:-1]
    else:
        for old in ("ed", "ing"):
            if s.w.endswith(old) and s.vowel(len(s.w) - len(old)):
                s.w = s.w[: -len(old)]
                if s.w.endswith(("at", "bl", "iz")):
                    s.w += "e"
                elif s.doubled() and s.w[-1] not in "lsz":
                    s.w = s.w[:-1]
                elif s.measure(len(s.w)) == 1 and s.short(len(s.w)):
                    s.w += "e"
                break
    if s.w.endswith("y") and s.vowel(len(s.w) - 1):
        s.w = s.w[:-1] + "i"
    s.swap(STEP_2, 0)
    s.swap(STEP_3, 0)
    for old in sorted([*STEP_4, "sion", "tion"], key=len, reverse=True):
        if s.w.endswith(old):
            n = len(s.w) - (3 if old in ("sion", "tion") else len(old))
            if s.measure(n) > 1:
                s.w = s.w[:n]
            break
    if s.w.endswith("e"):
        n = len(s.w) - 1
        if s.measure(n) > 1 or (s.measure(n) == 1 and not s.short(n)):
            s.w = s.w[:n]
    if s.measure(len(s.w)) > 1 and s.doubled() and s.w.endswith("l"):
        s.w = s.w[:-1]
    return s.w


# --- prose

WINDOW, SHARE, MIN_WORDS = 20, 0.5, 5


def _plain(word: str) -> bool:
    """Letters alone, with one mark after them at most: no junk, and most words."""
    return len(word) > 1 and (word.isalpha() or (word[-1] in ".,:\";'?%)" and word[:-1].isalpha()))


@lru_cache(1 << 16)
def is_junk(word: str) -> bool:
    """Whether a word is none of prose: a lone sign, letters mixed with digits, or signs where words have none."""
    if len(word) == 1 and word not in "AaIi-":
        return True
    letters, digits = sum(c.isalpha() for c in word), sum(c.isdigit() for c in word)
    if digits and not letters and all(c.isdigit() or c == "," for c in word):
        return False
    bare = re.sub(r"\A[\"'$`(]|[.,:\";'?%)]\Z", "", word)
    odd = re.sub(r"'[ts]\Z|(?<!\A)\.|-", "", bare)
    return bool(letters and digits) or any(not c.isalpha() and not c.isdigit() for c in odd)


def prose_regions(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether prose) of the stretches of a text.

    From a junk word, or one alone between tabs or line ends, a stretch goes on while half of its last twenty words
    are such; it is cut back to the last two of them in a row and must have five words.
    """
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    bad = [not _plain(text[a:b]) and is_junk(text[a:b]) or _alone(text, a, b) for a, b in spans]
    cuts, i, last_junk = [], 0, _last_junk(bad)
    while i < len(spans):
        last = last_junk(i) if bad[i] else -1
        if last >= 0:
            cuts.append((spans[i][0], spans[last][1]))
            i = last + 1
        else:
            i += 1
    out, at = [], 0
    for a, b in cuts:
        if a > at:
            out.append((at, a, True))
        out.append((a, b, False))
        at = b
    return [*out, (at, len(text), True)] if text[at:].strip() else out


def _alone(text: str, a: int, b: int) -> bool:
    return _edge(text, range(a - 1, max(a - 201, -1), -1)) and _edge(text, range(b, min(b + 200, len(text))))


def _edge(text: str, places: range) -> bool:
    """Whether a tab or line end comes before any letter or digit."""
    for i in places:
        c = text[i]
        if c in "\t\n":
            return True
        if c.isalnum():
            return False
    return True


def _last_junk(bad: list[bool]) -> Callable[[int], int]:
    """For a start, the last word of its stretch, or -1: after passes over all words a start takes ``WINDOW`` steps at most."""
    n = len(bad)
    before, pair = [0], [-1] * n
    for j, x in enumerate(bad):
        before.append(before[-1] + x)
        pair[j] = j if x and j and bad[j - 1] else pair[j - 1] if j else -1
    fails = [n] * (n + 1)  # the first place from here on whose whole window holds too little
    for j in range(n - 1, WINDOW - 2, -1):
        fails[j] = j if (before[j + 1] - before[j + 1 - WINDOW]) / WINDOW < SHARE else fails[j + 1]

    def last(start: int) -> int:
        whole = min(start + WINDOW - 1, n)
        stop = next((j for j in range(start, whole) if (before[j + 1] - before[start]) / (j + 1 - start) < SHARE), None)
        stop = fails[whole] if stop is None else stop
        if stop < n and stop - start < MIN_WORDS - 1:
            return -1
        end = max(pair[max(stop - 1, start)], start)
        return end if end - start >= MIN_WORDS - 1 else -1

    return last
