"""Tokens, sentences, stems, numbers and prose against cases written down beforehand."""

from __future__ import annotations

from datetime import date

import pytest

from lexweave.functions import english
from lexweave.operators.values import bracketed, phone_numbers

TOKENS = [
    ("$1", ["$", "1"]), ("$1$2$3", ["$", "1$", "2$", "3"]), ("hello $1 hello", ["hello", "$", "1", "hello"]), ("he said, \"'now", ["he", "said", ",", "``", "`", "now"]), ('"`hello', ["``", "`", "hello"]),
    ('hello "" world', ["hello", "``", "``", "world"]), ('he said, "now is the time', ["he", "said", ",", "``", "now", "is", "the", "time"]), ('end of my story."', ["end", "of", "my", "story", ".", "''"]), ("hello''", ["hello", "''"]),
    ("hello ''' world", ["hello", "'", "''", "world"]), ("hello ''90s world", ["hello", "''", "90s", "world"]), ("he said, ''nobody likes Michael Bolton", ["he", "said", ",", "``", "nobody", "likes", "Michael", "Bolton"]),
    ("why would you write ''_hello ?", ["why", "would", "you", "write", "''", "_hello", "?"]), ("hello.'", ["hello", ".", "'"]), ("end of my story.'`great story!", ["end", "of", "my", "story.", "'", "`", "great", "story", "!"]), ("that '70s show", ["that", "'", "70s", "show"]),
    ("don't tell me you're still here", ["do", "n't", "tell", "me", "you", "'re", "still", "here"]), ("the F.B.I.'s anti-privacy campaign", ["the", "F.B.I.", "'s", "anti-privacy", "campaign"]), ("so he said, 'what gives?", ["so", "he", "said", ",", "`", "what", "gives", "?"]),
    ("'i am sam. sam i am.", ["`", "i", "am", "sam.", "sam", "i", "am", "."]), ("**-leading", ["leading"]), ("**leading", ["**leading"]), (" John ((Doe))", ["John", "Doe"]), ("Ordinary English sentences (like this one)", ["Ordinary", "English", "sentences", "-LRB-", "like", "this", "one", "-RRB-"]),
    ("green onions (scallions)", ["green", "onions"]), ("four (4)", ["four"]), ("", ["-empty-"]),
]
STEMS = dict(zip("caresses ponies cats feed agreed plastered motoring sing conflated sized hopping falling hissing filing happy sky relational conditional rational vietnamization operator decisiveness triplicate formative electrical goodness revival adjustable replacement adoption homologous effective rate cease controll roll".split(), "caress poni cat feed agre plaster motor sing conflat size hop fall hiss file happi sky relat condit ration vietnam oper decis triplic form electr good reviv adjust replac adopt homolog effect rate ceas control roll".split(), strict=True))


@pytest.mark.parametrize(("text", "want"), TOKENS)
def test_tokens(text, want):
    assert english.english_tokens(text) == want


def test_long_tokens_and_sentences_are_cut_and_tokens_join_again():
    assert english.english_tokens("x" * 300) == ["x" * 100] and len(english.english_tokens("a " * 5000)) == 1000
    assert english.untokenized(english.english_tokens('He said, "we don\'t know."')) == 'He said, "we don\'t know."'
    assert english.regex_tokens("a/b c", [("/", " / ")]) == ["a", "/", "b", "c"]


def test_stems():
    assert {w: english.stem(w) for w in STEMS} == STEMS


def test_sentences():
    text = 'Mr. Smith went. "Really?" he said... Then J. R. left at 5.30 p.m. End'
    assert english.sentences_of(text) == ["Mr. Smith went.", '"Really?"', "he said...", "Then J. R. left at 5.30 p.m.", "End"]
    assert english.sentences_of("") == [] and english.sentences_of("  \n ") == []
    assert english.sentences_of("one" + " " * 200 + "two") == ["one", "two"]
    assert max(map(len, english.sentences_of("word " * 2000))) <= 3000


@pytest.mark.parametrize(("text", "want"), [("two hundred million", 200_000_000), ("270 million", 270_000_000), ("twenty-five", 25), ("1,234", 1234), ("three thousand four hundred and five", 3405), ("nothing", 0)])
def test_numbers(text, want):
    assert english.number_of(text) == want


def test_prose():
    text = "This is good prose text here. a1 b2 c3 d4 e5 f6 g7 x= y= More words in this sentence follow now and they are fine."
    assert english.prose_regions(text) == [(0, 30, True), (30, 56, False), (56, 114, True)]
    assert english.prose_regions("") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Call me at 617-873-3200.", ["617-873-3200"]), ("( 617 ) 873-3200 is mine", ["(617) 873-3200"]), ("from 1872-1913 on", []), ("on 2002-03-14 we", []), ("ZIP 33915-2167", []), ("ISBN 978-3-16-1484", []), ("tel. 12 345 6789 now", ["12 345 6789"]),
        ("the final 12345 123 4567 football", []), ("the final 12345 123 4567 there", ["12345 123 4567"]), ("see 555 123 4567 there", ["555 123 4567"]), ("dial +49 30 123456", ["+49 30 123456"]), ("12345", []),
    ],
)
def test_phone_numbers(text, want):
    assert [p[2] for p in phone_numbers(bracketed(text))] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We met yesterday.", ["2004-07-08"]), ("last Tuesday and next Friday", ["2004-07-06", "2004-07-16"]), ("three weeks ago", ["2004-W25"]), ("two months later", ["2004-09"]), ("last year", ["2003"]), ("next month", ["2004-08"]),
        ("last July", ["2003-07"]), ("this March", ["2004-03"]), ("on Monday", ["2004-07-05"]), ("some days ago", []), ("about 10 days ago", ["2004-06-29"]), ("nothing", []),
    ],
)
def test_relative_dates(text, want):
    assert [v for _, _, v in english.relative_dates(text, date(2004, 7, 9))] == want
