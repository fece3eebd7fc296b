"""Preparing text for a reader: numbers, Roman numerals, centuries, headings and years in words.

A text is read once as tokens. Each number or numeral is spoken by what stands beside it: a frame names the words
that may come before and after, and the case that its ordinal takes from them. Inflection needs Python, so this runs
as one Arrow UDF a column; texts without a digit or a letter that numerals are written with stay in the JVM.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .numbers import spelled
from .text import expand_abbreviations, strip_urls

# Words, endings and limits that results depend on.
ROMAN_DIGITS = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
#: Case: endings after a hard stem (-ый, -ой) and after a soft one (-ий).
CASE_ENDINGS = {"prepositional": ("ом", "ьем"), "dative": ("ому", "ьему"), "genitive": ("ого", "ьего"), "instrumental": ("ым", "ьим"), "feminine": ("ая", "ья"), "nominative": ("", "")}
HEADING_CASES = {"глава": "feminine", "часть": "feminine", "книга": "feminine", "раздел": "nominative", "том": "nominative"}
CENTURY_CASES = {"в": "prepositional", "на": "prepositional", "с": "genitive", "до": "genitive", "от": "genitive", "после": "genitive", "к": "nominative"}
CENTURY_WORDS = {"prepositional": "веке", "genitive": "века", "nominative": "век"}
CENTURIES = "веков"
YEAR_PREPOSITIONS = ("в", "к", "с", "до", "от", "после", "за", "на")
#: Beginning of the noun, prepositions (none: any), case; the first that fits holds.
YEAR_CASES = [
    ("годом", (), "instrumental"), ("года", (), "genitive"), ("годов", (), "genitive"),
    ("год", ("с", "до", "от", "после"), "genitive"), ("год", ("к",), "dative"), ("году", ("в", "на"), "prepositional"),
]
YEAR_DIGITS, HEADING_DIGITS = 4, 3
PERCENT_WORDS = {"ru": "процентов", "en": "percent"}
DASHES = "—–-"

#: A number that touches no word, a word, white space, or any one character.
_TOKENS = re.compile(r"(?P<number>(?<![\w.,])\d+(?:[.,]\d+)?(?!\w))|(?P<word>\w+)|(?P<space>\s+)|(?P<mark>.)", re.DOTALL)
#: Digits, and words that may be numerals.
_SIGNS = {"ru": re.compile(r"\d+|\b[MDCLXVImdclxvi]+\b"), "en": re.compile(r"\d+|\b[MDCLXVI]{2,}\b")}
#: Texts that have something to say in words: a digit, or a word of numerals' letters, which centuries write in either case.
_MAY_SPEAK = {"ru": "(?U)\\p{Nd}|\\b[MDCLXVImdclxvi]+\\b"}
_MAY_SPEAK_ELSE = "(?U)\\p{Nd}|\\b[MDCLXVI]{2,}\\b"


def roman_number(numeral: str) -> int:
    values = [ROMAN_DIGITS[c] for c in numeral.upper()]
    return sum(-v if any(w > v for w in values[i + 1 :]) else v for i, v in enumerate(values))


def roman_numeral(number: int) -> str:
    """The canonical numeral of 1 to 3999."""
    said = ""
    for one, five, ten in (("M", "", ""), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X")):
        digit, number = divmod(number, ROMAN_DIGITS[one])
        said += {4: one + five, 9: one + ten}.get(digit) or five * (digit >= 5) + one * (digit % 5 if five else digit)
    return said


@functools.lru_cache(maxsize=4096)
def roman_word(word: str) -> int | None:
    """The value of a word in letters of either case, if it is a canonical numeral."""
    if not 0 < len(word) <= 15 or not set(word.upper()) <= ROMAN_DIGITS.keys():
        return None
    value = roman_number(word)
    return value if 0 < value < 4000 and roman_numeral(value) == word.upper() else None


def inflected(ordinal: str, case: str) -> str:
    """The last word of a Russian ordinal with the ending of a case."""
    hard, soft = CASE_ENDINGS[case]
    if not hard or ordinal[-2:] not in ("ый", "ой", "ий"):
        return ordinal
    return ordinal[:-2] + (soft if ordinal.endswith("ий") else hard)


@functools.lru_cache(maxsize=65_536)
def _said(number: str, language: str, case: str | None = None) -> str | None:
    """A number in words, as an ordinal in a case if there is one; None if it can't be spelled."""
    try:
        said = spelled(number, language, case is not None)
    except ValueError:
        return None
    return inflected(said, case) if case and language == "ru" else said


class _Reader:
    """The tokens of a text, and what has been said of them so far."""

    def __init__(self, text: str, language: str) -> None:
        found = [(m.lastgroup, m[0]) for m in _TOKENS.finditer(text)]
        self.kinds, self.tokens = [k for k, _ in found], [t for _, t in found]
        self.russian, self.language = language == "ru", language

    def beside(self, i: int, step: int) -> int | None:
        """The place of the token beyond the white space beside i, if there is white space and a token."""
        if 0 <= i + 2 * step < len(self.tokens) and self.kinds[i + step] == "space":
            return i + 2 * step
        return None

    def word(self, i: int | None) -> str:
        return self.tokens[i].lower() if i is not None and self.kinds[i] == "word" else ""

    def numeral(self, i: int | None) -> int | None:
        """The value of the numeral at i, where it has seven letters at most, as those of centuries do."""
        return roman_word(self.tokens[i]) if i is not None and self.kinds[i] == "word" and len(self.tokens[i]) <= 7 else None

    def second(self, i: int) -> int | None:
        """The place of a numeral that follows the one at i after a dash."""
        j = i + 1 + (self.kinds[i + 1 : i + 2] == ["space"])
        if self.tokens[j : j + 1] and self.tokens[j] in DASHES:
            j += 1 + (self.kinds[j + 1 : j + 2] == ["space"])
            if j < len(self.tokens) and self.numeral(j):
                return j
        return None

    def century(self, i: int) -> tuple[str, int] | None:
        """What to say for the numeral of a century, or two, and the noun after it; and the place after the noun."""
        if self.numeral(i) is None:
            return None
        last = self.second(i)
        numbers, noun = [self.numeral(i)], self.beside(i, 1)
        if last is not None:
            numbers, noun = [*numbers, self.numeral(last)], self.beside(last, 1)
        word = self.word(noun)
        if word in ("в", "вв") and self.tokens[noun + 1 : noun + 2] == ["."]:
            end = noun + 2
        elif word.startswith("век") and set(word[3:]) <= set("аеовх"):
            end = noun + 1
        else:
            return None
        case = CENTURY_CASES.get(self.word(self.beside(i, -1)), "nominative") if len(numbers) == 1 else "genitive"
        said = "—".join(_said(str(n), "ru", case) for n in numbers)
        return f"{said} {CENTURY_WORDS[case] if len(numbers) == 1 else CENTURIES}", end

    def frame(self, i: int, number: str) -> str | None:
        """The case in which the number at i is said as an ordinal, or None if it isn't one."""
        before = self.word(self.beside(i, -1))
        if self.russian and len(number) <= HEADING_DIGITS and before in HEADING_CASES:
            return HEADING_CASES[before]
        noun = self.word(self.beside(i, 1))
        if len(number) == YEAR_DIGITS and before in YEAR_PREPOSITIONS and noun.startswith("год"):
            return next((case for begin, near, case in YEAR_CASES if noun.startswith(begin) and (not near or before in near)), "nominative")
        return None

    def spoken(self) -> str:
        out, i = [], 0
        while i < len(self.tokens):
            token, kind = self.tokens[i], self.kinds[i]
            if kind == "word" and self.russian and (found := self.century(i)):
                out.append(found[0])
                i = found[1]
                continue
            if kind == "word" and len(token) > 1 and token.isupper() and (value := roman_word(token)):
                kind, token = "number", str(value)
            if kind == "number":
                case = self.frame(i, token) if token.isdecimal() else None
                percent = self.beside(i, 1) if self.kinds[i + 1 : i + 2] == ["space"] else i + 1
                token = (case and _said(token, self.language, case)) or _said(token, self.language) or token
                if not case and percent is not None and self.tokens[percent : percent + 1] == ["%"]:
                    token, i = f"{token} {PERCENT_WORDS.get(self.language, 'percent')}", percent
            out.append(token)
            i += 1
        return "".join(out)


def _around(text: str, begin: int, end: int) -> tuple[int, int]:
    """The stretch begin:end with what may bear on it: the chunk of text before its own, and four behind it."""
    for _ in range(2):
        while begin and text[begin - 1].isspace():
            begin -= 1
        while begin and not text[begin - 1].isspace():
            begin -= 1
    n = len(text)
    for _ in range(5):
        while end < n and not text[end].isspace():
            end += 1
        while end < n and text[end].isspace():
            end += 1
    return begin, end


def numerals_spoken(text: str, language: str) -> str:
    """Centuries, Roman numerals, headings, years, percentages and bare numbers in words.

    Only stretches around digits and numerals are read as tokens; the rest of a text stays as it is.
    """
    stretches: list[tuple[int, int]] = []
    for m in _SIGNS.get(language, _SIGNS["en"]).finditer(text):
        begin, end = _around(text, m.start(), m.end())
        if stretches and begin <= stretches[-1][1]:
            stretches[-1] = (stretches[-1][0], max(end, stretches[-1][1]))
        else:
            stretches.append((begin, end))
    out, at = [], 0
    for begin, end in stretches:
        out += [text[at:begin], _Reader(text[begin:end], language).spoken()]
        at = end
    return "".join(out) + text[at:]


@functools.cache
def _spoken_udf(language: str):
    @pandas_udf(StringType())
    def spoken(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else numerals_spoken(t, language))

    return spoken


def normalize_for_speech(c: Column, language: str) -> Column:
    """A line as a reader should say it; a second pass changes nothing."""
    plain = expand_abbreviations(strip_urls(c, language), language)
    may = F.regexp_like(plain, F.lit(_MAY_SPEAK.get(language, _MAY_SPEAK_ELSE)))
    return F.coalesce(_spoken_udf(language)(F.when(may, plain)), plain)
