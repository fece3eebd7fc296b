"""Latin words in Cyrillic letters, for a Russian voice."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Letter names, letters and letter groups in the order of their precedence.
NAMES = {
    "a": "эй", "b": "би", "c": "си", "d": "ди", "e": "и", "f": "эф", "g": "джи", "h": "эйч", "i": "ай", "j": "джей", "k": "кей", "l": "эл", "m": "эм",
    "n": "эн", "o": "оу", "p": "пи", "q": "кью", "r": "ар", "s": "эс", "t": "ти", "u": "ю", "v": "ви", "w": "дабл-ю", "x": "экс", "y": "уай", "z": "зед",
}
LETTERS = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "дж", "k": "к", "l": "л", "m": "м",
    "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "й", "z": "з",
}
PAIRS = {
    "sch": "ш", "tch": "ч", "ch": "ч", "sh": "ш", "th": "т", "ph": "ф", "ck": "к", "qu": "кв", "ee": "и", "ea": "и",
    "oo": "у", "ou": "ау", "ay": "эй", "ey": "эй", "ai": "эй", "oy": "ой", "ya": "я", "yu": "ю", "ye": "е", "yo": "ё",
}
LONG_VOWELS = {"a": "эй", "e": "и", "i": "ай", "o": "оу", "u": "ю"}
CONSONANTS = "bcdfghjklmnpqrstvwxz"
JOINERS = "'’-"

#: Letters, and more letters after single joiners.
_WORD = re.compile(f"[A-Za-z]+(?:[{JOINERS}][A-Za-z]+)*")
_MAGIC = re.compile(rf"([aeiou])([{CONSONANTS}])e$")
_SILENT = re.compile(rf"(?<=...[{CONSONANTS}])e$")
_AND = re.compile(r"\s*&\s*")
_SOUND = re.compile("|".join([*PAIRS, "(?<=.)y$", "[a-z]"]), re.DOTALL)


def sounded(word: str) -> str:
    """A word as it may sound: a vowel before one consonant and a last e is long, a last e is silent."""
    low = word.lower()
    long = _MAGIC.search(low)
    if long:
        low = low[: long.start()] + LONG_VOWELS[long.group(1)] + long.group(2)
    else:
        low = _SILENT.sub("", low)
    return _SOUND.sub(lambda m: PAIRS.get(m.group(0)) or ("и" if m.group(0) == "y" and m.start() and m.end() == len(low) else LETTERS[m.group(0)]), low)


@functools.lru_cache(maxsize=200_000)
def said(word: str) -> str:
    """A word, or the letters of a short one in capitals by their names; each worker works a word out once."""
    letters = "".join(c for c in word if c not in JOINERS)
    if len(letters) == 1 or (letters.isupper() and len(letters) <= 6):
        return "-".join(NAMES[c] for c in letters.lower())
    return sounded(word)


def in_cyrillic(text: str) -> str:
    if not re.search("[A-Za-z]", text):
        return text
    return _WORD.sub(lambda m: said(m[0]), _AND.sub(" энд ", text) if "&" in text else text)


@pandas_udf(StringType())
def _in_cyrillic(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else in_cyrillic(t))


def latin_to_cyrillic(c: Column) -> Column:
    """Texts without a Latin letter stay as they are, in the JVM."""
    latin = F.regexp_like(c, F.lit("[A-Za-z]"))
    return F.coalesce(_in_cyrillic(F.when(latin, c)), c)


def spelled_acronym(c: Column) -> Column:
    """Letter names of a word of two to six capitals, joined by hyphens; null for others."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    spoken = F.array_join(F.transform(F.split(F.lower(c), ""), lambda x: names[x]), "-")
    return F.when(F.regexp_like(c, F.lit("^[A-Z]{2,6}$")), spoken)
