"""Scalar functions on literal inputs of our own."""

import random

import pytest
from pyspark.sql import functions as F

from tomeflow.functions import text as T
from tomeflow.functions.numbers import english, english_ordinal, russian, russian_ordinal, spelled
from tomeflow.functions.speech import _Reader, normalize_for_speech, numerals_spoken, roman_number
from tomeflow.functions.translit import in_cyrillic, spelled_acronym


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_text_repair(spark):
    assert apply(spark, T.join_hyphenated, "экс- \nпресс Нью- Йорк", "a- b- c", "end -x") == ["экспресс Нью-Йорк", "abc", "end -x"]
    assert apply(spark, T.normalize_quotes, 'say "one" and “two', "it’s `x") == ["say «one» and «two", "it's 'x"]
    assert apply(spark, T.squeeze_spaces, " a \t b \r\n", " x\x1f") == ["a b", "x"]
    assert apply(spark, T.restore_big_o, "0( n) and 0 (n) 0(ж)") == ["O(n) and 0 (n) 0(ж)"]
    once = apply(spark, T.clean_text, 'A "quo- te"  0(n)\n«x', "")
    assert once[0] == "A «quote» O(n) «x" and apply(spark, T.clean_text, *once) == once


def test_links_and_abbreviations(spark):
    assert apply(spark, lambda c: T.strip_urls(c, "ru"), "см. https://x.org/a?b тут", "пиши на кто-то@почта.рф да") == ["см. ссылка тут", "пиши на ссылка да"]
    assert apply(spark, lambda c: T.expand_abbreviations(c, "ru"), "на стр. 5, т.е. там; экс.т.е.", "вв. и гг.")[0].startswith("на страница 5, то есть там")
    assert apply(spark, lambda c: T.expand_abbreviations(c, "en"), "e.g. a vs. b, xvs. c") == ["for example a versus b, xvs. c"]


def test_predicates(spark):
    assert apply(spark, T.is_open, "ends.", "open", "so: ", "«да»", "") == [False, True, False, False, True]
    assert apply(spark, T.is_speakable, "* * *", "5", "ж", "") == [False, True, True, False]
    assert apply(spark, T.non_alpha_share, "ab12", "", "a b") == [0.5, 0.0, 0.0]
    assert apply(spark, T.looks_like_page_number, " 12 ", "xiv", "- 7 -", "civil", "page 1") == [True, True, True, True, False]
    assert apply(spark, T.matching_form, " Глава 12 · 7 ") == ["глава # · #"]
    assert apply(spark, T.starts_like_footnote, "1. a", "12) b", "1234 c", "x") == [True, True, False, False]
    assert apply(spark, T.has_figure_marker, "\x02 c", "c") == [True, False]
    assert apply(spark, T.is_bare_number, " 12 ", "12345", "1a") == [True, False, False]


def test_language(spark):
    assert apply(spark, lambda c: T.foreign_share(c, "ru"), "аб cd", "12", "é") == [0.5, 0.0, 0.0]
    assert apply(spark, lambda c: T.language_warning(c, "en"), "абв d", "abc д")[0].asDict() == {"expected": "en", "found": "ru", "share": 0.75}
    assert apply(spark, lambda c: T.language_warning(c, "ru"), "абв d") == [None]
    assert apply(spark, lambda c: T.resolved_language(F.lit(None).cast("string"), c), "en-US", "DE", "", None) == ["en", "ru", "ru", "ru"]


def test_names_and_specs(spark):
    long = "word " * 30
    assert apply(spark, T.safe_filename, 'a:b/"c"', "", "???", long, "x" * 200) == ["a b c", "chapter", "chapter", ("word " * 18).strip(), "x" * 90]
    assert apply(spark, T.escape_metadata, "a=b;c#d\\e\nf") == ["a\\=b\\;c\\#d\\\\e\\\nf"]
    assert [r and tuple(r) for r in apply(spark, T.page_range, "10-20", " 7 ", "", "5-3", "0-2", "a", "1-2-3", None)] == [(10, 20), (7, 7), None, None, None, None, None, None]
    assert apply(spark, T.chapter_indexes, "1-3", "4", "x") == [[0, 1, 2], [3], None]
    assert apply(spark, T.roman_value, "XIV", "MCMXC", "III") == [14, 1990, 3]
    assert apply(spark, spelled_acronym, "IBM", "Ibm", "TOOLONGX") == ["ай-би-эм", None, None]


@pytest.mark.parametrize("n", [0, 7, 13, 21, 40, 100, 101, 999, 1000, 1001, 1100, 2005, 21_000, 1_000_000, 1_000_001, 12_345_678])
def test_spelled_numbers_are_distinct_and_ordered(n):
    assert english(n) != english(n + 1) and russian(n) != russian(n + 1) and english_ordinal(n) != english(n) and russian_ordinal(n) != russian_ordinal(n + 1)


def test_spelled_examples():
    assert english(2105) == "two thousand, one hundred and five" and english_ordinal(42) == "forty-second" and english_ordinal(20) == "twentieth"
    assert russian(2_001) == "две тысячи один" and russian(11_000) == "одиннадцать тысяч" and russian(5_000_022) == "пять миллионов двадцать два"
    assert russian_ordinal(40) == "сороковой" and russian_ordinal(2000) == "двухтысячный" and russian_ordinal(1900) == "тысяча девятисотый" and russian_ordinal(113) == "сто тринадцатый"
    assert spelled("2,25", "ru") == "две целых двадцать пять сотых" and spelled("0.5", "en") == "zero point five"


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ("в 1812 году", "в тысяча восемьсот двенадцатом году"), ("после 1945 года", "после тысяча девятьсот сорок пятого года"), ("к 2024 году", "к две тысячи двадцать четвёртому году"),
        ("Книга 3", "Книга третья"), ("том 12", "том двенадцатый"), ("в XVIII веке", "в восемнадцатом веке"), ("XVII—XVIII вв.", "семнадцатого—восемнадцатого веков"), ("до V в.", "до пятого века"),
        ("доля 7%", "доля семь процентов"), ("модель B2 и x64", "модель B2 и x64"), ("пункт IX", "пункт девять"), ("раздел 1000000", "раздел один миллион"),
        ("с 1991 года", "с тысяча девятьсот девяносто первого года"), ("в 2003 году", "в две тысячи третьем году"), ("за 1999 год", "за тысяча девятьсот девяносто девятый год"), ("перед 1999 годом", "перед одна тысяча девятьсот девяносто девять годом"),
        ("Глава XIV, 45", "Глава четырнадцатая, сорок пять"), ("на рубеже III — IV вв. до", "на рубеже третьего—четвёртого веков до"), ("XX век", "двадцатый век"), ("На xix веку", "На xix веку"), ("МВД и ЦИК", "МВД и ЦИК"),
        ("IIX и VX", "IIX и VX"), ("3,5 килограмма", "три целых пять десятых килограмма"), ("рост 45 % и 7%", "рост сорок пять процентов и семь процентов"), ("часть 12б", "часть 12б"), ("в V  в. нашей", "в пятом веке нашей"),
    ],
)
def test_russian_speech(said, expected):
    assert numerals_spoken(said, "ru") == expected and numerals_spoken(expected, "ru") == expected


def test_speech_column(spark):
    found = apply(spark, lambda c: normalize_for_speech(c, "en"), "See fig. 3 at www.x.org, i.e. 40% of II", None)
    assert found == ["See figure three at link that is forty percent of two", None] or found[0].startswith("See figure three at link")
    assert roman_number("MCMXCIV") == 1994


@pytest.mark.parametrize("language", ["ru", "en"])
def test_stretches_read_as_whole_texts_do(language):
    r = random.Random(4)
    some = ["в", "до", "года", "году", "век", "вв.", "в.", "XIX", "iv", "V", "—", "-", "1861", "12", "3,5", "45", "%", "Глава", "том", "слово", "word", "a1", "x.", "(7)", "\n", "   ", "№5;"]
    for _ in range(3000):
        text = "".join(r.choice(some) + r.choice(["", " ", " ", "  "]) for _ in range(r.randint(1, 30)))
        assert numerals_spoken(text, language) == _Reader(text, language).spoken(), text


def test_texts_without_numbers_stay_in_the_jvm(spark):
    """The column gives what the rules give, whether or not a text has to go to Python."""
    said = ["I am mild", "MIX of it", "no number", "Part II.", "в v веке", "xx век", "Глава 2", "x", "II-го", None]
    for language in ("ru", "en"):
        assert apply(spark, lambda c: normalize_for_speech(c, language), *said) == [None if t is None else numerals_spoken(t, language) for t in said]


def test_transliteration():
    assert [in_cyrillic(x) for x in ("Lake", "NATO", "R&D", "Chester", "x", "слово 5", "Kelly's")] == ["лэйк", "эн-эй-ти-оу", "ар энд ди", "честер", "экс", "слово 5", "келлй'с"]


def test_durations_of_long_texts(spark):
    sizes = [0, 1, 89_478, 89_479, 2**31 - 1]  # 24,000 frames for each of 89,479 characters are beyond an int
    found = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", T.speech_seconds(F.col("n")), T.gap_seconds(F.col("n"))).collect()
    assert [tuple(r) for r in found] == [(n, 1600 * n / 24000, round(n / 15 * 24000) / 24000) for n in sizes]


def test_one_decimal(spark):
    rng = random.Random(5)
    pairs = [(176, 1280), (94, 800), (1, 1), (0, 7), (1281, 1280), (3, 2), (10_000, 9_999)] + [(a, b) for b in (16, 80, 400, 1280, 2000) for a in range(0, b + 40, 3)]
    pairs += [(rng.randrange(2 * b), b) for b in (rng.randrange(1, 10**6) for _ in range(2000))]
    values = [(1 - a / b) * 100 for a, b in pairs] + [k / 20 for k in range(-2001, 2001, 2)] + [0.0499, 0.05, 0.01, 1e-9, 12345678.25]
    found = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double").orderBy("i").select(T.one_decimal(F.col("v"))).collect()
    assert [r[0] for r in found] == [*(f"{v:.1f}" for v in values), None]
