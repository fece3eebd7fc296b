"""Scalar text functions as Columns: repair, predicates, names, keys and estimates.

Everything here is built from JVM functions; those with a lambda are interpreted, the others compiled with their stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
QUOTE_CLASS = '["“„‟«”‘»]'
APOSTROPHE_CLASS = "[’‛ʼ`]"
SPACE_CLASS = "[ \\t\\u00a0\\u2007\\u202f\\r\\n]+"
TERMINAL_CLASS = '[.!?…:;»"”’]'
ABBREVIATIONS = {
    "ru": {"т.е.": "то есть", "т.д.": "так далее", "т.п.": "тому подобное", "т.к.": "так как", "стр.": "страница", "см.": "смотри", "др.": "другие", "гг.": "годы", "вв.": "века"},
    "en": {"e.g.": "for example", "i.e.": "that is", "Fig.": "Figure", "fig.": "figure", "etc.": "et cetera", "vs.": "versus"},
}
LINK_STARTS, LINK_REST = ("http://", "https://", "www\\."), "\\S+"
MAIL_NAME, MAIL_HOST = "[\\w.+-]+", "[\\w-]+\\.[\\w.]+\\b"
LINK_WORDS = {"ru": "ссылка", "en": "link"}
UNTITLED = {"ru": "Без названия", "en": "Untitled"}
OPENING = {"ru": "Начало", "en": "Beginning"}
CHARS_PER_SECOND = 15
WAV_BYTES_PER_SECOND = 48_000
WORKING_COPIES = 2.5
FOREIGN_LIMIT = 0.25
ENGINE_RATE = 24_000

#: White space as Unicode has it, with the four separators that only some tables count.
_SPACE = "(?U)[\\s\\x1c-\\x1f]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def join_hyphenated(c: Column) -> Column:
    """Words broken over lines by a hyphen, joined; before a capital the hyphen stays."""
    c = F.regexp_replace(c, "(?U)(?<=\\w)-[\\s\\x1c-\\x1f]+(?=[a-zа-яё])", "")
    return F.regexp_replace(c, "(?U)(?<=\\w)-[\\s\\x1c-\\x1f]+(?=[A-ZА-ЯЁ])", "-")


def normalize_quotes(c: Column) -> Column:
    """Straight apostrophes; quotes of any kind open and close in turn as guillemets."""
    parts = F.split(F.regexp_replace(c, APOSTROPHE_CLASS, "'"), QUOTE_CLASS, -1)
    marked = F.transform(parts, lambda part, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, "«").otherwise("»"), part))
    return F.array_join(marked, "")


def squeeze_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE_CLASS, " "))


def restore_big_o(c: Column) -> Column:
    """0( before a Latin letter or digit is a lost capital O."""
    return F.regexp_replace(c, "0\\((?U)[\\s\\x1c-\\x1f]*([A-Za-z0-9])", "O($1")


def clean_text(c: Column) -> Column:
    """All repairs in their order; a second pass changes nothing."""
    return squeeze_spaces(normalize_quotes(join_hyphenated(restore_big_o(c))))


def strip_urls(c: Column, language: str = "en") -> Column:
    """Links and mail addresses, each as one word."""
    word = LINK_WORDS.get(language, "link")
    for kind in (f"(?:{'|'.join(LINK_STARTS)}){LINK_REST}", f"{MAIL_NAME}@{MAIL_HOST}"):
        c = F.regexp_replace(c, f"(?U)\\b{kind}", word)
    return c


def expand_abbreviations(c: Column, language: str = "en") -> Column:
    for short, full in ABBREVIATIONS.get(language, {}).items():
        c = F.regexp_replace(c, f"(?U)(?<!\\w)\\Q{short}\\E", full)
    return c


def is_open(c: Column) -> Column:
    """Does not end on a terminal mark."""
    return ~F.regexp_like(c, F.lit(f"{TERMINAL_CLASS}{_SPACE}*$"))


def is_speakable(c: Column) -> Column:
    return F.regexp_like(c, F.lit("[\\p{L}\\p{N}]"))


def non_alpha_share(c: Column) -> Column:
    """The share of characters that are neither letters nor white space; 0 of an empty text."""
    noise = F.length(F.regexp_replace(c, "(?U)[\\p{L}\\s\\x1c-\\x1f]", ""))
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(noise / F.length(c))


def matching_form(c: Column) -> Column:
    """The form in which edge lines of pages are compared."""
    return F.lower(strip(F.regexp_replace(c, "(?U)\\d+", "#")))


def looks_like_page_number(c: Column) -> Column:
    return F.regexp_like(strip(c), F.lit("(?U)^[\\divxlcdmIVXLCDM.\\s\\x1c-\\x1f\\-–—]+$"))


def has_figure_marker(c: Column) -> Column:
    return F.regexp_like(c, F.lit("^[\\x00-\\x1f]"))


def starts_like_footnote(c: Column) -> Column:
    return F.regexp_like(c, F.lit("(?U)^\\d{1,3}[\\s\\x1c-\\x1f.)]"))


def is_bare_number(c: Column) -> Column:
    return F.regexp_like(strip(c), F.lit("(?U)^\\d{1,4}$"))


def foreign_share(c: Column, language: str) -> Column:
    """The share of letters from the other script (Latin for ru, else Cyrillic); 0 without letters."""
    letters = F.regexp_count(c, F.lit("\\p{L}"))
    foreign = F.regexp_count(c, F.lit("[A-Za-z]" if language == "ru" else "(?=\\p{L})[\\u0400-\\u04ff]"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(foreign / letters)


def language_warning(c: Column, language: str) -> Column:
    """A struct (expected, found, share) where more than a quarter of the letters are foreign, else null."""
    share = foreign_share(c, language)
    found = F.lit("en" if language == "ru" else "ru")
    return F.when(share > FOREIGN_LIMIT, F.struct(F.lit(language).alias("expected"), found.alias("found"), F.bround(share, 2).alias("share")))


def resolved_language(explicit: Column, metadata: Column) -> Column:
    """The explicit language, else the first two letters of the metadata's; ru unless ru or en."""
    language = F.coalesce(explicit, F.substring(F.lower(F.nullif(metadata, F.lit(""))), 1, 2), F.lit("ru"))
    return F.when(language.isin("ru", "en"), language).otherwise("ru")


def label(labels: dict[str, str], language: Column) -> Column:
    return F.when(language == "ru", labels["ru"]).otherwise(labels["en"])


def cache_key(text: Column, voice: Column, engine: Column, version: Column) -> Column:
    return F.sha2(F.concat_ws("\0", text, voice, engine, version), 256)


def safe_filename(c: Column, limit: int = 90) -> Column:
    """A name without unsafe characters, cut at a word where that leaves more than half."""
    clean = strip(F.regexp_replace(F.regexp_replace(c, '[<>:"/\\\\|?*\\x00-\\x1f]', " "), f"{_SPACE}+", " "))
    head = F.substring(clean, 1, limit)
    space = F.lit(limit) - F.locate(" ", F.reverse(head))  # place of the last space from 0; `limit` if none
    cut = F.when((F.locate(" ", head) > 0) & (space > limit // 2), F.substring(head, F.lit(1), space)).otherwise(head)
    short = F.regexp_replace(cut, "[ ,.;:-]+$", "")
    name = F.when(F.length(clean) <= limit, clean).otherwise(short)
    return F.when(F.length(name) == 0, "chapter").otherwise(name)


def escape_metadata(c: Column) -> Column:
    """A backslash before each of = ; # \\ and newline."""
    return F.regexp_replace(c, "([=;#\\\\\n])", "\\\\$1")


def page_range(c: Column) -> Column:
    """'10-20' or '7' as a struct (first, last), spaces ignored; null for blank and for bad ranges."""
    bare = F.regexp_replace(c, " ", "")
    first = F.regexp_extract(bare, "^(\\d+)(?:-(\\d+))?$", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(bare, "^(\\d+)-(\\d+)$", 2).try_cast("int"), first)
    return F.when((first >= 1) & (first <= last), F.struct(first.alias("first"), last.alias("last")))


def chapter_indexes(c: Column) -> Column:
    """'1-3' or '4' as an array of chapter indexes from 0; null for bad ranges."""
    found = page_range(c)
    return F.when(found.isNotNull(), F.sequence(found["first"] - 1, found["last"] - 1))


def speech_seconds(chars: Column) -> Column:
    """Whole frames of the stub engine for so many characters, in seconds."""
    return F.floor(chars.cast("long") * ENGINE_RATE / CHARS_PER_SECOND) / ENGINE_RATE


def gap_seconds(chars: Column) -> Column:
    """The silence that stands for a failed chunk, in whole frames."""
    return F.bround(chars / CHARS_PER_SECOND * ENGINE_RATE, 0) / ENGINE_RATE


def wav_bytes(chars: Column) -> Column:
    """Disk needed for a book's working copies."""
    return F.floor(chars / CHARS_PER_SECOND * WAV_BYTES_PER_SECOND * WORKING_COPIES).cast("long")


def changed_speed(seconds: Column, factor: float) -> Column:
    return seconds / factor


def pcm16(samples: Column) -> Column:
    """Samples in -1..1 as 16-bit numbers, clipped and truncated."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int"))


def roman_value(c: Column) -> Column:
    """The value of a Roman numeral (capitals): each digit counts against the largest to its right."""
    digits = F.split(F.reverse(c), "")
    values = F.create_map(*(F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    step = lambda acc, d: F.struct((acc["total"] + F.when(values[d] >= acc["top"], values[d]).otherwise(-values[d])).alias("total"), F.greatest(acc["top"], values[d]).alias("top"))
    return F.aggregate(digits, start, step, lambda acc: acc["total"])


def minutes_left(elapsed: Column, done: Column, total: Column) -> Column:
    """What is left of a job at its pace so far; null before the first step."""
    return F.when(done > 0, elapsed * total / done - elapsed)


def one_decimal(c: Column) -> Column:
    """A number as text with one decimal: the nearest to its exact binary value, ties to an even digit, as printf does.

    Java's format rounds the shortest decimal notation, and halves up.
    """
    size, unit = F.abs(c), 1 << 58  # below 1/64, where bits of a double are finer, all round to 0.0
    whole = F.floor(size)
    tenths = F.floor((size - whole) * float(unit)) * 10
    digit, rest = F.shiftright(tenths, 58), tenths.bitwiseAND(F.lit(unit - 1))
    up = (rest > unit // 2) | ((rest == unit // 2) & (digit % 2 == 1))
    number = whole * 10 + digit + F.when(up, 1).otherwise(0)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(number / 10).cast("string"), F.lit("."), (number % 10).cast("string"))
