"""Numbers in words, Russian and English: cardinals, ordinals and decimals."""

from __future__ import annotations

# Number words.
EN_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "_ ten twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_GROUPS = ["", "thousand", "million", "billion", "trillion", "quadrillion"]
EN_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
RU_SMALL = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU_TENS = "_ десять двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "_ сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
RU_GROUPS = [("", "", ""), ("тысяча", "тысячи", "тысяч"), ("миллион", "миллиона", "миллионов"), ("миллиард", "миллиарда", "миллиардов"), ("триллион", "триллиона", "триллионов"), ("квадриллион", "квадриллиона", "квадриллионов")]
RU_ORDINALS = "нулевой первый второй третий четвёртый пятый шестой седьмой восьмой девятый десятый одиннадцатый двенадцатый тринадцатый четырнадцатый пятнадцатый шестнадцатый семнадцатый восемнадцатый девятнадцатый".split()
RU_TEN_ORDINALS = "_ десятый двадцатый тридцатый сороковой пятидесятый шестидесятый семидесятый восьмидесятый девяностый".split()
RU_HUNDRED_ORDINALS = "_ сотый двухсотый трёхсотый четырёхсотый пятисотый шестисотый семисотый восьмисотый девятисотый".split()
RU_GROUP_ORDINALS = ["", "тысячный", "миллионный", "миллиардный", "триллионный", "квадриллионный"]
RU_GENITIVE_SMALL = "_ одно двух трёх четырёх пяти шести семи восьми девяти десяти одиннадцати двенадцати тринадцати четырнадцати пятнадцати шестнадцати семнадцати восемнадцати девятнадцати".split()
RU_GENITIVE_TENS = "_ десяти двадцати тридцати сорока пятидесяти шестидесяти семидесяти восьмидесяти девяносто".split()
RU_GENITIVE_HUNDREDS = "_ сто двухсот трёхсот четырёхсот пятисот шестисот семисот восьмисот девятисот".split()
RU_FRACTIONS = ["", "десятая", "сотая", "тысячная", "десятитысячная", "стотысячная", "миллионная"]


def _groups(n: int) -> list[tuple[int, int]]:
    """(power of a thousand, its three digits), highest first, empty ones left out."""
    found, power = [], 0
    while n:
        n, group = divmod(n, 1000)
        if group:
            found.append((power, group))
        power += 1
    return found[::-1]


def _english_group(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    tens, ones = divmod(rest, 10)
    low = EN_SMALL[rest] if rest < 20 else EN_TENS[tens] + (f"-{EN_SMALL[ones]}" if ones else "")
    if not hundreds:
        return low
    return f"{EN_SMALL[hundreds]} hundred" + (f" and {low}" if rest else "")


def english(n: int) -> str:
    if n >= 1000 ** len(EN_GROUPS):
        raise ValueError("too large to spell")
    if n == 0:
        return EN_SMALL[0]
    groups = _groups(n)
    said = [f"{_english_group(g)} {EN_GROUPS[p]}".strip() for p, g in groups]
    last_small = groups[-1][0] == 0 and groups[-1][1] < 100 and len(groups) > 1
    return f"{', '.join(said[:-1])} and {said[-1]}" if last_small else ", ".join(said)


def english_ordinal(n: int) -> str:
    said = english(n)
    cut = max(said.rfind(" "), said.rfind("-")) + 1
    head, last = said[:cut], said[cut:]
    if last in EN_ORDINALS:
        return head + EN_ORDINALS[last]
    return head + (f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th")


def _russian_group(n: int, feminine: bool) -> list[str]:
    hundreds, rest = divmod(n, 100)
    said = [RU_HUNDREDS[hundreds]] if hundreds else []
    if rest >= 20:
        said.append(RU_TENS[rest // 10])
        rest %= 10
    if rest:
        said.append({1: "одна", 2: "две"}.get(rest, RU_SMALL[rest]) if feminine else RU_SMALL[rest])
    return said


def _form(n: int) -> int:
    """Which of the three forms of a noun stands after n."""
    if n % 100 in range(11, 20):
        return 2
    return 0 if n % 10 == 1 else 1 if n % 10 in (2, 3, 4) else 2


def russian(n: int, feminine: bool = False) -> str:
    if n >= 1000 ** len(RU_GROUPS):
        raise ValueError("too large to spell")
    said: list[str] = []
    for power, group in _groups(n):
        said += _russian_group(group, feminine if power == 0 else power == 1)
        if power:
            said.append(RU_GROUPS[power][_form(group)])
    return " ".join(said) or RU_SMALL[0]


def _russian_prefix(n: int) -> str:
    """Three digits as the first part of a compound ordinal."""
    hundreds, rest = divmod(n, 100)
    said = [RU_GENITIVE_HUNDREDS[hundreds]] if hundreds else []
    if rest >= 20:
        said.append(RU_GENITIVE_TENS[rest // 10])
        rest %= 10
    if rest:
        said.append(RU_GENITIVE_SMALL[rest])
    return "".join(said)


def russian_ordinal(n: int) -> str:
    """Masculine, nominative. A leading single thousand is said without 'one'."""
    if n < 20:
        return RU_ORDINALS[n]
    groups = _groups(n)
    power, last = groups[-1]
    head: list[str] = []
    for p, g in groups[:-1]:
        head += [*([] if p == 1 and g == 1 else _russian_group(g, p == 1)), RU_GROUPS[p][_form(g)]]
    if power:
        return " ".join([*head, ("" if last == 1 else _russian_prefix(last)) + RU_GROUP_ORDINALS[power]])
    hundreds, rest = divmod(last, 100)
    tens, ones = divmod(rest, 10)
    if not rest:
        return " ".join([*head, RU_HUNDRED_ORDINALS[hundreds]])
    head += [RU_HUNDREDS[hundreds]] if hundreds else []
    if rest < 20:
        return " ".join([*head, RU_ORDINALS[rest]])
    return " ".join([*head, RU_TENS[tens], RU_ORDINALS[ones]] if ones else [*head, RU_TEN_ORDINALS[tens]])


def spelled(number: str, language: str, ordinal: bool = False) -> str:
    """A number as written (digits, one comma or point) in words."""
    whole, _, part = number.replace(",", ".").partition(".")
    part = part.rstrip("0") if part else ""
    if not part:
        n = int(whole)
        if language == "ru":
            return russian_ordinal(n) if ordinal else russian(n)
        said = english_ordinal(n) if ordinal else english(n)
        return f"{said} point zero" if "." in number.replace(",", ".") and not ordinal else said
    if language == "ru":
        if len(part) >= len(RU_FRACTIONS):
            raise ValueError("too fine to spell")
        n, fraction = int(whole), int(part)
        kind = RU_FRACTIONS[len(part)]
        ends = lambda word, k: word if _form(k) == 0 else word[:-2] + "ых"
        return f"{russian(n, True)} {'целая' if _form(n) == 0 else 'целых'} {russian(fraction, True)} {ends(kind, fraction)}"
    return f"{english(int(whole))} point {' '.join(EN_SMALL[int(d)] for d in part)}"
