"""Snowball stemmers for Russian and English as column expressions.

Each rule is one replacement by a pattern, built from a table of endings; a pattern begins with the part of the word that
must stay, so that an ending only fits in its region: RV lies behind the first vowel, R1 behind the first consonant
after a vowel, R2 is R1's own R1. A rule that must be the last of its kind leaves a mark at the word's end, behind which
no later ending fits; marks go at the end. Words are folded and lower-case. All endings are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DONE, _CUT, _AT = "\u0001", "\u0002", "\u0003"


def _any(endings: list[str]) -> str:
    return "(?:" + "|".join(sorted(endings, key=len, reverse=True)) + ")"


# Russian

RU_VOWELS = "аеиоуыэюя"
# Groups of two hold (endings that follow а or я, endings of their own).
GERUND = (["в", "вши", "вшись"], ["ив", "ивши", "ившись", "ыв", "ывши", "ывшись"])
ADJECTIVE = ["ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею"]
PARTICIPLE = (["ем", "нн", "вш", "ющ", "щ"], ["ивш", "ывш", "ующ"])
REFLEXIVE = ["ся", "сь"]
VERB = (
    ["ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"],
    ["ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"],
)
NOUN = [
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом",
    "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
]
DERIVATIONAL = ["ост", "ость"]
SUPERLATIVE = ["ейш", "ейше"]


def russian(word: Column) -> Column:
    v = RU_VOWELS
    rv = f"[^{v}]*[{v}].*?"
    r2 = f"[^{v}]*[{v}]+[^{v}][^{v}]*[{v}]+[^{v}].*?"
    either = lambda group: f"(?:({rv}[ая]){_any(group[0])}|({rv}){_any(group[1])})"
    rules = [
        (f"^{either(GERUND)}$", f"$1$2{_DONE}"),
        (f"^({rv}){_any(REFLEXIVE)}$", "$1"),
        (f"^(?:{either(PARTICIPLE)}|({rv})){_any(ADJECTIVE)}$", f"$1$2$3{_DONE}"),
        (f"^{either(VERB)}$", f"$1$2{_DONE}"),
        (f"^({rv}){_any(NOUN)}$", "$1"),
        (_DONE, ""),
        (f"^({rv})и$", "$1"),
        (f"^({r2}){_any(DERIVATIONAL)}$", "$1"),
        (f"^(?:({rv}н)н{_any(SUPERLATIVE)}?|({rv})(?:{_any(SUPERLATIVE)}|ь))$", "$1$2"),
    ]
    return _applied(word, rules)


# English

EN_VOWELS = "aeiouy"
EN_PREFIXES = ["gener", "commun", "arsen"]
EN_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
EN_DOUBLES = "bdfgmnprt"
EN_LI = "cdeghkmnrt"
#: Endings that need a letter before them.
EN_AFTER = {"ogi": "l", "li": EN_LI, "ion": "st"}


def english(word: Column) -> Column:
    v = EN_VOWELS
    r1 = f"(?>{'|'.join(EN_PREFIXES)}|[^{v}]*[{v}]+[^{v}])"
    r2 = f"{r1}[^{v}]*[{v}]+[^{v}].*"
    r1 += ".*"
    after = lambda e: f"(?<=[{EN_AFTER[e]}])" if e in EN_AFTER else ""
    rules = [
        ("^y", "Y"),
        (f"([{v}])y", "$1Y"),
        ("sses$", "ss"),
        ("(?<=..)ie[ds]$", "i"),
        ("ie[ds]$", "ie"),
        (f"^(.*[{v}].*[^us])s$", "$1"),
        (f"^({'|'.join(EN_KEPT)})$", f"$1{_DONE}"),
        (f"^({r1})eed(?:ly)?$", "$1ee"),
        (f"^(.*[{v}].*?)(?:(?<!e)ed(?:ly)?|ing(?:ly)?)$", f"$1{_CUT}"),
        (f"(at|bl|iz){_CUT}$", "$1e"),
        (f"([{EN_DOUBLES}])\\1{_CUT}$", "$1"),
        (f"^([^{v}]+[{v}][^{v}wxY]|[{v}][^{v}]|{'|'.join(EN_PREFIXES)}){_CUT}$", "$1e"),
        (_CUT, ""),
        (f"^(.+[^{v}])[yY]$", "$1i"),
    ]
    for table in (EN_STEP2, EN_STEP3, dict.fromkeys(EN_STEP4, "")):
        rules.append((f"{_any(list(table))}$", f"{_AT}$0"))  # the longest ending, whether it lies in the region or not
        for new in dict.fromkeys(table.values()):
            same = [f"{after(e)}{_AT}{e}" for e, n in table.items() if n == new and e != "ative"]
            region = r2 if len(table) == len(EN_STEP4) else r1
            rules.append((f"^({region})(?:{'|'.join(same)})$", f"$1{new}"))
        if "ative" in table:
            rules.append((f"^({r2}){_AT}ative$", "$1"))
        rules.append((_AT, ""))
    rules += [
        (f"^({r2})(?<=l)l$", "$1"),
        (f"^(?:({r2})|({r1})(?<![^{v}][{v}][^{v}wxY])(?<!^[{v}][^{v}]))e$", "$1$2"),
        (_DONE, ""),
        ("Y", "y"),
    ]
    fixed = F.create_map(*[F.lit(x) for pair in EN_WORDS.items() for x in pair])
    return F.when(F.length(word) <= 2, word).when(word.isin(*EN_WORDS), F.element_at(fixed, word)).otherwise(_applied(word, rules))


def _applied(word: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        word = F.regexp_replace(word, pattern, new)
    return word


def stem(word: Column) -> Column:
    """Words with a Cyrillic letter as Russian, others with a Latin one as English; numbers stay."""
    return F.when(word.rlike("[а-я]"), russian(word)).when(word.rlike("[a-z]"), english(word)).otherwise(word)
