"""Text as columns: cleaning, tokens, stems, quantities, positions, codes, identifiers.

Everything here is a built-in expression but for ``nfkc``, which Spark lacks, and ``long_tokens``, which is for whole texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions import stemming

# Endings cut from words; of several that fit, the longest is cut.
ENDINGS = (
    "ами", "ями", "ого", "его", "ому", "ему", "ыми", "ими", "ость", "ая", "яя", "ое", "ее", "ые", "ие", "ой", "ей", "ый", "ий",
    "ам", "ям", "ах", "ях", "ов", "ев", "ью", "ом", "ем", "а", "я", "ы", "и", "е", "о", "у", "ю", "ь", "й",
)
MIN_STEM = 4
# Month names that spreadsheets put in place of numbers.
MONTHS = {"янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12}
# Units of quantities and how each is written.
UNITS = {
    "м2": r"м2|м²|кв\.?\s?м(?:етр(?:а|ов)?)?",
    "м3": r"м3|м³|куб\.?\s?м(?:етр(?:а|ов)?)?",
    "кг": r"кг|килограмм(?:а|ов)?",
    "мл": r"мл|миллилитр(?:а|ов)?",
    "км": r"км|километр(?:а|ов)?",
    "т": r"тонн(?:а|ы)?|тн|т",
    "г": r"грамм(?:а|ов)?|гр|г",
    "шт": r"штук(?:а|и)?|шт",
    "л": r"литр(?:а|ов)?|л",
    "м": r"метр(?:а|ов)?|пог\.?\s?м|м",
    "упак": r"упаков(?:ка|ки|ок)|упак|уп",
    "пачка": r"пач(?:ка|ки|ек)|пач",
    "рулон": r"рулон(?:а|ов)?|рул",
    "компл": r"комплект(?:а|ов)?|компл|к-т",
    "коробка": r"короб(?:ка|ки|ок)|кор",
    "пара": r"пар(?:а|ы)?",
    "лист": r"лист(?:а|ов)?",
    "мешок": r"меш(?:ок|ка|ков)|меш",
    "бутылка": r"бутыл(?:ка|ки|ок)|бут",
}
# First words of segments that describe terms, not goods.
SERVICE_PREFIXES = ("доставк", "срок", "оплат", "адрес", "контакт", "телефон")
# Weights of the check digits of tax numbers.
INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)

# Words and numbers of a name, quantities, product codes.
WORD = r"[А-Яа-яЁёA-Za-z][А-Яа-яЁёA-Za-z-]*|\d+(?:[.,]\d+)?"
QUANTITY = (
    r"(?iuU)(?<![\w.,×*/])(\d{1,3}(?:[  ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)\s*("
    + "|".join(UNITS.values())
    + r")\.?(?![\w/²³])"
)
OKPD2 = r"(?iuU)(?:(?<=\s)|^)(?:окпд\s*2?\s*[:№]?\s*)?(\d{2}\.\d{2}(?:\.\d{1,3}){0,3})(?![\d.])"
# Words that a search passes over.
STOP_WORDS = (
    "а", "без", "более", "бы", "был", "была", "были", "было", "в", "вам", "вас", "во", "вот", "все", "всех", "вы", "где", "да", "для", "до",
    "его", "ее", "если", "есть", "же", "за", "и", "из", "или", "им", "их", "к", "как", "ко", "когда", "кто", "ли", "либо", "мне", "на", "над",
    "нам", "нас", "не", "нет", "ни", "но", "о", "об", "обо", "от", "ото", "по", "под", "при", "про", "с", "со", "так", "также", "то", "только",
    "у", "через", "что", "чтобы", "это", "этот", "нужен", "нужна", "нужно", "нужны", "требуется", "купить", "закупка", "поставка", "прошу",
    "a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with", "by", "from",
)
# What stands between tokens of a folded text.
NO_TOKEN = r"[^0-9a-zа-я]+"
# Punctuation that names do not begin or end with.
EDGES = r"[ \t,.;:\-–—*()\[\]{}\"'«»]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value`` where that is bound to a name: it is worked out once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def collapse(c: Column) -> Column:
    """Blanks become single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean(c: Column) -> Column:
    """NFKC, no zero-width spaces, control characters as blanks, blanks collapsed. Every text passes the UDF, in Arrow batches."""
    return tidy(nfkc(F.coalesce(c, F.lit(""))))


def tidy(c: Column) -> Column:
    """``clean`` without NFKC, which a higher-order function cannot call: for values inside maps and arrays."""
    return collapse(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u200b"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "))


def repair_dates(c: Column, months: Mapping[str, int] = MONTHS) -> Column:
    """``янв.79`` is 1.79 again and ``10.июн`` 10.6. Only a text that holds a month is gone through for each."""

    def repaired(c: Column) -> Column:
        for name, number in months.items():
            c = F.regexp_replace(c, rf"(?iuU)\b{name}\.(\d+)\b", f"{number}.$1")
        for name, number in months.items():
            c = F.regexp_replace(c, rf"(?iuU)\b(\d+)\.{name}\b", f"$1.{number}")
        return c

    return once(c, lambda c: F.when(c.rlike(f"(?iu){'|'.join(months)}"), repaired(c)).otherwise(c))


def stem(word: Column) -> Column:
    """The word without its longest known ending, where four characters or more stay."""
    return F.regexp_replace(fold(word), "^(.{%d,}?)(?:%s)$" % (MIN_STEM, "|".join(ENDINGS)), "$1")


def words(c: Column) -> Column:
    """Words and numbers, folded."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), fold)


def stems(c: Column) -> Column:
    return F.transform(words(c), stem)


def tokens(c: Column) -> Column:
    """Runs of digits and letters of the folded text."""
    return F.filter(F.split(fold(c), NO_TOKEN), lambda t: t != "")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _between(folded: pa.Array) -> pa.Array:
    return pc.split_pattern_regex(folded, NO_TOKEN)


def long_tokens(c: Column) -> Column:
    """``tokens`` of whole texts: Arrow splits them in batches, in a fraction of the time of Spark's own split."""
    return F.array_remove(_between(fold(c)), "")


def search_terms(c: Column) -> Column:
    """Tokens of two characters or more that are no stop words."""
    return F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def analyze(c: Column, stem_of=stemming.stem) -> Column:
    """Search terms by their stems: Snowball's, Russian for words with a Cyrillic letter, else English; or by ``stem_of``."""
    return F.transform(search_terms(c), stem_of)


def term_count(c: Column) -> Column:
    return F.least(F.lit(65535), F.size(tokens(c)))


def prefixes(c: Column, shortest: int = 3, longest: int = 6) -> Column:
    """Distinct token prefixes of ``shortest`` to ``longest`` characters."""
    long = F.filter(tokens(c), lambda t: F.length(t) >= shortest)
    each = F.transform(long, lambda t: F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(t))), lambda n: F.left(t, n)))
    return F.array_distinct(F.flatten(each))


def query_prefixes(c: Column, longest: int = 6, most: int = 64, stem_of=stemming.stem) -> Column:
    """What each search term and its stem begin with in common, at most ``longest`` characters; three at least."""

    def common(pair: Column) -> Column:
        word, root = pair["word"], pair["root"]
        return F.coalesce(*[F.when(F.left(word, F.lit(n)) == F.left(root, F.lit(n)), F.left(word, F.lit(n))) for n in range(longest, 0, -1)])

    pairs = F.transform(search_terms(c), lambda t: F.struct(t.alias("word"), stem_of(t).alias("root")))
    return F.slice(F.array_distinct(F.filter(F.transform(pairs, common), lambda t: F.length(t) >= 3)), 1, most)


def expand(c: Column, dictionary: Column) -> Column:
    """Each word replaced by what the map says for its folded form, else kept."""
    found = F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    return F.array_join(F.transform(found, lambda t: F.coalesce(F.try_element_at(dictionary, fold(t)), t)), " ")


def _quoted(phrase: str) -> str:
    return r"\Q" + phrase + r"\E"


def drop_phrases(c: Column, phrases: Sequence[str]) -> Column:
    for p in sorted(phrases, key=len, reverse=True):
        c = F.regexp_replace(c, rf"(?iuU)\b{_quoted(p)}\b", " ")
    return F.regexp_replace(collapse(c), r"^[ ,.;-]+|[ ,.;-]+$", "")


def find_sequence(haystack: Column, needle: Column) -> Column:
    """0-based place of the array ``needle`` in ``haystack``, or -1."""
    n, m = F.size(haystack), F.size(needle)
    starts = F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1)))
    at = F.array_position(F.transform(starts, lambda i: F.slice(haystack, i, F.greatest(m, F.lit(1))) == needle), True)
    return F.when((m == 0) | (m > n) | (at == 0), F.lit(-1)).otherwise(at - 1).cast("int")


def category_of(code: Column) -> Column:
    """``NN.NN``, else ``NN``, else ``unknown``."""
    none = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(none(F.regexp_extract(F.trim(code), r"^([0-9]{2}\.[0-9]{2})", 1)), none(F.regexp_extract(F.trim(code), r"^([0-9]{2})", 1)), F.lit("unknown"))


def okpd2(c: Column) -> Column:
    """The first product code in a text, labelled or bare; empty if none."""
    return F.regexp_extract(c, OKPD2, 1)


def without_okpd2(c: Column) -> Column:
    return F.regexp_replace(c, OKPD2, " ")


def quantity(c: Column) -> Column:
    """The last positive quantity as struct(value, unit), or null."""
    values, units = (F.regexp_extract_all(c, F.lit(QUANTITY), F.lit(i)) for i in (1, 2))
    number = lambda v: F.regexp_replace(F.regexp_replace(v, "[  ]", ""), ",", ".").try_cast("decimal(18,4)")
    unit = F.lit(None).cast("string")

    def canonical(raw: Column) -> Column:
        out = unit
        for name, pattern in reversed(UNITS.items()):
            out = F.when(F.rtrim(F.lower(raw), F.lit(".")).rlike(rf"^(?:{pattern})$"), name).otherwise(out)
        return out

    found = F.transform(F.arrays_zip(values.alias("v"), units.alias("u")), lambda x: F.struct(number(x["v"]).alias("value"), canonical(x["u"]).alias("unit")))
    return F.try_element_at(F.filter(found, lambda q: q["value"] > 0), F.lit(-1))


def positions(c: Column) -> Column:
    """The segments of a request: by hard breaks, numbers, dashes of a dashed list, and joints after quantities."""
    joint = r"\s*(?:,|\s+и\s+)\s*(?=[\s\S])"
    parts = F.split(c, r"(?U)\s*[;\n•·▪●]\s*")
    parts = F.flatten(F.transform(parts, lambda p: F.split(p, r"(?U)(?:^|\s)\d{1,2}[.)]\s+(?=[^\W\d_])")))
    dashed = F.flatten(F.transform(parts, lambda p: F.split(p, r"(?U)(?:^|\s)[-–—*]\s+(?=\w)")))
    parts = F.when(c.rlike(r"(?U)^\s*[-–—*]\s"), dashed).otherwise(parts)
    marked = F.transform(parts, lambda p: F.regexp_replace(p, f"({QUANTITY}){joint}", "$1\u0001"))
    return F.filter(F.transform(F.flatten(F.transform(marked, lambda p: F.split(p, "\u0001"))), lambda p: F.trim(p)), lambda p: p != "")


def interpret(c: Column, most: int = 20) -> Column:
    """Request items: array of struct(name, okpd2, quantity); terms of delivery are no items; the whole text if none is."""

    def item(p: Column) -> Column:
        rest = F.regexp_replace(without_okpd2(p), QUANTITY, " ")
        name = F.regexp_replace(collapse(rest), f"^{EDGES}|{EDGES}$", "")
        return F.struct(F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 4000)).alias("name"), okpd2(p).alias("okpd2"), quantity(p).alias("quantity"))

    goods = F.filter(positions(c), lambda p: ~F.lower(F.trim(p)).rlike("^(?:" + "|".join(SERVICE_PREFIXES) + ")"))
    named = lambda items: F.filter(items, lambda i: F.size(words(i["name"])) > 0)
    items = named(F.transform(goods, item))
    return F.slice(F.when(F.size(items) > 0, items).otherwise(named(F.array(item(c)))), 1, most)


def mask_secrets(c: Column, longest: int = 240) -> Column:
    """Logins, named secrets, query strings and addresses hidden; cut with an ellipsis."""
    c = F.regexp_replace(c, r"(?iU)\b([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", "$1***@")
    c = F.regexp_replace(c, r"(?iU)\b(token|key|secret|password|passwd|proxy|authorization|cookie)\b\s*[=:]\s*\S+", "$1=***")
    c = F.regexp_replace(c, r"(?U)(https?://[^\s?#]+)\?\S+", "$1")
    c = collapse(F.regexp_replace(c, r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "***"))
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(longest - 1))), F.lit("…")))


def _check_digit(digits: Column, weights: Sequence[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + F.substring(digits, i, 1).try_cast("int") * w
    return total % 11 % 10


def is_inn(c: Column) -> Column:
    """Ten or twelve digits, not all the same, with right check digits."""
    digit = lambda i: F.substring(c, i, 1).try_cast("int")
    ten = c.rlike("^[0-9]{10}$") & (_check_digit(c, INN_10) == digit(10))
    twelve = c.rlike("^[0-9]{12}$") & (_check_digit(c, INN_11) == digit(11)) & (_check_digit(c, INN_12) == digit(12))
    return F.coalesce((ten | twelve) & ~c.rlike(r"^(.)\1*$"), F.lit(False))


def inn(raw: Column) -> Column:
    """A valid tax number out of ``raw``, with a lost leading zero put back; else null."""
    digits = F.regexp_replace(raw, r"\D", "")
    padded = F.concat(F.lit("0"), digits)
    return F.when(F.length(digits).isin(9, 11) & is_inn(padded), padded).when(is_inn(digits), digits)


def labelled_inns(c: Column) -> Column:
    """Valid tax numbers that follow their label within ten characters."""
    found = F.regexp_extract_all(c, F.lit(r"(?iu)инн[^0-9]{0,10}([0-9]{12}|[0-9]{10})(?![0-9])"), F.lit(1))
    return F.array_distinct(F.filter(found, is_inn))


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags; the commonest entities read."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return collapse(c)


def links(html: Column) -> Column:
    """Distinct link targets in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref=[\"']([^\"']+)[\"']"), F.lit(1)))


def title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def json_ld(html: Column) -> Column:
    """The bodies of all ``application/ld+json`` blocks that parse."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: F.try_parse_json(b).isNotNull())


def csv_cell(c: Column) -> Column:
    """A cell for export: no formula starts it, and it is quoted where it must be."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[",;\\n\\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def is_web_url(c: Column) -> Column:
    """An http or https address with a host."""
    return F.coalesce(F.trim(c).rlike(r"(?i)^https?://[^/?#]"), F.lit(False))


def tolerant_date(c: Column) -> Column:
    """The ISO date that a text begins with, or a date written day.month.year; else null."""
    text = F.trim(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(text, F.lit(10)).try_cast("date"))
    return F.coalesce(iso, F.try_to_timestamp(F.when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), text), F.lit("d.M.yyyy")).cast("date"))
