"""The stemmers in SQL: positions of the regions, and cases over endings from the longest down."""

from __future__ import annotations

from tenderloom.functions import stemming as s


def _longest(endings):
    return sorted(endings, key=len, reverse=True)


def _case(parts, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in parts) + f" ELSE {otherwise} END"


def _ru_cut(after: list[str], own: list[str]) -> str:
    """How many characters of ``x`` the longest ending that lies behind ``rv`` takes; null if none does, or the letter before it is wrong."""
    parts = []
    for e in _longest({*after, *own}):
        n, fits = len(e), f"ends_with(x, '{e}') AND length(x) - {len(e)} >= rv"
        before = f"CASE WHEN length(x) - {n + 1} >= rv AND substr(x, length(x) - {n}, 1) IN ('а', 'я') THEN {n} END"
        parts.append((fits, before if e in after else str(n)))
    return _case(parts, "NULL")


def _russian() -> str:
    v = s.RU_VOWELS
    return f"""
r0 AS (SELECT w, w AS x, coalesce(nullif(length(regexp_extract(w, '^[^{v}]*[{v}]')), 0), 1000) AS rv, coalesce(nullif(length(regexp_extract(w, '^[^{v}]*[{v}]+[^{v}][^{v}]*[{v}]+[^{v}]')), 0), 1000) AS r2 FROM wd WHERE regexp_matches(w, '[а-я]')),
r1 AS (SELECT *, {_ru_cut(*s.GERUND)} AS g FROM r0),
r2 AS (SELECT w, rv, r2, g, CASE WHEN g IS NOT NULL THEN left(x, length(x) - g) WHEN length(x) - 2 >= rv AND right(x, 2) IN ('ся', 'сь') THEN left(x, length(x) - 2) ELSE x END AS x FROM r1),
r3 AS (SELECT *, CASE WHEN g IS NULL THEN {_ru_cut([], s.ADJECTIVE)} END AS a FROM r2),
r4 AS (SELECT w, rv, r2, coalesce(g, a) AS done, a, CASE WHEN a IS NOT NULL THEN left(x, length(x) - a) ELSE x END AS x FROM r3),
r5 AS (SELECT *, CASE WHEN a IS NOT NULL THEN {_ru_cut(*s.PARTICIPLE)} WHEN done IS NULL THEN {_ru_cut(*s.VERB)} END AS p FROM r4),
r6 AS (SELECT w, rv, r2, coalesce(done, p) AS done, left(x, length(x) - coalesce(p, 0)) AS x FROM r5),
r7 AS (SELECT w, rv, r2, left(x, length(x) - coalesce(CASE WHEN done IS NULL THEN {_ru_cut([], s.NOUN)} END, 0)) AS x FROM r6),
r8 AS (SELECT w, rv, r2, CASE WHEN ends_with(x, 'и') AND length(x) - 1 >= rv THEN left(x, length(x) - 1) ELSE x END AS x FROM r7),
r9 AS (SELECT w, rv, CASE WHEN ends_with(x, 'ость') AND length(x) - 4 >= r2 THEN left(x, length(x) - 4) WHEN ends_with(x, 'ост') AND length(x) - 3 >= r2 THEN left(x, length(x) - 3) ELSE x END AS x FROM r8),
ra AS (SELECT w, rv, CASE WHEN ends_with(x, 'ейше') AND length(x) - 4 >= rv THEN left(x, length(x) - 4) WHEN ends_with(x, 'ейш') AND length(x) - 3 >= rv THEN left(x, length(x) - 3) ELSE x END AS y, x FROM r9),
rz AS (SELECT w, CASE WHEN ends_with(y, 'нн') AND length(y) - 2 >= rv THEN left(y, length(y) - 1) WHEN y = x AND ends_with(x, 'ь') AND length(x) - 1 >= rv THEN left(x, length(x) - 1) ELSE y END AS stem FROM ra)"""


def _en_table(table: dict[str, str], region: dict[str, str]) -> str:
    parts = []
    for e in _longest(table):
        holds = f"length(x) - {len(e)} >= {region.get(e, region[''])}"
        if e in s.EN_AFTER:
            holds += f" AND contains('{s.EN_AFTER[e]}', substr(x, length(x) - {len(e)}, 1)) AND length(x) > {len(e)}"
        parts.append((f"ends_with(x, '{e}')", f"CASE WHEN {holds} THEN left(x, length(x) - {len(e)}) || '{table[e]}' ELSE x END"))
    return _case(parts, "x")


def _english() -> str:
    v = s.EN_VOWELS
    fixed = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in s.EN_WORDS.items()) + ")"
    kept = ", ".join(f"'{k}'" for k in s.EN_KEPT)
    start = _case([(f"starts_with(y, '{p}')", str(len(p))) for p in s.EN_PREFIXES], f"coalesce(nullif(length(regexp_extract(y, '^[^{v}]*[{v}]+[^{v}]')), 0), length(y))")
    vowel = f"regexp_matches(left(x, length(x) - {{}}), '[{v}]')"
    cuts = [(f"ends_with(x, '{e}')", f"CASE WHEN {vowel.format(len(e))} THEN {len(e)} END") for e in ("ingly", "edly", "ing", "ed")]
    short = f"regexp_matches(x, '(^[{v}][^{v}]|[^{v}][{v}][^{v}wxY])$')"
    step5 = f"regexp_matches(left(x, length(x) - 1), '(^[{v}][^{v}]|[^{v}][{v}][^{v}wxY])$')"
    return f"""
e0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([{v}])y', '\\1Y', 'g') AS y FROM wd WHERE regexp_matches(w, '[a-z]') AND NOT regexp_matches(w, '[а-я]') AND length(w) > 2 AND w NOT IN (SELECT column0 FROM {fixed} t(column0, column1))),
e1 AS (SELECT w, y AS x, {start} AS r1 FROM e0),
e2 AS (SELECT w, x, r1, r1 + coalesce(nullif(length(regexp_extract(substr(x, r1 + 1), '^[^{v}]*[{v}]+[^{v}]')), 0), length(x) - r1) AS r2 FROM e1),
e3 AS (SELECT w, r1, r2, CASE WHEN ends_with(x, 'sses') THEN left(x, length(x) - 2) WHEN right(x, 3) IN ('ied', 'ies') THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
  WHEN right(x, 2) IN ('us', 'ss') THEN x WHEN ends_with(x, 's') AND regexp_matches(left(x, length(x) - 2), '[{v}]') THEN left(x, length(x) - 1) ELSE x END AS x FROM e2),
e4 AS (SELECT *, x IN ({kept}) AS kept, CASE WHEN ends_with(x, 'eed') OR ends_with(x, 'eedly') THEN NULL {' '.join(f'WHEN {a} THEN {b}' for a, b in cuts)} END AS n FROM e3),
e5 AS (SELECT w, r1, r2, kept, NOT kept AND n IS NOT NULL AS cut, CASE WHEN kept THEN x WHEN ends_with(x, 'eedly') AND length(x) - 5 >= r1 THEN left(x, length(x) - 3) WHEN ends_with(x, 'eed') AND length(x) - 3 >= r1 THEN left(x, length(x) - 1)
  ELSE left(x, length(x) - coalesce(n, 0)) END AS x FROM e4),
e6 AS (SELECT w, r1, r2, kept, CASE WHEN NOT cut THEN x WHEN right(x, 2) IN ('at', 'bl', 'iz') THEN x || 'e' WHEN right(x, 1) = substr(x, length(x) - 1, 1) AND length(x) > 1 AND contains('{s.EN_DOUBLES}', right(x, 1)) THEN left(x, length(x) - 1)
  WHEN length(x) <= r1 AND {short} THEN x || 'e' ELSE x END AS x FROM e5),
e7 AS (SELECT w, r1, r2, kept, CASE WHEN NOT kept AND length(x) > 2 AND right(x, 1) IN ('y', 'Y') AND NOT contains('{v}', substr(x, length(x) - 1, 1)) THEN left(x, length(x) - 1) || 'i' ELSE x END AS x FROM e6),
e8 AS (SELECT w, r1, r2, kept, CASE WHEN kept THEN x ELSE {_en_table(s.EN_STEP2, {'': 'r1'})} END AS x FROM e7),
e9 AS (SELECT w, r1, r2, kept, CASE WHEN kept THEN x ELSE {_en_table(s.EN_STEP3, {'': 'r1', 'ative': 'r2'})} END AS x FROM e8),
ea AS (SELECT w, r1, r2, kept, CASE WHEN kept THEN x ELSE {_en_table(dict.fromkeys(s.EN_STEP4, ''), {'': 'r2'})} END AS x FROM e9),
eb AS (SELECT w, CASE WHEN kept THEN x WHEN ends_with(x, 'll') AND length(x) - 1 >= r2 THEN left(x, length(x) - 1)
  WHEN ends_with(x, 'e') AND (length(x) - 1 >= r2 OR length(x) - 1 >= r1 AND NOT {step5}) THEN left(x, length(x) - 1) ELSE x END AS x FROM ea),
ez AS (SELECT w, lower(x) AS stem FROM eb UNION ALL SELECT wd.w, t.column1 FROM wd JOIN {fixed} t(column0, column1) ON wd.w = t.column0)"""


def stems(words: str, out: str = "st") -> str:
    """CTEs that end in ``out``(w, stem), the stems of the distinct words of the relation ``words``(w); r0 to rz, e0 to ez and wd are taken."""
    return (
        f"wd AS (SELECT DISTINCT w FROM {words} WHERE w <> ''),{_russian()},{_english()},\n"
        f"{out} AS (SELECT wd.w, coalesce(rz.stem, ez.stem, wd.w) AS stem FROM wd LEFT JOIN rz ON rz.w = wd.w LEFT JOIN ez ON ez.w = wd.w)"
    )
