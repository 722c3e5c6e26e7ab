"""Pieces of SQL for the oracle: the scalar functions once more, as DuckDB writes them.

RE2 has no lookaround: a word that no small letter touches is matched with its neighbours, which are
put back; replacing twice covers words that share a neighbour.
"""

from __future__ import annotations

import re

from groundstone.functions.identity import STOPWORDS
from groundstone.functions.quantity import ALPHA_CURRENCIES, CURRENCIES, MAX_WORDS, NUMBER, RATIOS, SCALES
from groundstone.functions.text import SPACE, SPACES, WORD  # noqa: F401


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    """Compatibility form of what the test tables hold, white space collapsed."""
    return f"trim(regexp_replace(replace({x}, '²', '2'), '{SPACES}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}|{SPACES}$', '', 'g')"


def bounded_test(x: str, words: list[str]) -> str:
    return f"regexp_matches({x}, '(^|[^a-z])({'|'.join(re.escape(w) for w in words)})([^a-z]|$)')"


def bounded_replace(x: str, words: list[str], by: str) -> str:
    pattern = f"(^|[^a-z])({'|'.join(re.escape(w) for w in sorted(words, key=len, reverse=True))})([^a-z]|$)"
    once = f"regexp_replace({x}, '{pattern}', '\\1{by}\\3', 'g')"
    return f"regexp_replace({once}, '{pattern}', '\\1{by}\\3', 'g')"


def slug(cleaned: str) -> str:
    stop = ", ".join(quoted(w) for w in STOPWORDS)
    return f"array_to_string(list_filter(string_split(regexp_replace(lower({cleaned}), '[^a-z0-9%]+', ' ', 'g'), ' '), lambda w: w <> '' and w not in ({stop})), '_')"


def canonical_key(subject: str, attribute: str) -> str:
    return " || '::' || ".join(slug(f"coalesce(nullif({x}, ''), 'unknown')") for x in (subject, attribute))


def number(cleaned: str) -> str:
    inner = f"nullif(regexp_extract({cleaned}, '^\\(\\s*(.+?)\\s*\\)$', 1), '')"
    text = f"coalesce({inner}, {cleaned})"
    value = f"cast(nullif(regexp_replace(regexp_extract({text}, '{NUMBER}', 2), '[,\\s]', '', 'g'), '') as double)"
    return f"case when {inner} is not null or regexp_extract({text}, '{NUMBER}', 1) in ('-', '−') then -{value} else {value} end"


def scale(low: str) -> str:
    cases = " ".join(f"when {bounded_test(low, [w for w, x in SCALES.items() if x == v])} then {v!r}" for v in sorted(set(SCALES.values()), reverse=True))
    return f"(case {cases} else 1.0 end)::double"


def currency(low: str) -> str:
    out = []
    for code, symbols, words in CURRENCIES:
        tests = [f"contains({low}, '{s}')" for s in symbols] + [bounded_test(low, words)]
        out.append(f"when {' or '.join(tests)} then '{code}'")
    return f"case {' '.join(out)} end"


def ratio(low: str) -> str:
    cases = " ".join(f"when {bounded_test(low, [t])} then '{RATIOS[t]}'" for t in sorted(RATIOS, key=len, reverse=True) if t != "%")
    return f"case when contains({low}, '%') then '%' {cases} end"


def leftover_words(low: str) -> str:
    text = f"regexp_replace({low}, '{NUMBER}', ' ', 'g')"
    text = bounded_replace(text, list(SCALES), " ")
    text = bounded_replace(text, ALPHA_CURRENCIES, " ")
    text = f"regexp_replace({text}, '₹|rs\\.|[$€£¥]', ' ', 'g')"
    for t in RATIOS:
        text = f"replace({text}, '{t}', ' ')"
    return f"len(regexp_extract_all({text}, '[a-z]{{2,}}'))"


def code(x: str) -> str:
    return f"len(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9-]+'), lambda t: trim(t, '-')), lambda t: length(t) >= 4 and regexp_matches(t, '[A-Za-z]') and regexp_matches(t, '[0-9]'))) > 0"


def normalised(source: str, columns: str, value: str = "value", unit: str = "unit") -> str:
    """A chain of CTEs over ``source`` that ends in ``normed`` with norm_value and norm_unit."""
    rest = bounded_replace("ul", list(SCALES), "")
    rest = f"nullif(regexp_replace(trim(regexp_replace({rest}, '{SPACES}', ' ', 'g')), '^[ .,]+|[ .,]+$', '', 'g'), '')"
    return f"""
 n1 as (select {columns}, coalesce({clean(value)}, '') v, coalesce({clean(unit)}, '') u from {source}),
 n2 as (select *, lower(v) vl, lower(u) ul from n1),
 n3 as (select *, v <> '' and ({code('v')} or {leftover_words('vl')} > {MAX_WORDS}) prose, coalesce({number('v')}, {number('u')}) n,
        coalesce({ratio('vl')}, {ratio('ul')}) r, coalesce({currency('vl')}, {currency('ul')}) c, greatest({scale('vl')}, {scale('ul')}) s from n2),
 normed as (select *, case when prose then null when r is not null then n else n * s end norm_value,
        case when prose then nullif(u, '') when r is not null then r when n is null then coalesce(c, nullif(u, '')) else coalesce(c, {rest}) end norm_unit from n3)"""


def period(raw: str) -> str:
    """Canonical period as a nested expression over the squeezed text."""
    t = f"replace(replace(replace(regexp_replace(lower(coalesce({raw}, '')), '{SPACES}', '', 'g'), '.', ''), 'financialyear', 'fy'), 'fiscalyear', 'fy')"
    part = f"regexp_extract({t}, '^(q[1-4]|h[12])', 1)"
    rest = f"(case when {part} = '' then {t} else regexp_replace({t}, '^(?:q[1-4]|h[12])[-/]?', '') end)"
    prefix = f"(case when {part} = '' then '' else {part} || '-' end)"
    fiscal = f"({part} <> '' or starts_with({rest}, 'fy'))"
    year = f"regexp_replace({rest}, '^fy', '')"
    both = f"regexp_extract({year}, '^([0-9]{{2,4}})[-/]([0-9]{{2,4}})$', %d)"
    a, b = both % 1, both % 2
    full = lambda x: f"(case when cast({x} as int) < 100 then cast({x} as int) + 2000 else cast({x} as int) end)"
    a4 = full(f"nullif({a}, '')")
    b4 = f"cast(nullif({b}, '') as int)"
    short = f"({a4} // 100 * 100 + {b4})"
    end = f"(case when length({b}) > 2 then {b4} when {short} <= {a4} then {short} + 100 else {short} end)"
    bare = f"nullif(regexp_extract({year}, '^([0-9]{{2,4}})$', 1), '')"
    return f"""case when {t} = '' then '' when {b} <> '' then {prefix} || 'fy' || {end} when {bare} is not null and {fiscal} then {prefix} || 'fy' || {full(bare)}
 when {bare} is not null then 'cy' || {full(bare)} else {prefix} || {year} end"""


def field(key: str, payload: str = "payload_json") -> str:
    raw = f"({payload} ->> '$.{key}')"
    return f"(case when {raw} in ('true', 'false') and json_type({payload}, '$.{key}') = 'BOOLEAN' then upper(substr({raw}, 1, 1)) || substr({raw}, 2) else {raw} end)"


def attribute(payload: str = "payload_json") -> str:
    return f"coalesce(nullif({field('attribute', payload)}, ''), {field('predicate', payload)})"


#: Facts, each once.
FACTS = "facts1 as (select distinct * from facts)"


def once(name: str) -> str:
    return f"(select distinct * from {name})"
