"""Reading one fact: whose attribute it states, for which period, and what value in which type.

The halves of the canonical key and the canonical period follow the engine's identity functions
(``functions/identity.py`` has them as columns); here they run inside the Arrow batches that open
the payload anyway, with a cache, since keys and periods repeat far more than facts do.
"""

from __future__ import annotations

import datetime
import json
import re
import unicodedata
from functools import lru_cache

from groundstone.functions.identity import FISCAL_WORDS, PERIOD, STOPWORDS

# What is written where no value is known.
PLACEHOLDERS = frozenset(
    ["", "na", "n/a", "n.a", "n.a.", "nm", "n.m.", "nil", "none", "null", "nan", "tbd", "tba", "tbc", "withheld", "not disclosed", "not available", "not applicable",
     "not reported", "not stated", "not given", "not known", "unknown", "undisclosed", "pending", "left blank", "blank", "missing", "confidential", "redacted",
     "#ref!", "#n/a", "#value!", "#div/0!", "#name?", "#null!", "#num!", "..", "...", "-", "--", "—", "–", "?", "??", "*", "xx", "x"]
)

_POINTER = re.compile(r"(?:please )?(?:see|refer(?: to)?|cf\.?|as per|per|vide|in)?\s*(?:the )?(?:foot)?(?:note|notes|annex|annexure|appendix|schedule|exhibit|table|page|section)\s*(?:no\.?\s*)?[\d.()a-z]{0,5}", re.I)
_WRAP = {"(": ")", "[": "]", "{": "}", '"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
_SPACES = re.compile(r"\s+")

# Words before an approximate figure.
_ABOUT = r"(?:about|approximately|approx\.?|around|circa|roughly|nearly|almost|over|under|more than|less than|at least|up to|some|ca\.?|c\.|~|≈|<|>|±)"
_CURRENCY = r"(?:us\s?\$|us\s?dollars?|usd|inr|eur|gbp|jpy|rs\.?|rupees?|₹|\$|€|£|¥)"
NUMBER = r"\d{1,3}(?:[.\s]\d{3})+,\d+(?![\d.,])|\d{1,3}(?:\.\d{3}){2,}(?![\d.])|\d{1,3}(?:[,\s]\d{2,3})+(?![\d,])(?:\.\d+)?|\d+(?:,\d+)*(?:\.\d+)?|\.\d+"
#: What ends the words that belong to a number.
_CLAUSE_END = re.compile(r"\s*(?:;|[.!?]\s+(?=[A-Z])|\n\s*\n)")
_QUANTITY = re.compile(rf"^\s*(?:{_ABOUT}\s*)*(?P<cur>{_CURRENCY})?\s*(?P<sign>[-−+]?)\s*(?P<cur2>{_CURRENCY})?\s*(?P<num>{NUMBER})(?P<rest>.*)$", re.I | re.S)

# The months.
MONTHS = {m[:3]: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
_YMD = re.compile(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})")
_DMY = re.compile(r"(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4}|\d{2})")
_DMONY = re.compile(r"(\d{1,2})(?:st|nd|rd|th)?[-/. ,;]*([a-z]{3,9})\.?[-/. ,;]*(\d{4}|\d{2})", re.I)
_MONDY = re.compile(r"([a-z]{3,9})\.?[-/. ]*(\d{1,2})(?:st|nd|rd|th)?[-/. ,;]+(\d{4}|\d{2})", re.I)

# Spellings of yes and no.
_YES, _NO = frozenset("true yes y t".split()), frozenset("false no n f".split())


def clean(text: object) -> str:
    """Compatibility-normalised, white space collapsed, ends stripped."""
    text = str(text)
    return _SPACES.sub(" ", text if text.isascii() else unicodedata.normalize("NFKC", text)).strip()


@lru_cache(100_000)
def slug(text: str) -> str:
    """Lower case, other than letters, digits and % to spaces, stopwords dropped, joined by ``_``."""
    words = re.sub(r"[^a-z0-9\s%]", " ", clean(text).lower()).split()
    return "_".join(w for w in words if w not in STOPWORDS)


@lru_cache(100_000)
def period(raw: str | None) -> str:
    """Canonical period: ``fy2025``, ``cy2024``, ``q4-fy2024``; '' where there is none."""
    if not raw or bare(raw).lower() in PLACEHOLDERS:
        return ""
    t = re.sub("|".join(FISCAL_WORDS), "fy", re.sub(r"[\s.]", "", bare(raw).lower()))
    part, fiscal, first, last, other = re.match(PERIOD, t).groups(default="")
    if first:
        year = int(first) + 2000 * (int(first) < 100)
        if last:
            end = int(last) if len(last) > 2 else year - year % 100 + int(last)
            year = end if len(last) > 2 or end > year else end + 100
        other = f"{'fy' if part or fiscal or last else 'cy'}{year}"
    return f"{part}-{other}" if part else other


def bare(text: str) -> str:
    """Without quotes or brackets around the whole and without punctuation at its end."""
    text = clean(text)
    while True:
        start = text
        text = text.rstrip(" ;,")
        if text.endswith(" .") or text.endswith(".") and text[:-1].rstrip(" .").isalnum() and len(text) > 4:
            text = text[:-1].rstrip()
        if len(text) > 1 and _WRAP.get(text[0]) == text[-1] and text[-1] not in text[1:-1] and text[0] not in text[1:-1]:
            text = text[1:-1].strip()
        if text == start:
            return text


@lru_cache(100_000)
def attribute_parts(text: str) -> tuple[str, str]:
    """An attribute's name without a unit in brackets after it, and that unit's text ('' if none)."""
    text = bare(text)
    m = re.fullmatch(r"([^(\[]*\w[^(\[]*)[(\[]\s*(?:in )?(.*?)[)\]]?\s*[.;,]?", text, re.I | re.S)
    return (m[1].strip(), m[2].strip()) if m else (text, "")


def opened(payload: str | None) -> dict:
    """The payload's fields by key without case and punctuation; {} if it isn't a JSON object.

    Of two keys that become one, the first that isn't null counts.
    """
    try:
        found = json.loads(payload) if payload else None
    except ValueError:
        return {}
    out: dict = {}
    if isinstance(found, dict):
        for k, v in found.items():
            k = field_name(k)
            if out.get(k) is None:
                out[k] = v
    return out


@lru_cache(10_000)
def field_name(key: str) -> str:
    return re.sub(r"[\W_]+", "", key.lower())


@lru_cache(100_000)
def key_halves(key: str) -> tuple[str, str] | None:
    """Entity and attribute of a canonical key however it is spelt."""
    head, mid, tail = key.partition("::")
    if not mid:
        return None
    a, b = slug(head.replace("_", " ")), slug(tail.replace("_", " "))
    return (a, b) if a and b else None


def identity(key: str | None, scope: str | None, d: dict) -> tuple[str, str, str]:
    """Entity, attribute and period, from the columns or else the payload."""
    halves = key_halves(key) if key else None
    if halves is None:
        name = d.get("attribute")
        name = name if name is not None and str(name).strip() else d.get("predicate")
        halves = slug(bare(str(d.get("subject") or "unknown"))) or "unknown", slug(attribute_parts(str(name or "unknown"))[0]) or "unknown"
    p = period(scope) if scope else ""
    if not p:
        for k in ("timescope", "period"):
            if not p and d.get(k) is not None:
                p = period(str(d[k]))
    return (*halves, p)


def is_placeholder(text: str) -> bool:
    low = bare(text).lower()
    return low in PLACEHOLDERS or low.rstrip(". ") in PLACEHOLDERS or bool(_POINTER.fullmatch(low))


def number_of(printed: str) -> float:
    """The number that printed digits state.

    Groups may be parted by commas, spaces or, before a decimal comma, points.  A single comma is a
    decimal comma where no group of three digits follows it, or only a zero stands before it.
    """
    t = re.sub(r"\s", "", printed)
    comma, point = t.rfind(","), t.rfind(".")
    if t.count(".") > 1 or 0 <= point < comma:
        t = t.replace(".", "").replace(",", ".")
    elif point < 0 and t.count(",") == 1 and (len(t) - comma != 4 or t.startswith("0,")):
        t = t.replace(",", ".")
    return float(t.replace(",", ""))


def quantity(value: object) -> tuple[float, str, str] | None:
    """Number, printed digits and the text around it that may hold a unit; None if it is no quantity.

    The text is the rest of the number's clause, however long.
    """
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value), str(value), ""
    text = bare(str(value))
    if is_placeholder(text) or not (m := _QUANTITY.match(text)):
        return None
    rest = _CLAUSE_END.split(m["rest"].strip(), maxsplit=1)[0]
    if rest and rest[0].isalnum() and m["rest"][0] == rest[0] and len(rest) > 1 and any(c.isdigit() for c in rest[1:].split(" ", 1)[0]):
        return None  # a code such as 24A-77
    number = number_of(m["num"])
    return -number if m["sign"] in ("-", "−") and m["sign"] else number, m["num"], " ".join(x for x in (m["cur"] or m["cur2"] or "", rest) if x)


def real_date(value: object) -> datetime.date | None:
    """A calendar date, day before month unless the year comes first."""
    if not isinstance(value, str):
        return None
    text = bare(value)
    if m := _YMD.fullmatch(text):
        y, mo, d = m.groups()
    elif m := _DMY.fullmatch(text):
        d, mo, y = m.groups()
    elif m := _DMONY.fullmatch(text):
        d, mo, y = m[1], MONTHS.get(m[2][:3].lower(), 0), m[3]
    elif m := _MONDY.fullmatch(text):
        d, mo, y = m[2], MONTHS.get(m[1][:3].lower(), 0), m[3]
    else:
        return None
    y = int(y)
    try:
        return datetime.date(y + (2000 if y < 50 else 1900) * (y < 100), int(mo), int(d))
    except ValueError:
        return None


def yes_no(value: object) -> bool | None:
    if isinstance(value, bool):
        return value
    low = bare(value).lower().rstrip(".") if isinstance(value, str) else ""
    return True if low in _YES else False if low in _NO else None


def typed(value: object, kind: str) -> object:
    """``value`` as the catalog's type, None if it states none of that type."""
    if kind in ("double", "bigint"):
        q = quantity(value)
        if q is None:
            return None
        return q[0] if kind == "double" else int(q[0]) if q[0] == int(q[0]) and abs(q[0]) < 2**63 else None
    if kind == "date":
        return real_date(value)
    if kind == "boolean":
        return yes_no(value)
    if value is None or isinstance(value, (dict, list)):
        return None
    text = clean(value if isinstance(value, str) else json.dumps(value))
    return None if is_placeholder(text) else bare(text)
