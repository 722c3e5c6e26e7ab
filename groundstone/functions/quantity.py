"""Magnitudes with their unit: numbers, scale words, currencies, ratios.

``normalised`` works in stages, so that every pattern runs once a row: DataFrame in, columns added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundstone.functions.text import bounded, clean, collapse

# Scale words, currencies in the order of precedence, ratio units.
SCALES = {"hundred": 1e2, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "mn": 1e6, "mm": 1e6, "m": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "tr": 1e12}
CURRENCIES = [("INR", ["₹"], ["rs", "rs.", "inr", "rupee", "rupees"]), ("USD", ["$"], ["us$", "usd", "dollar", "dollars"]), ("EUR", ["€"], ["eur", "euro", "euros"]), ("GBP", ["£"], ["gbp", "pound", "pounds"]), ("JPY", ["¥"], ["jpy"])]
RATIOS = {"%": "%", "percent": "%", "per cent": "%", "pct": "%", "percentage": "%", "percentage point": "pp", "percentage points": "pp", "pp": "pp", "bps": "bps", "basis point": "bps", "basis points": "bps", "x": "x", "times": "x"}

#: Fixed value: a number with or without groups of digits; its sign is group 1, its digits group 2.
NUMBER = r"([-+−]?)\s*([0-9]{1,3}(?:[,\s][0-9]{2,3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
#: A token of four or more that mixes letters and digits is a code, not a measurement.
CODE = r"(?<![\p{L}\p{N}_])(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9][A-Za-z0-9-]{2,}[A-Za-z0-9](?![\p{L}\p{N}_])"
MAX_WORDS = 2

ALPHA_CURRENCIES = [w for _, _, ws in CURRENCIES for w in ws if w.isalpha()]


def number(cleaned: Column) -> Column:
    """The first number of a cleaned text; brackets around the whole make it negative."""
    inner = F.nullif(F.regexp_extract(cleaned, r"^\(\s*(.+?)\s*\)$", 1), F.lit(""))
    text = F.coalesce(inner, cleaned)
    digits = F.regexp_replace(F.regexp_extract(text, NUMBER, 2), r"[,\s]", "")
    value = F.nullif(digits, F.lit("")).cast("double")
    return F.when(inner.isNotNull() | F.regexp_extract(text, NUMBER, 1).isin("-", "−"), -value).otherwise(value)


def scale(lowered: Column) -> Column:
    """The largest multiplier among the scale words, 1 without any."""
    by = sorted({v for v in SCALES.values()}, reverse=True)
    out = None
    for v in by:
        test = lowered.rlike(bounded([w for w, x in SCALES.items() if x == v]))
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(1.0)


def currency(lowered: Column) -> Column:
    out = None
    for code, symbols, words in CURRENCIES:
        test = lowered.rlike(bounded(words))
        for s in symbols:
            test = F.contains(lowered, F.lit(s)) | test
        out = F.when(test, code) if out is None else out.when(test, code)
    return out


def ratio(lowered: Column) -> Column:
    out = F.when(F.contains(lowered, F.lit("%")), "%")
    for token in sorted(RATIOS, key=len, reverse=True):
        if token != "%":
            out = out.when(lowered.rlike(bounded([token])), RATIOS[token])
    return out


def leftover_words(lowered: Column) -> Column:
    """How many words of two letters or more are neither number, scale, currency nor ratio."""
    text = F.regexp_replace(lowered, NUMBER, " ")
    text = F.regexp_replace(text, bounded(sorted(SCALES, key=len, reverse=True)), " ")
    text = F.regexp_replace(text, bounded(sorted(ALPHA_CURRENCIES, key=len, reverse=True)), " ")
    text = F.regexp_replace(text, r"₹|rs\.|[$€£¥]", " ")
    for token in RATIOS:
        text = F.replace(text, F.lit(token), F.lit(" "))
    return F.regexp_count(text, F.lit("[a-z]{2,}"))


def normalised(df: DataFrame, value: str, unit: str, number_out: str = "norm_value", unit_out: str = "norm_unit") -> DataFrame:
    """Add the magnitude and canonical unit of a value and a unit given as text.

    Values that are codes or prose have no magnitude.  A ratio unit wins over scale words; then comes
    a currency, then the unit's own words without scale words.
    """
    d = df.withColumns({"_norm_v": F.coalesce(clean(value), F.lit("")), "_norm_u": F.coalesce(clean(unit), F.lit(""))})
    d = d.withColumns({"_norm_vl": F.lower("_norm_v"), "_norm_ul": F.lower("_norm_u")})
    d = d.withColumns({
        "_norm_prose": (F.col("_norm_v") != "") & (F.col("_norm_v").rlike(CODE) | (leftover_words(F.col("_norm_vl")) > MAX_WORDS)),
        "_norm_n": F.coalesce(number(F.col("_norm_v")), number(F.col("_norm_u"))),
        "_norm_r": F.coalesce(ratio(F.col("_norm_vl")), ratio(F.col("_norm_ul"))),
        "_norm_c": F.coalesce(currency(F.col("_norm_vl")), currency(F.col("_norm_ul"))),
        "_norm_s": F.greatest(scale(F.col("_norm_vl")), scale(F.col("_norm_ul"))),
    })
    u = F.nullif(F.col("_norm_u"), F.lit(""))
    rest = collapse(F.regexp_replace(F.col("_norm_ul"), bounded(sorted(SCALES, key=len, reverse=True)), ""))
    rest = F.nullif(F.regexp_replace(rest, "^[ .,]+|[ .,]+$", ""), F.lit(""))
    prose, r, c, n = (F.col(x) for x in ("_norm_prose", "_norm_r", "_norm_c", "_norm_n"))
    d = d.withColumns({
        number_out: F.when(prose, None).when(r.isNotNull(), n).otherwise(n * F.col("_norm_s")),
        unit_out: F.when(prose, u).when(r.isNotNull(), r).when(n.isNull(), F.coalesce(c, u)).otherwise(F.coalesce(c, rest)),
    })
    return d.drop("_norm_v", "_norm_u", "_norm_vl", "_norm_ul", "_norm_prose", "_norm_n", "_norm_r", "_norm_c", "_norm_s")


def agree(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """True, false, or null where either side is missing."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, True).otherwise(F.abs(a - b) / F.nullif(most, F.lit(0.0)) <= tolerance)


def general(x: Column) -> Column:
    """A number with six significant digits, as C's ``%g`` writes it."""
    e = F.format_string("%.5e", x)
    exponent = F.regexp_extract(e, "e([+-][0-9]+)$", 1).cast("int")
    sign, digits = F.when(x < 0, "-").otherwise(""), F.regexp_replace(F.regexp_extract(e, "^-?([0-9.]+)e", 1), "[.]", "")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "([.][0-9]*?)0+$", "$1"), "[.]$", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    plain = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(6)))
    far = F.concat(bare(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.regexp_extract(e, "(e[+-][0-9]+)$", 1))
    return F.when(x.isNull(), None).when(x == 0, "0").otherwise(F.concat(sign, F.when((exponent < -4) | (exponent > 5), far).when(exponent < 0, bare(small)).otherwise(bare(plain))))
