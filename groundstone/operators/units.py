"""Quantities stated in different units, brought to the base unit of their dimension."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundstone.operators.factcells import attribute_parts, bare, clean, identity, opened, quantity
from groundstone.operators.skew import weighed_keys, salted_join

#: The unit table is broadcast; a table of more units than this is refused.
MAX_UNITS = 10_000

# Spellings of scale words and of the currencies of the unit table.
SCALE_WORDS = {
    "thousand": ["thousand", "thousands", "thousands of", "'000", "'000s", "000s", "000", "k"], "lakh": ["lakh", "lakhs", "lakhs of", "lac", "lacs"], "million": ["million", "millions", "millions of", "mn", "mio", "mm", "m"],
    "crore": ["crore", "crores", "crores of", "cr", "crs"], "billion": ["billion", "billions", "billions of", "bn", "b"],
}
CURRENCY_WORDS = {"INR": ["₹", "rs", "inr", "re", "rupee", "rupees", "indian rupees"], "USD": ["$", "us$", "us $", "usd", "dollar", "dollars", "us dollars", "us dollar"]}

# Spellings of the other units of the unit table, in the form that ``plain`` gives.
UNIT_WORDS = {
    "kilogram": "kg,kgs,kilogram,kilograms,kilogramme,kilogrammes,kilo,kilos",
    "quintal": "quintal,quintals,qtl,qtls",
    "tonne": "t,te,mt,tonne,tonnes,metric ton,metric tons,metric tonne,metric tonnes",
    "short ton": "short ton,short tons,us ton,us tons",
    "long ton": "long ton,long tons,imperial ton,imperial tons,uk ton,uk tons",
    "pound": "lb,lbs,pound,pounds,pound weight,pounds weight",
    "kilowatt hour": "kwh,kw h,kilowatt hour,kilowatt hours,units kwh,unit kwh",
    "megawatt hour": "mwh,mw h,megawatt hour,megawatt hours",
    "gigawatt hour": "gwh,gw h,gigawatt hour,gigawatt hours,million kwh,mn kwh,million units,million kilowatt hours",
    "gigajoule": "gj,gigajoule,gigajoules",
    "terajoule": "tj,terajoule,terajoules",
    "litre": "l,ltr,ltrs,litre,litres,liter,liters",
    "kilolitre": "kl,kilolitre,kilolitres,kiloliter,kiloliters,cubic metre,cubic metres,cubic meter,cubic meters,cu m,cum,m3",
    "million litre": "ml,mld,megalitre,megalitres,megaliter,megaliters",
    "US gallon": "us gallon,us gallons,us gal,gal us,gallon us,gallons us",
    "imperial gallon": "imperial gallon,imperial gallons,uk gallon,uk gallons,imp gal,gal imp,gal uk,uk gal",
    "barrel": "barrel,barrels,bbl,bbls",
    "metre": "m,metre,metres,meter,meters",
    "kilometre": "km,kms,kilometre,kilometres,kilometer,kilometers",
    "mile": "mi,mile,miles,statute mile,statute miles",
    "nautical mile": "nmi,nm,nautical mile,nautical miles",
    "square metre": "sq m,sqm,sq mt,sq mtr,m2,square metre,square metres,square meter,square meters",
    "square foot": "sq ft,sqft,sft,ft2,square foot,square feet",
    "hectare": "ha,hectare,hectares",
    "acre": "ac,acre,acres",
    "second": "s,sec,secs,second,seconds",
    "minute": "min,mins,minute,minutes",
    "hour": "h,hr,hrs,hour,hours",
    "day": "d,day,days",
    "week": "wk,wks,week,weeks",
    "kelvin": "k,kelvin,kelvins",
    "degree Celsius": "°c,deg c,degc,degree c,degrees c,degree celsius,degrees celsius,celsius",
    "degree Fahrenheit": "°f,deg f,degf,degree f,degrees f,degree fahrenheit,degrees fahrenheit,fahrenheit",
    "percent": "%,percent,per cent,pct,percentage",
    "basis point": "bps,bp,basis point,basis points",
}
#: Short forms with a scale inside, and the one that only its letter case tells apart.
SHORT_SCALED = {"million tonne": "mmt,megatonne,megatonnes", "thousand tonne": "kt,kilotonne,kilotonnes", "million square foot": "msf"}
CASED = {"Mt": "million tonne"}


#: Characters that ``plain`` makes a space of.
_PARTING = ".,;:()[]{}\"“”-–—_/'’‘`"


def plain(text: str) -> str:
    """Compatibility form, lower case, without dots, brackets, quotes and hyphens."""
    text = clean(text).lower().replace("’", "'").replace("‘", "'").replace("`", "'")
    text = re.sub(r"'(?!0)", " ", text)
    return re.sub(r"\s+", " ", re.sub(r"[.,;:()\[\]{}\"“”\-–—_/]", " ", text)).strip()


def aliases(units: list[str]) -> dict[str, list[str]]:
    """Every spelling (as ``plain`` gives it) to the units it can mean, for the units of the table."""
    have, out = set(units), {}

    def add(word: str, unit: str) -> None:
        if unit in have and unit not in out.setdefault(word, []):
            out[word].append(unit)

    for unit in units:
        add(plain(unit), unit)
    for unit, words in {**UNIT_WORDS, **SHORT_SCALED}.items():
        for w in words.split(","):
            add(w, unit)
            for scale, spelt in SCALE_WORDS.items():
                for s in spelt:
                    if len(s) > 1:
                        add(f"{s} {w}", f"{scale} {unit}")
    for code, words in CURRENCY_WORDS.items():
        for w in words:
            add(w, code)
            for scale, spelt in SCALE_WORDS.items():
                for s in spelt:
                    for form in (f"{w} {s}", f"{w}{s}" if not w[-1].isalpha() else "", f"{w} in {s}", f"{s} {w}"):
                        if form:
                            add(form, f"{code} {scale}")
    return {k: v for k, v in out.items() if v}


class UnitFinder:
    """A multi-pattern automaton over all spellings; the longest match beside a number wins."""

    def __init__(self, units: list[str]):
        import ahocorasick

        self.words = aliases(units)
        self.automaton = ahocorasick.Automaton()
        for w in self.words:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()
        self.units = set(units)
        #: Words of the longest spelling: so many beside a number are looked at.
        self.most = max((w.count(" ") + 1 for w in self.words), default=0)
        parting = rf"[\s{re.escape(_PARTING)}]"
        self.following = re.compile(rf"(?:{parting}*[^\s{re.escape(_PARTING)}]+){{0,{self.most}}}")
        self.of = lru_cache(200_000)(self._of)

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, spelling) at word boundaries; digits may touch a unit."""
        out = []
        if not len(self.automaton):
            return out
        for end, w in self.automaton.iter(text):
            start, end = end - len(w) + 1, end + 1
            if (start == 0 or not text[start - 1].isalpha() or not w[0].isalpha()) and (end == len(text) or not text[end].isalnum() or not w[-1].isalnum()):
                out.append((start, end, w))
        return out

    def _of(self, text: str) -> tuple[str, ...]:
        """Units that a text consisting of a unit can mean: () if it holds none.

        A number's currency may come before it and its scale after it ("US$ 5 mn"): ``quantity``
        hands both over, joined.  The longest spelling counts, the earliest of equally long ones.
        """
        stripped = bare(text)
        if stripped in CASED and CASED[stripped] in self.units:
            return (CASED[stripped],)
        found = self.matches(plain(text))
        if not found:
            return ()
        return tuple(self.words[max(found, key=lambda m: (m[1] - m[0], -m[0]))[2]])

    def preceding(self, text: str, end: int) -> str:
        """The words before a place, as many as the longest spelling has."""
        at, n, inside = end, 0, False
        while at > 0:
            apart = text[at - 1].isspace() or text[at - 1] in _PARTING
            if not apart and not inside:
                if n == self.most:
                    break
                n += 1
            inside = not apart
            at -= 1
        return text[at:end]

    def beside(self, printed: str, text: str) -> tuple[str, ...]:
        """Units next to the printed number in a longer text."""
        text = clean(text)
        for m in re.finditer(r"(?<![\d.,])" + re.escape(printed) + r"(?![\d]|[.,]\d)", text):
            tail = self.following.match(text, m.end())[0]
            word = re.match(r"\s*([A-Za-z]+)\b", tail)
            if word and word[1] in CASED and CASED[word[1]] in self.units:
                return (CASED[word[1]],)
            tail, head = plain(tail), plain(self.preceding(text, m.start()))
            after = [x for x in self.matches(tail) if x[0] == 0]
            before = [x for x in self.matches(head) if x[1] == len(head)]
            if after and before and plain(max(before)[2]) in {w for ws in CURRENCY_WORDS.values() for w in ws}:
                both = self._of(f"{max(before, key=lambda x: x[1] - x[0])[2]} {max(after, key=lambda x: x[1])[2]}")
                if both:
                    return both
            if after:
                return tuple(self.words[max(after, key=lambda x: x[1])[2]])
            if before:
                return tuple(self.words[max(before, key=lambda x: x[1] - x[0])[2]])
        return ()


# How a qualifier announces the unit of all figures.
_ANNOUNCED = re.compile(r"(?:all |the )?(?:amounts?|figures?|values?|numbers?)(?: are| stated| expressed| shown)? in (.+)|(.+?) unless (?:otherwise )?stated(?: otherwise)?|in (.+)", re.I | re.S)


def announced(qualifier: object) -> str:
    m = _ANNOUNCED.fullmatch(bare(str(qualifier))) if qualifier is not None else None
    return next((g for g in m.groups() if g), "") if m else ""


def _printed(number: float, printed: str, column: float | None) -> float:
    """The number as read, unless the column has the other reading of a single comma ("1,234")."""
    if column is not None and column == column and re.fullmatch(r"\d{1,3},\d{3}", printed) and abs(abs(column) - abs(number) / 1000) <= 1e-3 * abs(column):
        return number / 1000
    return number


def stated_units(facts: DataFrame, units: list[str], attributes: set[str] | None = None) -> DataFrame:
    """One row per fact with a number and a unit: id, entity, attribute, period, value, candidates.
    ``attributes``: of these only.

    The unit is looked for where it is most closely tied to the number: the value's own text, the
    payload's unit, the unit column, a bracket after the attribute's name, the qualifier that
    announces it for all figures, and last the wording of the quote and the canonical text.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = UnitFinder(units)
        for b in batches:
            out = []
            for i, key, scope, payload, num, unit, text in zip(b.id, b.canonical_key, b.time_scope, b.payload_json, b.value_num, b.unit, b.canonical_text):
                d = opened(payload)
                who = identity(key, scope, d)
                if attributes is not None and who[1] not in attributes:
                    continue
                q = quantity(d.get("value"))
                if q is None:
                    if d.get("value") is not None or num != num:
                        continue
                    q = float(num), f"{num:g}", ""
                q = _printed(q[0], q[1], num), *q[1:]
                found = finder.of(q[2]) if q[2] else ()
                own = d.get("unit")
                if not found and unit and (own is None or plain(str(own)) == plain(unit)):
                    found = finder.of(unit)  # same words; the column keeps the letter case
                if not found and own is not None:
                    found = finder.of(str(own))
                if not found and unit:
                    found = finder.of(unit)
                if not found:
                    name = str(d.get("attribute") or d.get("predicate") or "")
                    inside = attribute_parts(name)[1]
                    found = finder.of(inside) if inside else ()
                if not found and (said := announced(d.get("qualifier"))):
                    found = finder.of(said)
                if not found:
                    found = finder.beside(q[1], str(d.get("sourcequote") or "")) or finder.beside(q[1], text or "")
                if found:
                    out.append((i, *who, q[0], list(found)))
            yield pd.DataFrame(out, columns=["id", "entity", "attribute", "period", "value", "candidates"])

    narrow = facts.select("id", "canonical_key", "time_scope", "payload_json", F.col("value_num").cast("double"), "unit", "canonical_text").where("id is not null")
    return narrow.mapInPandas(read, "id string, entity string, attribute string, period string, value double, candidates array<string>")


def unit_rows(reference: DataFrame) -> list:
    """The unit table, fetched behind a check of its size."""
    rows = reference.where("unit_name is not null").select("unit_name", "dimension", "base_unit", F.col("factor").cast("double"), F.col("offset_value").cast("double")).dropDuplicates(["unit_name"]).limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units")
    return sorted(rows, key=lambda r: r.unit_name)


def in_base_units(facts: DataFrame, reference: DataFrame, attributes: set[str] | None = None) -> DataFrame:
    """One row per fact whose quantity has a unit of the table: id, entity, attribute, period, value,
    unit_name, dimension, base_unit, base_value.

    A spelling that can mean several units takes the one of the attribute's usual dimension (counted
    over all facts whose unit is certain).  Facts without a number or a known unit give no row; a
    fact delivered twice gives one.  Conversion factors are joined from the broadcast unit table,
    whose size is checked.  ``attributes``: of facts of these only.
    """
    rows = unit_rows(reference)
    spark = facts.sparkSession
    table = spark.createDataFrame([tuple(r) for r in rows], "unit_name string, dimension string, base_unit string, factor double, offset_value double")
    words = aliases([r.unit_name for r in rows])
    dims = {r.unit_name: r.dimension for r in rows}
    found = stated_units(facts, [r.unit_name for r in rows], attributes)
    if any(len({dims[u] for u in us}) > 1 for us in words.values()):
        # only spellings that can mean units of several dimensions need the attribute's usual one
        certain = found.where(F.size("candidates") == 1).select("attribute", F.col("candidates")[0].alias("unit_name"))
        usual = certain.join(F.broadcast(table), "unit_name").groupBy("attribute", "dimension").count().groupBy("attribute").agg(F.max_by("dimension", F.struct("count", "dimension")).alias("usual"))
        one = found.join(usual, "attribute", "left").withColumn("unit_name", F.explode("candidates")).join(F.broadcast(table), "unit_name")
        one = one.withColumn("fits", (F.size("candidates") == 1) | F.coalesce(F.col("dimension") == F.col("usual"), F.lit(False))).where("fits").drop("fits", "usual")
    else:
        one = found.withColumn("unit_name", F.col("candidates")[0]).join(F.broadcast(table), "unit_name")
    return one.select("id", "entity", "attribute", "period", "value", "unit_name", "dimension", "base_unit", (F.col("value") * F.col("factor") + F.coalesce("offset_value", F.lit(0.0))).alias("base_value")).dropDuplicates(["id"])


def same_measure(quantities: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Pairs of facts of one entity, attribute and period that state one quantity in different units.

    Facts that state the same (entity, attribute, period, unit and value) are one class, so a group of
    copies costs one row.  Classes are banded on a logarithmic scale whose step is the tolerance, so
    only neighbouring bands meet: an equi-join, never all pairs of a group.  The pairs of classes are
    then expanded to facts, heavy classes spread over tasks.  Pairs have the smaller id first.  Zero
    matches zero only.
    """
    import math

    step = -math.log1p(-tolerance) * 1.0001
    stated = ["entity", "attribute", "period", "dimension", "unit_name", "base_value"]
    fine = quantities.where("base_value is not null and not isnan(base_value)")
    # two hashes with different starts name a class; the join on bands carries the full key
    names = [F.xxhash64(F.lit(i), *stated).alias(f"c{i}") for i in (0, 1)]
    members = fine.select("id", *names)
    classes = fine.groupBy(*stated).agg(F.count("*").alias("n")).select("*", *names)
    band = F.when(F.col("base_value") == 0, F.lit(None)).otherwise(F.floor(F.log(F.abs("base_value")) / step).cast("bigint"))
    q = classes.select("c0", "c1", "n", *stated, F.signum("base_value").cast("int").alias("sign"), F.coalesce(band, F.lit(0)).alias("band"))
    right = q.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    keys = ["entity", "attribute", "period", "dimension", "sign", "band"]
    a, b = q.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = F.abs(F.col("a.base_value") - F.col("b.base_value")) <= tolerance * F.greatest(F.abs("a.base_value"), F.abs("b.base_value"))
    pairs = a.join(b, [*on, F.col("a.unit_name") < F.col("b.unit_name"), near]).select(*[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ab" for c in ("c0", "c1")])
    heavy = weighed_keys(classes, ["c0", "c1"])
    side = lambda s: members.select(F.col("id").alias(f"{s}_id"), F.col("c0").alias(f"{s}c0"), F.col("c1").alias(f"{s}c1"))
    weight = lambda s: heavy.withColumnsRenamed({"c0": f"{s}c0", "c1": f"{s}c1"})
    half = salted_join(side("a"), pairs, ["ac0", "ac1"], F.col("a_id"), weight("a"))
    both = salted_join(half, side("b"), ["bc0", "bc1"], F.col("a_id"), weight("b"))
    return both.select(F.least("a_id", "b_id").alias("fact_a_id"), F.greatest("a_id", "b_id").alias("fact_b_id"))
