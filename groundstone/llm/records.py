"""Records that differ in layout only, collapsed with their number of copies (problem 1).

Merkle-style: a leaf is normalised and hashed; an object's digest is made from its children's
digests sorted by key, an array's from its children in order; records are grouped by root digest.
A digest only proposes: every member's whole structure is compared with its group's first record.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundstone.operators.skew import weighed_keys, salted_join
from groundstone.session import cut

# Punctuation that counts: a point between digits, a minus that begins a number, % and currency
# signs (which, like other symbols, aren't punctuation in Unicode), in any width.
_POINTS, _MINUSES, _PERCENTS = ".．﹒٫", "-−－﹣", "%％﹪٪"
_PLAIN = str.maketrans(dict.fromkeys(_POINTS, ".") | dict.fromkeys(_MINUSES, "-"))
_PUNCTUATION = "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "P" and c not in _POINTS + _MINUSES + _PERCENTS)


def _drop(plain: str) -> re.Pattern:
    return re.compile(
        rf"(?:[\s{plain}]"
        rf"|(?<!\d)[{_POINTS}]|[{_POINTS}](?!\d)|(?<=\w)[{_MINUSES}]|[{_MINUSES}](?![$₹€£¥]?[{_POINTS}]?\d))+"
    )


# the long class is slow, and most texts don't need it
_DROP, _DROP_ASCII = _drop(_PUNCTUATION + "‰-⁞、-〃〈-】〔-〟"), _drop("_!\"#&'()*,/:;?@\\[\\]\\\\{}")


@lru_cache(50_000)
def leaf_text(text: str) -> str:
    """Without letter case, white space and punctuation."""
    if text.isascii():
        return _DROP_ASCII.sub("", text.casefold())
    return _DROP.sub("", unicodedata.normalize("NFC", text).casefold()).translate(_PLAIN)


@lru_cache(10_000)
def key_text(key: str) -> str:
    return re.sub(r"[\W_]+", "", key.casefold())


def _hash(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def node(value: object) -> tuple[bytes, str]:
    """Digest and canonical form of a value; forms are equal only if the structures are."""
    if isinstance(value, dict):
        kids = sorted((key_text(k), *node(v)) for k, v in value.items())
        return _hash(b"{" + b"".join(_hash(k.encode("utf-8", "surrogatepass")) + d for k, d, _ in kids)), "{" + ",".join(f"{len(k)}:{k}{f}" for k, _, f in kids) + "}"
    if isinstance(value, list):
        kids = [node(v) for v in value]
        return _hash(b"[" + b"".join(d for d, _ in kids)), "[" + ",".join(f for _, f in kids) + "]"
    if value is None:
        form = "n"
    elif isinstance(value, bool):
        form = "t" if value else "f"
    elif isinstance(value, (int, float)):
        form = f"#{int(value) if isinstance(value, float) and value.is_integer() else value!r}"
    else:
        text = leaf_text(value)
        form = f"{len(text)}'{text}"
    return _hash(form.encode("utf-8", "surrogatepass")), form


def record(text: str | None, payload: str | None) -> tuple[bytes, str]:
    """Root digest and form of a fact; a payload that is no JSON is one leaf of text."""
    try:
        body = json.loads(payload) if payload is not None else None
        a, b = node(text), node(body)
    except (ValueError, RecursionError):
        a, b = node(text), node("json? " + payload)
    return _hash(a[0] + b[0]), a[1] + b[1]


def rooted(facts: DataFrame) -> DataFrame:
    """id, root digest and canonical form of every fact with an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [record(t, p) for t, p in zip(b.canonical_text, b.payload_json)]
            yield pd.DataFrame({"id": b.id, "digest": [x[0] for x in both], "form": [x[1] for x in both]})

    return facts.where("id is not null").select("id", "canonical_text", "payload_json").mapInPandas(run, "id string, digest binary, form string")


def copy_groups(facts: DataFrame) -> DataFrame:
    """One row per fact id that has a copy: id and first_id, the smallest id of its group.

    Null texts equal null texts only; an id delivered twice counts once.  Only groups of two or more are compared in full,
    so the forms of single records are never shuffled.  A group may hold any share of the rows:
    counts and smallest ids are combined before the shuffle and its members are salted.
    """
    roots = cut(rooted(facts), "roots")
    ids = roots.select("id", "digest").distinct()
    groups = ids.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    groups = cut(groups, "root-groups")
    heavy = weighed_keys(groups, ["digest"], "copies")
    members = salted_join(roots, groups, ["digest"], F.col("id"), heavy)
    members = cut(members.select("id", "digest", "first_id", "form"), "root-members")
    firsts = members.where("id = first_id").select("digest", F.col("form").alias("first_form")).dropDuplicates(["digest"])
    proven = salted_join(members, firsts, ["digest"], F.col("id"), heavy)
    # a digest shared by different structures: each structure is its own group
    proven = proven.select("id", "digest", "first_id", F.when(F.col("form") == F.col("first_form"), F.lit("")).otherwise(F.col("form")).alias("other"))
    same = proven.where("other = ''").select("id", "digest", "first_id").distinct()
    clashed = proven.where("other != ''").select("id", "digest", "other").distinct()
    clashed_first = clashed.groupBy("digest", "other").agg(F.min("id").alias("first_id"))
    return same.select("id", "first_id").union(clashed.join(clashed_first, ["digest", "other"]).select("id", "first_id"))


def distinct_records(facts: DataFrame) -> DataFrame:
    """One row per distinct record: first_id and copies (1 if it has no copy)."""
    groups = cut(copy_groups(facts), "copy-groups")
    counted = groups.groupBy("first_id").agg(F.count("*").alias("copies"))
    alone = facts.where("id is not null").select("id").distinct().join(groups.select("id"), "id", "left_anti")
    return counted.union(alone.select(F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("copies")))
