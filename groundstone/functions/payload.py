"""Fields of a fact's JSON payload, and the guard around JSON that a model wrote."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The core keys of a record, and the keys that may wrap a list of records.
CORE_KEYS = "subject attribute value unit time_scope qualifier confidence source_quote".split()
WRAPPERS = "facts results items data output extractions".split()


def field(payload: Column, key: str) -> Column:
    """A field as text; JSON's true and false are written as ``True`` and ``False``."""
    raw = F.get_json_object(payload, f"$.{key}")
    flag = F.regexp_extract(payload, f'"{key}"\\s*:\\s*(true|false)\\s*[,}}]', 1)
    return F.when(raw.isin("true", "false") & (flag == raw), F.initcap(raw)).otherwise(raw)


def attribute(payload: Column) -> Column:
    """``attribute``, or ``predicate`` where it is missing or empty."""
    return F.coalesce(F.nullif(field(payload, "attribute"), F.lit("")), field(payload, "predicate"))


def emergent_keys(payload: Column) -> Column:
    """Keys beyond the core, sorted."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return F.array_sort(F.filter(keys, lambda k: ~k.isin([*CORE_KEYS, "predicate"])))


def stored(record: Column, quote: Column) -> Column:
    """A record (map of text) as it is stored: empty emergent keys dropped, the real quote put in."""
    kept = F.map_filter(record, lambda k, v: v.isNotNull() | k.isin(CORE_KEYS))
    return F.to_json(F.map_concat(F.map_filter(kept, lambda k, v: k != "source_quote"), F.create_map(F.lit("source_quote"), quote)))


def without_fence(c: Column) -> Column:
    """The inside of the first fenced block, or the text itself."""
    inside = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(c.rlike(r"(?is)```(?:json)?\s*(.*?)\s*```"), inside).otherwise(F.trim(c))


def _records(value: object) -> list[dict] | None:
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if isinstance(value, dict):
        for key in WRAPPERS:
            if isinstance(value.get(key), list):
                return [x for x in value[key] if isinstance(x, dict)]
        return [value] if value else []
    return None


def mend(text: str) -> str | None:
    """Close what a cut-off JSON text left open, after the last complete element; None if hopeless."""
    stack: list[str] = []
    inside = escaped = False
    good: tuple[int, str] | None = None
    start = next((i for i, ch in enumerate(text) if ch in "[{"), None)
    if start is None:
        return None
    for i in range(start, len(text)):
        ch = text[i]
        if inside:
            inside, escaped = escaped or ch != '"', ch == "\\" and not escaped
            continue
        if ch == '"':
            inside = True
        elif ch in "[{":
            stack.append("]" if ch == "[" else "}")
        elif ch in "]}":
            if not stack or stack.pop() != ch:
                break
            good = i + 1, "".join(reversed(stack))
            if not stack:
                break
    return text[start : good[0]] + good[1] if good else None


def guard(texts: pd.Series) -> pd.DataFrame:
    """Outcome, attempts and records of raw model output: parse, else mend, else failed."""
    rows = []
    for raw in texts:
        text = (raw or "").strip()
        rows.append(("ok_first_try", 1, []) if not text else ("failed", 1, []))
        for outcome, candidate in (("ok_first_try", text), ("ok_after_repair", mend(text) if text else None)):
            try:
                found = _records(json.loads(candidate)) if candidate else None
            except (ValueError, RecursionError):
                found = None
            if found is not None:
                rows[-1] = outcome, 1, [json.dumps(r, ensure_ascii=False) for r in found]
                break
    return pd.DataFrame(rows, columns=["outcome", "attempts", "records"])


def guarded(raw: Column) -> Column:
    """struct(outcome, attempts, records) of raw model output; fences are taken off first.

    Another attempt by the model is the caller's: rows that failed can be sent to a proposer again.
    """
    kind = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("records", T.ArrayType(T.StringType()))])
    return F.pandas_udf(guard, kind)(without_fence(raw))
