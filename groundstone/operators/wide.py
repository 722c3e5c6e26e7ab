"""Entity, attribute, value rows into one row per entity and period with typed columns."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from groundstone.operators.factcells import identity, opened, typed

#: More attributes than this make no sensible table; the catalog travels in the tasks' closure.
MAX_ATTRIBUTES = 5_000

_KINDS = {"double": T.DoubleType(), "bigint": T.LongType(), "date": T.DateType(), "boolean": T.BooleanType(), "string": T.StringType()}
_CELL = "entity string, period string, attribute string, d double, l bigint, s string"


def catalog_of(catalog: DataFrame) -> dict[str, str]:
    """Attribute to type, from a catalog whose size is checked before it is fetched."""
    rows = catalog.select("attribute", "value_type").where("attribute is not null").distinct().orderBy("attribute", "value_type").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    out: dict[str, str] = {}
    for r in rows:
        out.setdefault(r.attribute, r.value_type if r.value_type in _KINDS else "string")
    return out


def stated_cells(facts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row per fact that states a value of its attribute's type.

    Columns: entity, period, attribute, the value in ``d`` (double), ``l`` (bigint, date as days,
    boolean as 0/1) or ``s``, and ``rank`` by which one fact is chosen for a cell: the higher
    confidence, then the smaller id.  Null ids, payloads that are no JSON object and attributes that
    aren't in the catalog give no row.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, key, scope, payload, conf, num in zip(b.id, b.canonical_key, b.time_scope, b.payload_json, b.confidence, b.value_num):
                d = opened(payload)
                entity, attribute, period = identity(key, scope, d)
                kind = kinds.get(attribute)
                if kind is None:
                    continue
                value = typed(d.get("value"), kind)
                if value is None and d.get("value") is None and num == num and kind == "double":
                    value = float(num)
                if value is None:
                    continue
                if kind == "date":
                    value = (value - datetime.date(1970, 1, 1)).days
                wide = kind in ("bigint", "date", "boolean")
                out.append((entity, period, attribute, value if kind == "double" else None, int(value) if wide else None, value if kind == "string" else None, conf if conf == conf else -1.0, i))
            yield pd.DataFrame(out, columns=["entity", "period", "attribute", "d", "l", "s", "confidence", "id"]).astype({"l": "Int64"})

    narrow = facts.select("id", "canonical_key", "time_scope", "payload_json", F.col("confidence").cast("double"), F.col("value_num").cast("double")).where("id is not null")
    return narrow.mapInPandas(read, _CELL + ", confidence double, id string")


def cells(facts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row per filled cell.  Facts of a cell are combined before the shuffle, so an entity, or
    one cell, may hold any share of the rows; a fact delivered twice changes nothing."""
    return (
        stated_cells(facts, kinds)
        .groupBy("entity", "period", "attribute")
        .agg(F.min_by(F.struct("d", "l", "s"), F.struct(-F.col("confidence"), F.col("id"))).alias("v"))
        .select("entity", "period", "attribute", "v.*")
    )


def wide_schema(kinds: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField("entity", T.StringType()), T.StructField("period", T.StringType()), *(T.StructField(a, _KINDS[k]) for a, k in sorted(kinds.items()))])


def widen(long: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Filled cells to one row per entity and period, a typed column per attribute of the catalog.

    Rows are hash-bucketed by entity and period and sorted by them, so one row's cells lie together
    in one task.  Each Arrow batch is dictionary-encoded, scattered by row and column index into one
    numpy array per type and emitted as Arrow; the last row of a batch waits for the next batch.
    Attribute names that clash with ``entity`` or ``period`` are an error.
    """
    if {"entity", "period"} & set(kinds):
        raise ValueError("an attribute is named entity or period")
    names = sorted(kinds)
    at = {a: i for i, a in enumerate(names)}
    of_kind = {k: [a for a in names if kinds[a] == k] for k in _KINDS}
    slot = np.zeros(len(names), np.int64)
    for columns in of_kind.values():
        for j, a in enumerate(columns):
            slot[at[a]] = j
    kind_no = {k: i for i, k in enumerate(_KINDS)}
    kind_of = np.array([kind_no[kinds[a]] for a in names], np.int64)
    arrow = pa.schema([("entity", pa.string()), ("period", pa.string()), *((a, {"double": pa.float64(), "bigint": pa.int64(), "date": pa.date32(), "boolean": pa.bool_(), "string": pa.string()}[kinds[a]]) for a in names)])

    def scatter(table: pa.Table) -> pa.RecordBatch:
        ent, per = table["entity"].combine_chunks().dictionary_encode(), table["period"].combine_chunks().dictionary_encode()
        both = np.asarray(ent.indices).astype(np.int64) * (len(per.dictionary) + 1) + np.asarray(per.indices)
        _, first, row = np.unique(both, return_index=True, return_inverse=True)
        attr = table["attribute"].combine_chunks().dictionary_encode()
        col = np.array([at[a] for a in attr.dictionary.to_pylist()], np.int64)[np.asarray(attr.indices)]
        arrays: dict[str, pa.Array] = {}
        for k, columns in of_kind.items():
            mine = np.flatnonzero(kind_of[col] == kind_no[k])
            shape = (len(columns), len(first))
            filled = np.zeros(shape, bool)
            where = (slot[col[mine]], row[mine])
            filled[where] = True
            if k == "double":
                values = np.zeros(shape)
                values[where] = np.asarray(table["d"].combine_chunks().take(pa.array(mine)))
            elif k == "string":
                values = np.full(shape, None, object)
                values[where] = np.array(table["s"].combine_chunks().take(pa.array(mine)).to_pylist(), object)
            else:
                values = np.zeros(shape, np.int64)
                values[where] = np.asarray(table["l"].combine_chunks().take(pa.array(mine)))
                values = values.astype({"bigint": "i8", "date": "i4", "boolean": "?"}[k])
            for j, a in enumerate(columns):
                arrays[a] = pa.array(values[j], type=arrow.field(a).type, mask=~filled[j])
        pick = pa.array(first)
        return pa.RecordBatch.from_arrays([table["entity"].combine_chunks().take(pick), table["period"].combine_chunks().take(pick), *(arrays[a] for a in names)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t])
            ent, per = t["entity"], t["period"]
            last, n = (ent[-1].as_py(), per[-1].as_py()), t.num_rows
            cut = n
            while cut and (ent[cut - 1].as_py(), per[cut - 1].as_py()) == last:
                cut -= 1
            left = t.slice(cut)
            if cut:
                yield scatter(t.slice(0, cut))
        if left is not None:
            yield scatter(left)

    return long.repartition("entity", "period").sortWithinPartitions("entity", "period").mapInArrow(run, wide_schema(kinds))


def wide_table(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per entity and period with a column per attribute, typed as the catalog says.

    Empty tables give no rows (and with an empty catalog no attribute columns).  Of several facts
    that state a cell, the one of highest confidence counts, then of the smallest id.  The value is
    the number as printed; ``units.in_base_units`` converts.
    """
    kinds = catalog_of(catalog)
    return widen(cells(facts, kinds), kinds)


def filled_cells(wide: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The filled cells of a wide table as (entity, period, attribute)."""
    filled = F.filter(F.array(*[F.when(F.col(f"`{a}`").isNotNull(), F.lit(a)) for a in sorted(kinds)]), lambda a: a.isNotNull())
    if not kinds:
        return wide.select("entity", "period", F.lit("").alias("attribute")).limit(0)
    return wide.select("entity", "period", F.explode(filled).alias("attribute"))
