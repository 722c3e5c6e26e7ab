"""Queries of the general data problems: wide tables and common units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundstone.operators import units, wide
from groundstone.session import cut
from groundstone.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The filled cells of the wide table."""
    kinds = wide.catalog_of(table(spark, folder, "attribute_catalog"))
    return wide.filled_cells(wide.widen(wide.cells(table(spark, folder, "facts"), kinds), kinds), kinds).select("entity", "period", "attribute")


def p3_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity and period, a typed column per attribute."""
    return wide.wide_table(table(spark, folder, "facts"), table(spark, folder, "attribute_catalog"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that state one quantity in different units."""
    catalog = table(spark, folder, "attribute_catalog").where("value_type = 'double'")
    doubles = {a for a, k in wide.catalog_of(catalog).items() if k == "double"}
    base = units.in_base_units(table(spark, folder, "facts"), table(spark, folder, "unit_reference"), doubles)
    # written once: classes, members and their joins read it
    return units.same_measure(cut(base, "base-units"))


def p7_base_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every quantity in the base unit of its dimension."""
    return units.in_base_units(table(spark, folder, "facts"), table(spark, folder, "unit_reference"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_wide": p3_wide, "p7_found": p7_found, "p7_base_units": p7_base_units}
