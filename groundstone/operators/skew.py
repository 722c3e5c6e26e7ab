"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: A key is heavy from this many rows; so many rows of it go to a task of their own.
HEAVY_ROWS = 20_000
#: At most so many keys, the heaviest, are treated as heavy, which bounds what is broadcast; a key
#: beyond them holds less than 1/HEAVY_KEYS of all rows.
HEAVY_KEYS = 20_000
#: Tasks of a heavy key whose count isn't given.
SALTS = 64


def weighed_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """From one row per key with its number of rows: the keys to salt, HEAVY_KEYS at most, and
    ``_salts``, over how many tasks, in proportion to their rows."""
    salts = F.ceil(F.col(n) / HEAVY_ROWS).cast("int").alias("_salts")
    return counts.where(F.col(n) >= HEAVY_ROWS).orderBy(F.desc(n), *keys).limit(HEAVY_KEYS).select(*keys, salts)


def heavy_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The keys alone; each is then spread over SALTS tasks."""
    return weighed_keys(counts, keys, n).select(*keys)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: Column, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join in which rows of ``many`` with a heavy key are spread over its ``_salts`` tasks.

    ``one`` should hold few rows of each heavy key: they are repeated as often.  ``spread`` is a
    deterministic expression over ``many`` (a retried task must give the same salt).
    """
    parts = F.col("_salts") if "_salts" in heavy.columns else F.lit(SALTS)
    flag = F.broadcast(heavy.select(*[F.col(k).alias(f"_heavy_{k}") for k in keys], parts.alias("_heavy")))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_heavy_{k}") for k in keys])
    salt = F.pmod(F.xxhash64(spread), F.col("_heavy")).cast("int")
    left = many.join(flag, same, "left").select(*many.columns, F.coalesce(salt, F.lit(0)).alias("_salt"))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_heavy"), F.lit(1)) - 1)
    right = one.join(flag, same, "left").select(*one.columns, F.explode(salts).alias("_salt"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
