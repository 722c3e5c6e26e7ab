"""Plugs for what isn't here: embedders and text models.  The defaults need neither files nor network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from groundstone.functions.payload import guarded

Embedder = Callable[[list[str]], np.ndarray]


def hashed_ngrams(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed hashing of character trigrams: like texts have like vectors."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        t = f"  {t.lower()} "
        for k in range(len(t) - 2):
            h = int.from_bytes(blake2b(t[k : k + 3].encode("utf-8", "replace"), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
    return out


def embedded(texts: Column, embedder: Embedder = hashed_ngrams, batch: int = 64) -> Column:
    """L2-normalised vectors of texts, in batches; null texts have none and a zero vector stays zero."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            out: list = [None] * len(s)
            here = [i for i, t in enumerate(s) if t is not None]
            for a in range(0, len(here), batch):
                part = here[a : a + batch]
                v = np.asarray(embedder([s.iloc[i] for i in part]), float)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                for i, row in zip(part, v / np.where(norm == 0, 1, norm)):
                    out[i] = row.astype(np.float32).tolist()
            yield pd.Series(out)

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(texts)


Model = Callable[[str], str]


class Chain:
    """The first model that answers; one that raises ``exhausted`` isn't asked again."""

    def __init__(self, models: list[Model], exhausted: tuple[type[BaseException], ...] = (RuntimeError,)):
        self.models, self.exhausted = list(models), exhausted

    def __call__(self, prompt: str) -> str:
        while self.models:
            try:
                return self.models[0](prompt)
            except self.exhausted:
                self.models.pop(0)
        raise RuntimeError("no model left")


def asked(prompts: DataFrame, prompt: str, make_model: Callable[[], Model], retries: int = 1) -> DataFrame:
    """Add the guard's struct of a model's answers; one model is made per task.

    An answer that fails is asked for again, ``retries`` times; attempts count all of them.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("raw", T.StringType()), T.StructField("tries", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from groundstone.functions.payload import guard

        model = make_model()
        for b in batches:
            raw, tries = [], []
            for p in b[prompt]:
                for n in range(1, retries + 2):
                    answer = model(p)
                    if n > retries or guard(pd.Series([answer])).outcome[0] != "failed":
                        break
                raw.append(answer)
                tries.append(n)
            yield b.assign(raw=raw, tries=tries)

    d = prompts.mapInPandas(run, schema).withColumn("g", guarded(F.col("raw")))
    outcome = F.when((F.col("g.outcome") == "ok_first_try") & (F.col("tries") > 1), "ok_after_reprompt").otherwise(F.col("g.outcome"))
    return d.select(*prompts.columns, outcome.alias("outcome"), F.col("tries").alias("attempts"), F.col("g.records").alias("records"))
