import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from groundstone.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=2, memory="4g")
    s.sparkContext.setLogLevel("OFF")
    return s


FACT = "id string, document_id string, chunk_id string, payload_json string, fact_type string, canonical_key string, canonical_text string, value_num double, unit string, time_scope string, confidence double, extractor string, embedded int, created_at timestamp"


@pytest.fixture
def facts(spark):
    """Facts from (id, payload and any columns by name)."""
    names = [c.split()[0] for c in FACT.split(", ")]

    def make(*rows, extra=""):
        data = [tuple({"id": i, "payload_json": p, "confidence": 0.5, **more}.get(n) for n in names) + ((1,) if extra else ()) for i, p, more in rows]
        return spark.createDataFrame(data, FACT + (f", {extra} int" if extra else ""))

    return make


@pytest.fixture
def rows():
    def of(df, *columns):
        return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)

    return of
