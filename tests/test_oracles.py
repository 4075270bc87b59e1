"""Every registered query against its DuckDB oracle (the driver's gate), on
the smallest test tables; keys without an oracle must at least run."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_harness import compare, duck

KEYS = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, con, key, E.queries()[key], E.oracle_sql().get(key), SF_SMALL)
    assert res["status"] in ("ok", "rows-only"), res


def test_every_query_has_unique_key():
    assert len(KEYS) == len(set(KEYS))
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["cred_label", "claim_id", "claim", "claim_source", "evidences"]
