"""Every cheap query against DuckDB; the ones that build whole clusters by two examples."""

from __future__ import annotations

import pytest

from kinfold import more_queries  # noqa: F401  (adds to QUERIES)
from kinfold.queries import QUERIES, SQL

WHOLE = {n for n in QUERIES if n[:3] in ("p25", "p28", "p31", "p32", "p34", "p36", "p40", "p41") or n.startswith("run_")}
CHOSEN = {"p34_confidence", "p41_golden_trust_recency", "run_incremental_equals_full"}


@pytest.mark.parametrize("name", sorted(set(SQL) - WHOLE | CHOSEN))
def test_query(name, same_as_oracle):
    same_as_oracle(name, QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert not set(QUERIES) - set(SQL)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
