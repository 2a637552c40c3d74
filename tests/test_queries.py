"""Every query against its SQL, and the driver contract."""

import re

import pytest
from oracle_check import difference, tables

from dialoom.plans import oracle, registry


def ordered_pass(spark, sf, df):
    """The fold as a loop over the records in order."""
    seen, kept = {}, set()
    norm = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()
    rows = registry.one_conv(spark, sf, "topic", "core_question", "answer_summary").collect()
    for r in sorted(rows, key=lambda r: r.id):
        if r.topic is None or r.core_question is None:
            continue
        keys = [norm(r.topic), *filter(None, [norm(r.answer_summary or "")])]
        own = seen.setdefault(re.match(r".+_([a-z]+)_", r.id)[1], set())
        if own.isdisjoint(keys):
            own.update(keys)
            kept.add(r.id)
    return {r.id for r in df.collect()} == kept and 0 < len(kept) < len(rows)


# Queries without SQL.
BRUTE = {"topic_fold": ordered_pass}


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    if name in oracle.SQL:
        assert difference(df, con, oracle.SQL[name]) == ""
    else:
        assert name in BRUTE and BRUTE[name](spark, sf, df)


def test_contract(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
