"""The driver contract: entry() and every registered query run on sf0.001."""

import __spark_entry__ as E
from tests.conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"query_id", "rank", "chunk_id", "score"} <= set(df.columns)


def test_every_query_runs_and_has_oracle_or_is_listed(spark):
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    for name, fn in qs.items():
        fn(spark, SF001).limit(1).collect()
