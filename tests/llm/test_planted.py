"""Queries that plant what the driver's tables lack, against their SQL."""

from collections import Counter

import duckdb
import pytest

from inkstrata.llm import queries


@pytest.mark.parametrize("name", ["contract_op3_redirects", "contract_op5_planted"])
def test_planted_queries_match_their_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, tiny)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cur.fetchall())


def test_planted_redirects_reach_pages_without_a_rule(spark, tiny):
    rows = queries.contract_op3_redirects(spark, tiny).groupBy("via").count().collect()
    assert {r.via: r["count"] for r in rows}.get("alias", 0) > 0
