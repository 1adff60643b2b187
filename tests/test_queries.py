"""Every reference query against its oracle, on the smallest tables."""

import math

import duckdb
import pytest

from inkstrata.plans import queries as Q
from inkstrata.streaming import records

TABLES = "documents pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, tiny, duck, name):
    df = Q.QUERIES[name](spark, tiny)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = duck.execute(Q.ORACLE[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    want = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_runs(spark, tiny, name):
    assert Q.QUERIES[name](spark, tiny).count() > 0


def test_stream_of_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": 1, "text": "he\\u200bllo"}\n{bad\n{"doc_id": 2, "text": "x"}\n')
    stream = records.screened(records.record_stream(spark, str(tmp_path / "in")))
    records.run_once(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    rows = {r.doc_id: (r.n_flagged, r.cleaned) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1] == (1, "hello") and rows[2] == (0, "x") and None in rows
