"""Registered queries next to their SQL on the smallest tables; results must not depend on the partition count."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# every query of the library itself; the optional operators have tests of their own
NAMES = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: v + 0.0 if isinstance(v, float) else v
    return [cols[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    want = canon([d[0] for d in cur.description], cur.fetchall())
    assert canon(df.columns, df.collect()) == want
    assert want[1]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "passage_id", "lang", "score", "n_words", "text", "rank"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["d1_dedup_close_starts", "w12_split_arcs", "a3_gap_distribution", "j7_interpolate_at"])
def test_partition_count_does_not_matter(spark, sf, name, monkeypatch):
    from cadenza.operators import cuts, ordered

    res = []
    for n in (1, 40):
        for m in (ordered, cuts):
            monkeypatch.setattr(m, "block_count", lambda df, n=n: n)
        res.append(sorted(map(repr, entry.queries()[name](spark, sf).collect())))
    assert res[0] == res[1]
