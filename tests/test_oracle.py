"""Every query against its SQL on the smallest tables."""

import math

import pytest

from tidewater.plans import oracle, queries

SQL = oracle.oracle_sql()


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return f"{float(v):.8g}"


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(t[i]) for i in order) for t in tuples), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    got = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL) - {"linear_probe"}))
def test_without_sql_is_whole(spark, duck, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    assert df.count() == duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]


def test_linear_probe_is_judged_on_unseen_rows(spark, duck, sf_dir):
    got = queries.queries()["linear_probe"](spark, sf_dir).collect()
    total = duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    assert 0.12 * total < len(got) < 0.28 * total and len({r.vec_id for r in got}) == len(got)
    assert all(r.pred in range(10) for r in got)
