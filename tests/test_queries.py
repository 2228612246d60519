import os

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in ("feature_allzero", "group_moments", "nb_logmu", "nb_ll", "norm_fim", "poisson_fit", "poisson_fit_additive", "nb_hessian", "nb_fit_scale", "nb_fit_size_factors", "bin_covariate", "distinct_design")])
def test_as_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "part", "orders", "lineitem", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    rel = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(rel.columns)
    one = lambda v: round(v, 3) + 0.0 if isinstance(v, float) else v
    key = lambda rows: sorted(tuple(map(one, r)) for r in rows)
    assert key(got.select(*rel.columns).collect()) == key(rel.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
