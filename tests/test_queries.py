"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from revlens.plans import ancestry, buildfiles, chains  # noqa: F401
from revlens.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if "datetime" in kind:
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object or kind.startswith(("str", "bool")):
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
        else:
            df[c] = df[c].astype(float).round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got, want = normal(QUERIES[name](spark, DATA).toPandas()), normal(con.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want)


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)


def test_small_negative_sums_keep_their_sign(spark, tmp_path):
    """a decayed sum a little below 0 is -0.0 in the SQL; of sf0.1, the commits of the file with such a sum."""
    c, at, rows = duckdb.connect(), "/root/testdata/sf0.1", "in (select l_orderkey from '/root/testdata/sf0.1/lineitem.parquet' where l_partkey = 3004)"
    for t, where in (("lineitem", f"l_orderkey {rows}"), ("orders", f"o_orderkey {rows}"), ("part", "true")):
        c.execute(f"copy (select * from '{at}/{t}.parquet' where {where}) to '{tmp_path}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    name = "decayed_file_system_sum_default_WD"
    want = {r[:3]: r[3] for r in c.execute(f"select rev, file, mod_idx, {name}::varchar from ({SQL['n1_linter_rows']})").fetchall()}
    got = {r[:3]: r[3] for r in QUERIES["n1_linter_rows"](spark, str(tmp_path)).select("rev", "file", "mod_idx", name).collect()}
    assert "-0.0" in want.values() and {k: None if v is None else str(v) for k, v in got.items()}.keys() == want.keys()
    assert [k for k, v in want.items() if v == "-0.0"] == [k for k, v in got.items() if str(v) == "-0.0"]
