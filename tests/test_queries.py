"""Every registered query of the screens against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from probitas import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(float(v), 8)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["t6_cross_figure", "c1_cross_figure_pipeline"])
def test_ties_in_file_order(spark, tmp_path, name):
    """Two lines of supplier 4 tie across files; in file order its series equals that of supplier 8. Spark reads larger files first."""
    (tmp_path / "lineitem.parquet").mkdir()
    lines = [(8, k, 1, v) for k, v in enumerate([11.0, 370.0, 52.0, 9.0])] + [(4, 0, 1, 11.0), (4, 2, 1, 52.0), (4, 3, 1, 9.0)]
    others = [(100, 10 + k, 1, 1000.0 + 7 * k * k) for k in range(300)]
    for part, some in (("a", lines), ("b", [(4, 0, 1, 370.0), *others])):
        pd.DataFrame(some, columns=["l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"]).to_parquet(tmp_path / f"lineitem.parquet/{part}.parquet")
    got = {(r.la, r.lb) for r in registry.queries()[name](spark, str(tmp_path)).where("match_type = 'exact_match'").collect()}
    assert {("a4", "a8"), ("a4", "b4"), ("a4", "b8")} <= got
