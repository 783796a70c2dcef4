"""Every registered query against its SQL on the small tables, as bags of rounded rows."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from sceneloom.plans import all_oracles, all_queries  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, tables, name):
    df = all_queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in all_oracles():
        assert columns
        return
    want = tables.sql(all_oracles()[name])
    assert columns == sorted(want.columns)
    assert got == sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_instance_names_of_long_keys(spark, tmp_path):
    """Keys of seven digits and more are cut as the SQL cuts them."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (l_orderkey * 977 AS l_orderkey) FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = all_queries()["instance_names"](spark, str(tmp_path))
    assert max(r["l_orderkey"] for r in df.collect()) > 1_000_000
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(all_oracles()["instance_names"]).select(*df.columns).fetchall())
