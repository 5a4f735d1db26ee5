"""Queries over tables with more keys than a file's extents can hold."""

import duckdb

from tessera import queries as Q


def test_volume_ranges_with_keys_beyond_16_bits(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT (i * 7919) % 70001 AS l_suppkey, 1 + i % 7 AS l_linenumber, (1 + i % 50)::DOUBLE AS l_quantity, ['A','N','R'][1 + i % 3] AS l_returnflag,
        TIMESTAMP '1994-01-01' + INTERVAL (CASE WHEN i < 200 THEN i ELSE 365 + i % 365 END) DAY AS l_shipdate FROM range(3000) r(i) UNION ALL SELECT 70000, 1, 5.0, 'A', TIMESTAMP '1995-06-01') TO '{tmp_path}/lineitem.parquet'""")
    Q.queries()["volume_ranges"](spark, str(tmp_path)).select("r", "x", "shipped", "quantity").write.parquet(f"{tmp_path}/got")
    c = duckdb.connect()
    c.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    c.sql(f"CREATE TABLE want AS SELECT r::INT AS r, x, shipped, quantity FROM ({Q.oracle_sql()['volume_ranges']})")
    assert c.sql("SELECT count(*) FROM want").fetchall() == c.sql("SELECT count(*) FROM got").fetchall() == [(2 * 70001,)]
    assert c.sql("FROM want EXCEPT FROM got").fetchall() == []
