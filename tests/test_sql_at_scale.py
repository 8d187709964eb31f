"""Queries and their SQL on inputs that the small tables lack."""

import duckdb

from tests.test_oracles import plain
from tidemark.queries import ORACLES, QUERIES


def agree(spark, folder, name, tables):
    """The query's rows, after comparing them with the SQL's over the same tables (name -> SELECT)."""
    con = duckdb.connect()
    for t, select in tables.items():
        con.sql(f"copy ({select}) to '{folder}/{t}.parquet'")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    relation = con.sql(ORACLES[name])
    at = [relation.columns.index(c) for c in columns]
    rows = df.collect()
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[i]) for i in at] for r in relation.fetchall())
    return rows


def test_digest_of_three_levels(spark, tmp_path):
    orders = "SELECT i AS o_orderkey, i % 1000 AS o_custkey, 'O' AS o_orderstatus, CASE WHEN i < 262145 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM range(262200) t(i)"
    assert sorted(r.n for r in agree(spark, tmp_path, "qa16_dataset_digest", {"orders": orders})) == [55, 262145]


def test_feeds_keep_hours_whose_first_price_is_zero(spark, tmp_path):
    events = "SELECT i AS event_id, 'click' AS event_type, TIMESTAMP '2024-01-01' + INTERVAL 30 MINUTE * i AS ts, CASE WHEN i % 10 = 0 THEN 0 ELSE (i * 37 % 101) END::DOUBLE AS value FROM range(200) t(i) WHERE i <> 21"
    (row,) = agree(spark, tmp_path, "joi03_compare_feeds", {"events": events})
    assert (row.n, row.missing_a, row.missing_b) == (100, 0, 1)


def test_live_averages_that_are_equal_do_not_cross(spark, tmp_path):
    events = "SELECT i AS event_id, 'click' AS event_type, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * i AS ts, (([0.1, 0.2, 0.3, 0.4, 0.7])[1 + i % 5])::DOUBLE AS value FROM range(300) t(i)"
    rows = agree(spark, tmp_path, "str05_live_signals", {"events": events})
    assert len(rows) == 300 and {r.signal for r in rows} == {0}
