"""Queries over giant series: what they send to the driver follows the rows, not the blocks."""

import pytest

from catalog import CASES
from plumbline.operators import series as series_module


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("giant"))
    events = spark.range(3000).selectExpr(
        "id AS event_id", "concat('t', id % 2) AS event_type", "double((id * 7919) % 211) AS value"
    )
    events.write.parquet(f"{folder}/events.parquet")
    lines = spark.range(24000).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id % 7 AS l_partkey", "id % 5 AS l_suppkey",
        "date_add(date'2024-01-01', int(id % 90)) AS l_shipdate", "double(id % 13) AS l_extendedprice",
        "if(id % 3 = 0, 'A', 'N') AS l_returnflag",
    )
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize(("query", "rows"), [
    ("cusum_head_start_blocks", 3000),
    ("dense_positions", 24000),
    ("cusum_chart_blocks", 3000),
    ("all_rules_blocks", 12854),
    ("excluded_moving_range", 2),
    ("individuals_chart_blocks", 3000),
])
def test_short_blocks_ask_for_no_more_partitions(spark, tables, monkeypatch, query, rows):
    """3,000 events are 6 to 20 blocks, 24,000 line items are 5; all fit one partition of the sort."""
    written, durable = [], series_module.durable
    monkeypatch.setattr(series_module, "durable", lambda df: written.append(durable(df)) or written[-1])
    assert CASES[query].run(spark, tables).count() == rows
    assert written and max(df.rdd.getNumPartitions() for df in written) <= 4
