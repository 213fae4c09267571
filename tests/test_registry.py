import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["ts", "sectorid", "weighted_return", "asset_count", "weight_sum"]


@pytest.mark.parametrize("name", ["group_weighted_return", "ohlcv_bars_hourly", "detect_gaps", "performance", "drawdown_details", "triple_barrier", "average_uniqueness", "trade_stats_by", "purged_walk_forward", "roc_curve", "ta_STOCH", "pta_ichimoku", "rec_RSI"])
def test_rows_equal_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()[list(got.columns)]
    show = lambda df: sorted("|".join("" if v is None or v != v else f"{v:.5g}" if isinstance(v, float) else str(v)[:19].removesuffix(" 00:00:00") for v in r) for r in df.itertuples(index=False))
    assert len(got) == len(want) > 0
    a, b = show(got), show(want)
    assert sum(x != y for x, y in zip(a, b)) <= 0.01 * len(a)
