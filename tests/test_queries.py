"""Every registered query runs, and agrees with its SQL."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_store_queries_show_every_outcome(spark):
    from pairloom.plans import stores

    n = spark.read.parquet(f"{SF}/events.parquet").count()
    hits = {r.hit for r in QUERIES["j2_cache_lookup"](spark, SF).collect()}
    assert hits == {True, False}
    kept = stores.store(spark, SF).select("key", stores.S.is_live(stores.now()).alias("live")).collect()
    assert {r.live for r in kept} == {True, False}
    asked = {r.key for r in stores.requests(spark, SF).collect()}
    assert asked - {r.key for r in kept}
    assert {r.tier for r in QUERIES["j5_two_tier_lookup"](spark, SF).collect()} == {"primary", "secondary", None}
    for name in ("j3_cache_exists", "j4_cache_misses", "c2_store_get_after_delete", "j5_two_tier_promote"):
        assert 0 < QUERIES[name](spark, SF).count() < n, name
    for name in ("j7_cache_delete", "c4_store_purge_expired"):
        assert 0 < QUERIES[name](spark, SF).count() < len(kept), name
