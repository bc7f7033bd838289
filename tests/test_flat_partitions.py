"""Queries that neither widen nor gather rows take larger shuffle partitions; the intake keeps its paths on disk."""

import pytest

import inkgrade.plans.all  # noqa: F401  registers every query
from inkgrade.plans import catalog
from inkgrade.streaming import uploads as U

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def session(spark):
    """A session with settings of its own."""
    own = spark.newSession()
    own.conf.set(catalog.SHUFFLE_PARTITIONS, "2")
    return own


@pytest.fixture
def tables(spark, tmp_path):
    spark.range(150000).selectExpr("id AS o_orderkey", "uuid() AS o_comment").coalesce(1).write.option("compression", "none").parquet(
        f"{tmp_path}/orders.parquet")
    return str(tmp_path), sum(f.stat().st_size for f in (tmp_path / "orders.parquet").glob("*.parquet"))


def test_flat_queries_take_larger_partitions(session, tables, monkeypatch):
    base, size = tables
    monkeypatch.setattr(catalog, "FLAT_BYTES", 1 << 21)
    partitions = lambda flat: (catalog.Tables(session, base, flat).orders.count(), int(session.conf.get(catalog.SHUFFLE_PARTITIONS)))[1]
    assert partitions(True) == -(-size // (1 << 21)) > 2
    assert partitions(False) == -(-size // (1 << 20))
    assert partitions(True) == -(-size // (1 << 21))  # a number raised for another query is taken back
    session.conf.set(catalog.SHUFFLE_PARTITIONS, "77")
    assert partitions(True) == partitions(False) == 77  # the user's is not


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith("stream_") and n != "stream_apply_results"])
def test_streams_are_flat_and_keep_their_state_on_disk(session, name, monkeypatch):
    seen = []

    def stop(self, table):
        seen.append(self._flat)
        raise KeyError(table)

    monkeypatch.setattr(catalog.Tables, "__getattr__", stop)
    with pytest.raises(KeyError):
        catalog.QUERIES[name](session, "/nowhere")
    assert seen[0] and session.conf.get(PROVIDER) == U.ROCKSDB
