import pytest

from tidepool.sources.versions import Versions

SHAPE = "id long, action string, status string, result double"


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), f"op string, seq long, {SHAPE}")


@pytest.fixture
def store(spark, tmp_path):
    s = Versions(spark, f"file://{tmp_path}/store", SHAPE, buckets=4)
    s.create()
    return s


def rows(df):
    return {r.id: (r.action, r.status, r.result, r.created) for r in df.collect()}


def test_versions_of_a_store(spark, store):
    assert rows(store.read()) == {} and store.newest() == 0
    store.write(changes(spark, *[("create", i, i, "WATCH", "open", None) for i in range(1, 9)]))
    # of one key: created again (keeps its age), observed; observed only; observed twice; deleted; deleted and made again; observed without being there
    store.write(changes(spark, ("create", 10, 1, "ALLOW", "open", None), ("observe", 11, 1, None, "resolved", 2.5), ("observe", 12, 2, None, "resolved", 1.0), ("observe", 13, 3, None, None, 7.0), ("observe", 14, 3, None, None, 8.0), ("delete", 15, 4, None, None, None), ("delete", 16, 5, None, None, None), ("create", 17, 5, "BLOCK", "open", None), ("observe", 18, 99, None, "resolved", 1.0), ("observe", 9, 6, None, "early", 3.0), ("create", 19, 6, "ALLOW", "open", None)))
    now = {1: ("ALLOW", "resolved", 2.5, 1), 2: ("WATCH", "resolved", 1.0, 2), 3: ("WATCH", "open", 8.0, 3), 5: ("BLOCK", "open", None, 5), 6: ("ALLOW", "open", None, 6), 7: ("WATCH", "open", None, 7), 8: ("WATCH", "open", None, 8)}
    assert rows(store.read()) == now and len(rows(store.read(1))) == 8
    assert store.shed(5, 1) == 3 and set(rows(store.read())) == set(now) - {1}
    assert store.shed(5, 250) == 4 and set(rows(store.read())) == {3, 5, 6, 7, 8}
    assert store.shed(5, 250) == 4


def test_a_write_that_stops_leaves_the_version_before(spark, store):
    store.write(changes(spark, ("create", 1, 1, "WATCH", "open", None)))
    store.write(changes(spark, ("delete", 2, 1, None, None, None)), stop=True)
    assert store.newest() == 1 and set(rows(store.read())) == {1}
    store.write(changes(spark, ("create", 3, 2, "ALLOW", "open", None)))
    assert set(rows(store.read())) == {1, 2}


def test_only_touched_buckets_are_written_anew(spark, store):
    store.write(changes(spark, *[("create", i, i, "WATCH", "open", None) for i in range(40)]))
    first = store._writes(1)
    store.write(changes(spark, ("observe", 50, 7, None, "resolved", 1.0)))
    second = store._writes(2)
    assert sum(first[b] != second[b] for b in first) == 1
    store.write(changes(spark).limit(0))
    assert store._writes(3) == second
