"""Published versions: copy-on-write, one winner of two writers, all tables or none."""

import pytest

from innkeep.sources.versions import Conflict, VersionedTables
from innkeep.streaming.jobs import scratch_dir

SCHEMA = "id long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark):
    store = VersionedTables(spark, scratch_dir(spark, "t-versions"), buckets=4)
    assert store.latest() == (0, {})
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    first = [(i, f"a{i}") for i in range(40)]
    assert store.publish({"t": (frame(first), ["id"]), "u": (frame([(None, "x")]), ["id"])}) == 1
    before = store.latest()[1]
    assert rows(store.read("t")) == sorted(first, key=str) and rows(store.read("u")) == [(None, "x")]
    # one key: one bucket written, the other folders are those of the version before
    assert store.apply({"t": (frame([(7, "new")]), None)}) == 2
    after = store.latest()[1]
    moved = [b for b in after["t"]["parts"] if after["t"]["parts"][b] != before["t"]["parts"].get(b)]
    assert len(moved) == 1 and after["u"] == before["u"]
    assert dict(rows(store.read("t")))[7] == "new" and dict(rows(store.read("t", before)))[7] == "a7"
    # deletes, inserts, and nothing at all
    store.apply({"t": (frame([(100, "in"), (7, "both")]), frame([(i, "") for i in range(8)])), "u": (frame([(1, "y")]), None)})
    assert dict(rows(store.read("t"))) == {**dict(first[8:]), 100: "in"} and len(rows(store.read("u"))) == 2
    store.apply({"t": (None, store.read("t"))})
    assert store.read("t").count() == 0 and store.read("t").columns == ["id", "v"]
    assert store.apply({"t": (None, None)}) == 5


def test_two_writers_cannot_both_win(spark):
    store = VersionedTables(spark, scratch_dir(spark, "t-race"), buckets=2)
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    store.publish({"t": (frame([(1, "a")]), ["id"])})
    seen, manifest = store.latest()
    mine = {**manifest, "t": store.changed("t", manifest, frame([(1, "mine")]))}
    theirs = {**manifest, "t": store.changed("t", manifest, frame([(1, "theirs")]))}
    assert store.commit(seen, theirs) == 2
    with pytest.raises(Conflict):
        store.commit(seen, mine)
    assert rows(store.read("t")) == [(1, "theirs")]
    # a writer that died after taking the number, before naming a manifest, has committed nothing
    store._create(f"_log/{3:012d}", "")
    assert rows(store.read("t")) == [(1, "theirs")] and store.latest()[0] == 2
    with pytest.raises(Conflict):
        store.commit(2, mine)
    assert store.drop_unfinished() == 1 and store.commit(2, mine) == 3 and rows(store.read("t")) == [(1, "mine")]


def test_cascade_nulls_and_deletes(spark, T_small):
    from innkeep.registry import registry
    out = registry()["cascade_tables_after"][0](T_small)
    assert {r[0] for r in out.select("table_name").distinct().collect()} == {"customer", "auth_account", "booking", "renting", "archive"}
