"""Commits of a frame store by several writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from lingmill.sources.stores import Conflict, FrameStore
from lingmill.stages import scratch

FIELDS = "frame string, slot string, facet string, pos int, filler string"


def frames(spark, *names):
    return spark.createDataFrame([(n, "isA", "value", 0, "thing") for n in names], FIELDS)


def names(store, generation=-1):
    return sorted(r.frame for r in store.names(generation).collect())


def test_an_old_base_is_refused_and_an_update_is_made_again(spark):
    a = FrameStore(spark, scratch(spark, "frames"))
    assert a.generations() == [] and a.commit(frames(spark, "x")) == 0
    b = FrameStore(spark, a.path)
    assert a.commit(frames(spark, "x", "y"), base=0) == 1
    with pytest.raises(Conflict):
        b.commit(frames(spark, "x", "z"), base=0)
    assert names(a) == ["x", "y"] and a.generations() == [0, 1]

    calls = []

    def change(rows):
        if not calls:
            a.create(frames(spark, "first"))
        calls.append(1)
        return rows.unionByName(frames(spark, "second"))

    assert b.update(change) == 3 and len(calls) == 2
    assert names(b) == ["first", "second", "x", "y"] and names(b, 0) == ["x"]
    with pytest.raises(Conflict):
        b.update(lambda rows: (a.delete("y"), rows)[1], tries=1)


def test_no_writer_at_once_is_lost(spark):
    path = scratch(spark, "frames")
    FrameStore(spark, path).commit(frames(spark, "root"))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: FrameStore(spark, path).create(frames(spark, f"f{k}")), range(3)))
    store = FrameStore(spark, path)
    assert names(store) == ["f0", "f1", "f2", "root"] and store.generations() == [0, 1, 2, 3]


def test_a_claim_of_a_dead_writer(spark):
    from lingmill.stages import _hadoop

    store = FrameStore(spark, scratch(spark, "frames"))
    store.commit(frames(spark, "x"))
    claim, files = _hadoop(spark, f"{store.path}/g=1.claimed")
    files.create(claim, False).close()
    with pytest.raises(Conflict):
        store.update(lambda rows: rows, tries=2)
    assert store.commit(frames(spark, "x", "y")) == 2 and names(store) == ["x", "y"] and names(store, 2) == ["x", "y"]
    assert not store.release(2) and store.generations() == [0, 2]
    with pytest.raises(Conflict):
        store.commit(frames(spark, "lost"), base=0)
    assert store.release(1) and not store.release(1)
