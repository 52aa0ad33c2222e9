"""Atomic snapshots and leases: readers between any two steps, crashes, replays, and holders that lost their lease."""

import json

import pytest

from noteloom.sources import lease, snapshots
from noteloom.sources.sinks import LockHeld

SHAPE = "k int, v string, tenant_id string, bucket int, run string"


def rows(spark, items):
    return spark.createDataFrame(items, "k int, v string, tenant_id string, bucket int")


def seen(table, snapshot=None):
    return sorted((r.k, r.v, r.tenant_id, r.bucket) for r in table.read(snapshot or table.current(), "points", SHAPE).collect())


def test_readers_see_a_whole_old_or_a_whole_new_state(spark, tmp_path):
    table = snapshots.Snapshots(spark, str(tmp_path / "t"))
    assert table.current() is None and seen(table) == []
    old = [(1, "a", "x y", 0), (2, "b", "007", 1), (3, "c", "x=/%", 0)]
    parts = table.stage(rows(spark, old), "points", ["tenant_id", "bucket"], snapshots.new_run(1))
    assert seen(table) == [] and len(parts) == 3  # staged is not seen
    first = table.commit(None, {"points": parts}, fence=1)
    assert seen(table) == sorted(old)
    assert [r.k for r in table.read(first, "points", SHAPE, tenant_id=["x=/%"]).collect()] == [3]
    assert [r.tenant_id for r in table.read(first, "points", SHAPE, tenant_id=["007"], bucket=[1]).collect()] == ["007"]
    reader = table.read(first, "points", SHAPE)
    # A run that dies after any step but the last leaves the old state.
    more = table.stage(rows(spark, [(1, "new", "x y", 0)]), "points", ["tenant_id", "bucket"], snapshots.new_run(2))
    assert seen(table) == sorted(old)
    kept = [p for p in first.tables["points"] if p not in first.parts("points", tenant_id=["x y"])]

    def dies():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.commit(first, {"points": kept + more}, fence=1, check=dies)
    assert seen(table) == sorted(old) and table.current().number == 1
    # The replay gets another number and ends in the same state as one run.
    again = table.stage(rows(spark, [(1, "new", "x y", 0)]), "points", ["tenant_id", "bucket"], snapshots.new_run(3))
    second = table.commit(first, {"points": kept + again}, fence=2)
    new = [(1, "new", "x y", 0), *old[1:]]
    assert (second.number, second.parent) == (3, 1) and seen(table) == sorted(new)
    assert sorted((r.k, r.v) for r in reader.collect()) == [(1, "a"), (2, "b"), (3, "c")] and seen(table, table.at(1)) == sorted(old)
    with pytest.raises(snapshots.Conflict):
        table.commit(first, {"points": []}, fence=3)  # started from an old state
    with pytest.raises(snapshots.Conflict):
        table.commit(second, {"points": []}, fence=1)  # holds an old lease
    gone = table.expire(keep=1)
    assert any("run=00000002" in g for g in gone) and seen(table) == sorted(new) and table.numbers() == [3]
    with pytest.raises(ValueError):
        table.at(1)
    assert table.expire(keep=1) == []


def test_a_lease_holds_between_runs_and_fences(spark, tmp_path):
    now = [1000.0]
    clock = lambda: now[0]
    root = str(tmp_path / "locks")
    one = lease.acquire(spark, root, "table", "t", ttl=60, clock=clock)
    with pytest.raises(LockHeld):
        lease.acquire(spark, root, "table", "t", ttl=60, clock=clock)
    other = lease.acquire(spark, root, "table", "u", ttl=60, clock=clock)
    other.release()
    now[0] += 50
    one.renew()
    now[0] += 50
    one.check()
    with pytest.raises(LockHeld):
        lease.acquire(spark, root, "table", "t", ttl=60, clock=clock)
    now[0] += 70  # it slept
    two = lease.acquire(spark, root, "table", "t", ttl=60, clock=clock)
    assert two.number == one.number + 1
    for broken in (one.check, one.renew):
        with pytest.raises(lease.LeaseLost):
            broken()
    # The clock of the first says that its time is not over, but another run has the lease.
    one.until = now[0] + 100
    with pytest.raises(lease.LeaseLost):
        one.check()
    one.release()
    two.check()
    table = snapshots.Snapshots(spark, str(tmp_path / "t"))
    with pytest.raises(lease.LeaseLost):
        table.commit(None, {}, one.number, check=one.check)
    assert table.current() is None
    table.commit(None, {}, two.number, check=two.check)
    assert table.current().fence == two.number
    two.release()
    three = lease.acquire(spark, root, "table", "t", ttl=60, clock=clock)
    assert three.number == two.number + 1
    # One that has no content yet was just created.
    (tmp_path / "locks" / f"{three.scope}.{three.number + 1:012d}").write_text("")
    with pytest.raises(LockHeld):
        lease.acquire(spark, root, "table", "t", ttl=60, clock=clock)


def test_a_lease_is_renewed_until_it_is_released(spark, tmp_path):
    import time

    with lease.held(spark, str(tmp_path), "a", ttl=2.4) as own:
        time.sleep(3.5)
        own.until = max(own.until, time.time() + lease.SLACK + 1)
        with pytest.raises(LockHeld):
            lease.acquire(spark, str(tmp_path), "a")
        said = json.loads(own.folder.read(own.name))
        assert said["holder"] == own.holder
    with lease.held(spark, str(tmp_path), "a") as again:
        assert again.number == own.number + 1
