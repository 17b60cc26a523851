"""Streams over several files: silences, expiring dedup, and batches that run again."""

import datetime as dt
import shutil

from millrace.streaming import events as E

START = dt.datetime(2024, 1, 1)


def put(spark, folder, name, rows):
    """One file of events (id, minutes, user, type)."""
    made = [(i, START + dt.timedelta(minutes=m), u, k, 1.0, "p") for i, m, u, k in rows]
    spark.createDataFrame(made, E.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def files(spark, tmp_path, *batches):
    """Batches as the parts of one table, in the order of their names."""
    for n, rows in enumerate(batches):
        put(spark, f"{tmp_path}/made{n}", "events", rows)
        target = tmp_path / "data" / "events.parquet"
        target.mkdir(parents=True, exist_ok=True)
        part = next((tmp_path / f"made{n}" / "events.parquet").glob("part-*.parquet"))
        shutil.copy(part, target / f"part-{n:03d}.parquet")
    return f"file://{tmp_path}/data"


def run(spark, df, tmp_path, label, mode="append"):
    with E.rocksdb(spark):
        return E.drained(df, mode, f"file://{tmp_path}", label)


def test_a_silent_user_is_reported_once_per_silence(spark, tmp_path):
    # User 1 is silent when the third file comes, back with the fourth, and silent with user 2 at the end.
    folder = files(spark, tmp_path, [(1, 0, 1, "a"), (2, 5, 2, "a")], [(3, 30, 2, "a")], [(4, 45, 2, "a")], [(5, 60, 1, "a"), (6, 61, 2, "a")], [(7, 100, 3, "a"), (8, 1, None, "a")])
    found = run(spark, E.silent(E.stream(spark, folder, "events"), 20 * 60), tmp_path, "silent")
    assert sorted((r.user_id, int((r.last_ts - START).total_seconds() // 60)) for r in found.collect()) == [(1, 0), (1, 60), (2, 61)]
    seen = run(spark, E.last_seen(E.stream(spark, folder, "events")), tmp_path, "seen", "complete")
    from pyspark.sql import functions as F

    late = E.stale(seen, F.lit(START + dt.timedelta(minutes=101)), 20 * 60)
    assert sorted(r.user_id for r in late.where("user_id is not null").collect()) == [1, 2]


def test_keys_are_forgotten_after_a_while(spark, tmp_path):
    folder = files(spark, tmp_path, [(1, 0, 1, "a"), (2, 1, 1, "a")], [(3, 5, 1, "a"), (4, 6, 2, "b")], [(5, 200, 3, "c")], [(8, 201, 3, "c")], [(6, 210, 1, "a"), (7, 211, 3, "c")])
    recent = E.unique_recent(E.stream(spark, folder, "events"), ["user_id", "event_type"], "30 minutes")
    found = run(spark, recent.select("event_id", "user_id", "event_type"), tmp_path, "recent").collect()
    assert sorted((r.user_id, r.event_type) for r in found) == [(1, "a"), (1, "a"), (2, "b"), (3, "c")]
    all_time = run(spark, E.unique_payloads(E.stream(spark, folder, "events")).select("event_type"), tmp_path, "all").collect()
    assert sorted(r.event_type for r in all_time) == ["a", "b", "c"]


def test_a_second_run_adds_nothing(spark, tmp_path):
    folder = files(spark, tmp_path, [(1, 0, 1, "a")], [(2, 5, 1, "a"), (3, 6, 2, "b")])
    for _ in range(2):  # the second finds its checkpoint and no new file
        found = run(spark, E.replay(E.stream(spark, folder, "events"), 1).select("event_id"), tmp_path, "again")
        assert sorted(r.event_id for r in found.collect()) == [2, 3]
