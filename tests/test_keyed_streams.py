"""Keyed stream operators replayed in portions and across restarts, against loops over the same rows."""

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from foliant.streaming import keyed

BEGIN = datetime(2024, 3, 9, 20, 0)


@pytest.fixture
def replay(spark, tmp_path):
    """Writes portions as files, runs the stream until they are read, and begins again from its checkpoint for each group of portions."""

    def run(operator, schema, groups):
        where, n = tmp_path / "in", 0
        for portions in groups:
            for rows in portions:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/{n:03d}")
                n += 1
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/*")
            out = operator(source)
            with keyed.state_with_timers(spark):
                q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
                q.awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()

    return run


def test_a_batch_is_told_of_once_across_restarts(replay):
    hour = lambda h: BEGIN + timedelta(hours=h)
    first = [(1, 10, False, 2, hour(0)), (1, 10, True, 2, hour(1)), (2, 20, True, 1, hour(1)), (3, 30, False, 1, hour(1)), (None, 1, True, 1, hour(1)), (6, 60, True, 1, None), (7, None, None, None, hour(1))]
    second = [(1, 11, True, 2, hour(2)), (2, 20, True, 1, hour(2)), (4, 40, True, 3, hour(2)), (4, 40, True, 3, hour(2))]
    late = [(1, 11, True, 2, hour(3)), (1, 11, False, 2, hour(3)), (3, 30, False, 1, hour(3)), (5, 50, True, None, hour(30))]
    last = [(4, 41, False, 3, hour(31)), (4, 41, True, 3, hour(31)), (4, 42, True, 3, hour(31)), (2, 20, True, 1, hour(31))]
    schema = "batch_id long, run_id long, ended boolean, expected long, at timestamp"
    out = replay(lambda s: keyed.completed_once(s, 10 * 3600, 1000 * 3600, "1 minute"), schema, [[first, second], [late], [last]])
    told = sorted((r.batch_id, r.notice, r.runs, r.open) for r in out)
    assert told == [(1, "complete", 2, 0), (2, "complete", 1, 0), (3, "overdue", 1, 1), (4, "complete", 3, 0), (4, "overdue", 1, 0), (7, "overdue", 0, 0)]


def test_notices_of_nothing(replay):
    assert replay(lambda s: keyed.completed_once(s, 10, 10), "batch_id long, run_id long, ended boolean, expected long, at timestamp", [[[]]]) == []


@pytest.mark.parametrize("seed", range(2))
def test_once_per_spell_is_the_loop(replay, seed):
    rng = random.Random(seed)
    rows, at = [], BEGIN
    for token in range(120):
        at += timedelta(seconds=rng.choice([0, 1, 30, 100, 400]))
        rows.append((rng.randint(0, 3), token, at))
    want, last = set(), {}
    for run, token, t in rows:
        if run not in last or t >= last[run] + timedelta(seconds=300):
            last[run] = t
            want.add((run, token))
    cut = sorted(rng.sample(range(1, 119), 3))
    portions = [rows[a:b] for a, b in zip([0, *cut], [*cut, 120], strict=True)]
    for p in portions:
        rng.shuffle(p)
    bad = [(None, 1, BEGIN), (1, None, BEGIN), (1, 1, None)]
    out = replay(lambda s: keyed.once_per_spell(s, 300, "1 second"), "run_id long, token long, at timestamp", [portions[:2], [portions[2] + bad], portions[3:]])
    assert {(r.run_id, r.token) for r in out} == want and len(out) == len(want)


def test_days_end_at_local_midnight_also_when_clocks_change(replay):
    zone = ZoneInfo("America/New_York")
    rows = [(1, k, BEGIN + timedelta(minutes=61 * k)) for k in range(60)]
    seen, want = {}, {}
    for user, token, t in rows:
        day = t.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).date()
        seen[day] = seen.get(day, 0) + 1
        want[token] = seen[day] <= 5
    assert len(seen) == 4
    out = replay(lambda s: keyed.daily_quota(s, 5, "America/New_York", "1 second"), "user_id long, token long, at timestamp", [[rows[:7], rows[7:20]], [rows[20:]]])
    assert {r.token: r.allowed for r in out} == want and len(out) == 60


def test_a_new_batch_asks_the_store_little():
    """Each call goes to the executor's JVM; a batch with three runs took two dozen."""
    from types import SimpleNamespace

    from foliant.streaming.keyed import _CompletedOnce

    calls, held = [], {}

    class Store:
        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name == "update":
                    held["v"] = a[0]
                return {"get": held.get("v"), "exists": "v" in held, "containsKey": False, "listTimers": []}.get(name)

            return call

    class Handle(Store):
        def getMapState(self, *a):
            return Store()

        getValueState = getMapState

    p = _CompletedOnce(1000, 7000)
    p.init(Handle())
    rows = [SimpleNamespace(run_id=k % 3, ended=k > 2, expected=3, ms=k) for k in range(6)]
    out = list(p.handleInputRows((7,), iter(rows), None))
    assert [tuple(r) for r in out] == [(7, "complete", 3, 0)] and len(calls) <= 3
    assert list(p.handleInputRows((7,), iter(rows), None)) == [] and len(calls) <= 4
