"""The log sync with state bounded by event time."""

import datetime as dt

import pytest

from formbook.streaming import sync

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KIND = "event_id long, at timestamp, v string"


def rows(spark, *events):
    return spark.createDataFrame([(i, None if m is None else START + dt.timedelta(minutes=m), v) for i, m, v in events], KIND)


@pytest.fixture()
def job(spark, tmp_dir):
    schema = rows(spark).schema
    args = dict(source=f"{tmp_dir}/in", schema=schema, target=f"{tmp_dir}/out", checkpoint=f"{tmp_dir}/check", event_time="at")

    def deliver(*events, **more):
        if events:
            rows(spark, *events).write.mode("append").parquet(f"{tmp_dir}/in")
        return sync.sync_by_event_time(spark, **args, **more)

    def held():
        return sorted(r.event_id for r in sync.read_synced(spark, args["target"], schema).collect())
    return deliver, held, args


def test_late_and_repeated_events_end_up_once(job):
    deliver, held, _ = job
    first = deliver((1, 0, "a"), (2, 100, "b"), (2, 100, "b"), (3, 300, "c"))
    assert held() == [1, 2, 3] and (first.taken, first.behind, first.settled) == (4, 0, 0)
    assert first.watermark == START + dt.timedelta(minutes=240)
    second = deliver((1, 0, "a"), (3, 300, "c"), (4, 10, "late"), (5, 250, "in time"), (6, 600, "d"))
    assert held() == [1, 2, 3, 4, 5, 6]
    assert (second.taken, second.behind, second.settled) == (5, 2, 1)  # 1 again and 4; 4 is new
    third = deliver()
    assert held() == [1, 2, 3, 4, 5, 6] and (third.taken, third.behind, third.settled) == (0, 0, 0)
    deliver((4, 10, "late"), (4, 10, "late"), (7, 11, "late"), (7, 11, "late"))
    assert held() == [1, 2, 3, 4, 5, 6, 7]


def test_events_without_time(job):
    deliver, held, _ = job
    done = deliver((1, None, "a"), (1, None, "a"), (2, 5, "b"))
    assert held() == [1, 2] and (done.behind, done.settled) == (2, 1)
    deliver((1, None, "a"), (3, 500, "c"))
    assert held() == [1, 2, 3]


def test_a_call_that_died_before_settling_is_made_good(job, monkeypatch):
    deliver, held, _ = job
    deliver((1, 0, "a"), (2, 300, "b"))

    def die(*args, **more):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(sync, "settle_behind", die)
        with pytest.raises(RuntimeError):
            deliver((3, 1, "late"), (4, 400, "d"))
    assert held() == [1, 2, 4]
    assert deliver().settled == 1 and held() == [1, 2, 3, 4]
    assert deliver().settled == 0


def test_settling_put_off(job):
    deliver, held, _ = job
    deliver((1, 0, "a"), (2, 300, "b"))
    assert deliver((3, 1, "late"), settle=False).settled == 0 and held() == [1, 2]
    assert deliver().settled == 1 and held() == [1, 2, 3]


def test_nothing_landed(spark, tmp_dir):
    assert sync.read_synced(spark, f"{tmp_dir}/none", rows(spark).schema).count() == 0
