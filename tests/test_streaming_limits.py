"""Stateful streams over two runs of one checkpoint: limits go on, silent users' state goes, deferred deliveries come out at their time."""

import random
import time
from datetime import datetime, timedelta

from gleaner.streaming import limits

START = datetime(2024, 1, 1)


class Stream:
    """A folder of Parquet files read as a stream; each run handles what has landed since the run before."""

    def __init__(self, spark, tmp_path, kind):
        self.spark, self.path, self.kind, self.n = spark, tmp_path, kind, 0
        (tmp_path / "in").mkdir()

    def land(self, rows):
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(str(self.path / "in"))

    def run(self, transform):
        """What comes out in this run."""
        before, out = {tuple(r) for r in self.out()}, None
        source = self.spark.readStream.schema(self.kind).parquet(str(self.path / "in"))
        with limits.rocksdb(self.spark):
            writer = transform(source).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "state"))
            writer.trigger(once=True).start().awaitTermination(60)
        out = [tuple(r) for r in self.out()]
        return [r for r in out if r not in before]

    def out(self):
        return self.spark.read.parquet(str(self.path / "out")).collect() if (self.path / "out").exists() else []


CANDIDATES = "user_id long, order_id long, ts timestamp, duplicate_fingerprint string"


def decisions(found):
    return {r[1]: r[3] for r in found}


def test_limit_and_cooldown_go_on_in_the_next_run(spark, tmp_path):
    stream = Stream(spark, tmp_path, CANDIDATES)
    at = lambda m: START + timedelta(minutes=m)
    limited = lambda s: limits.limit_deliveries(s, 60, 3, cooldown=30)
    stream.land([(1, 10, at(0), "a"), (1, 11, at(5), "a"), (1, 12, at(6), "b"), (2, 20, at(0), None), (2, 21, at(1), None)])
    assert decisions(stream.run(limited)) == {10: "send", 11: "similar_recently", 12: "send", 20: "send", 21: "send"}
    stream.land([(1, 13, at(10), "b"), (1, 14, at(20), "c"), (1, 15, at(21), "d"), (1, 16, at(61), "a"), (2, 22, at(2), None), (2, 23, at(3), None)])
    assert decisions(stream.run(limited)) == {13: "similar_recently", 14: "send", 15: "rate_limited", 16: "send", 22: "send", 23: "rate_limited"}


def test_state_of_silent_users_goes(spark, tmp_path):
    stream = Stream(spark, tmp_path, CANDIDATES)
    limited = lambda s: limits.limit_deliveries(s, 60, 1, expiry_minutes=2 / 60)
    stream.land([(1, 10, START, "a"), (1, 11, START, "b")])
    assert decisions(stream.run(limited)) == {10: "send", 11: "rate_limited"}
    time.sleep(3)
    stream.land([(1, 12, START, "c"), (2, 20, START, "c")])
    assert decisions(stream.run(limited)) == {12: "send", 20: "send"}  # with its state, user 1 would be held back


def test_as_decided_one_by_one(spark, tmp_path):
    draw = random.Random(2)
    rows = [(draw.randrange(9), i, START + timedelta(minutes=draw.randrange(600)), draw.choice(["a", "b", "c", None])) for i in range(300)]
    stream, want, passed = Stream(spark, tmp_path, CANDIDATES), {}, {}
    stream.land(rows)
    for u, o, t, mark in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        mine = passed.setdefault(u, [])
        if sum(p >= t - timedelta(minutes=90) for p, _ in mine) >= 4:
            want[o] = "rate_limited"
        elif mark is not None and any(m == mark and p >= t - timedelta(minutes=45) for p, m in mine):
            want[o] = "similar_recently"
        else:
            want[o] = "send"
            mine.append((t, mark))
    assert decisions(stream.run(lambda s: limits.limit_deliveries(s, 90, 4, cooldown=45))) == want


def test_deferred_deliveries_come_out_at_their_time(spark, tmp_path):
    stream = Stream(spark, tmp_path, "delivery_id long, order_id long, user_id long, scheduled_for timestamp")
    users = spark.createDataFrame([(1, True), (2, False)], "user_id long, is_active boolean")
    notifiable = spark.createDataFrame([(100,), (101,), (103,)], "order_id long")
    release = lambda s: limits.timed_release(s, notifiable, users)
    soon, late = datetime.now() + timedelta(seconds=20), datetime.now() + timedelta(days=1)
    stream.land([(1, 100, 1, START), (2, 101, 1, soon), (3, 102, 1, soon), (4, 101, 2, soon), (5, 103, 1, late), (6, 103, 1, None)])
    assert [(r[0], r[4]) for r in stream.run(release)] == [("1", "send")]
    stream.land([(7, 103, 1, late)])
    assert stream.run(release) == []
    time.sleep(max(0, (soon - datetime.now()).total_seconds()) + 1)
    stream.land([(8, 100, 1, START)])
    assert sorted((r[0], r[4]) for r in stream.run(release)) == [("2", "send"), ("3", "skipped"), ("4", "skipped"), ("8", "send")]


def test_many_deliveries_share_a_group_and_its_timer(spark, tmp_path):
    stream = Stream(spark, tmp_path, "delivery_id long, order_id long, user_id long, scheduled_for timestamp")
    users, notifiable = spark.createDataFrame([(1, True)], "user_id long, is_active boolean"), spark.createDataFrame([(100,)], "order_id long")
    release = lambda s: limits.timed_release(s, notifiable, users, groups=2)
    late = datetime.now() + timedelta(days=1)
    stream.land([(i, 100, 1, START if i % 3 else late) for i in range(300)])
    assert len(stream.run(release)) == 200
    stream.land([(i, 100, 1, START) for i in range(0, 90, 3)])  # waiting ones that are put in again, due by now
    assert sorted(int(r[0]) for r in stream.run(release)) == list(range(0, 90, 3))
