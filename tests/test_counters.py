"""Usage within a period against a plain walk over each key's snapshots."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

from opsgauge.operators.counters import usage_between
from tests.helpers import executed, rows

START = datetime(2024, 1, 1)
SCHEMA = "server string, object_id long, snapshot_ts timestamp_ntz, stats_since timestamp_ntz, reads long, writes long"
KEYS, COUNTERS = ("server", "object_id"), ("reads", "writes")


def _day(number):
    return START + timedelta(days=number)


def _usage(spark, snapshots, since, until, bucket="2 days"):
    df = spark.createDataFrame(snapshots, SCHEMA)
    return usage_between(df, since, until, KEYS, COUNTERS, bucket)


def _plain(snapshots, since, until):
    seen = {(row[0], row[3]) for row in snapshots if row[2] <= since}
    found = {}
    for key in sorted({row[:2] for row in snapshots}):
        own = sorted((row[2:] for row in snapshots if row[:2] == key), key=lambda row: row[0])
        prior = max((row for row in own if row[0] <= since), key=lambda row: row[0], default=None)
        inside = [row for row in own if since < row[0] <= until]
        if prior is None and not inside:
            continue
        total, resets, begin = [0, 0], 0, since
        if prior is None:
            first = inside.pop(0)
            if first[1] > since or (key[0], first[1]) in seen:
                total = list(first[2:])
            else:
                begin = first[0]
            prior = first
        for row in inside:
            reset = row[1] > prior[1] or any(new < old for new, old in zip(row[2:], prior[2:], strict=True))
            resets += reset
            for at in range(2):
                total[at] += row[2 + at] if reset else row[2 + at] - prior[2 + at]
            prior = row
        found[key] = (*total, begin, resets)
    return sorted([(*key, *value) for key, value in found.items()], key=repr)


def test_random_snapshots(spark):
    random.seed(3)
    snapshots = []
    for server in ("a", "b", "c"):
        restarts = sorted(random.sample(range(30), 3))
        for key in range(12):
            counts = [0, 0]
            for hour in sorted(random.sample(range(1, 30 * 24), random.randrange(1, 30))):
                at = START + timedelta(hours=hour)
                epoch = max((day for day in restarts if _day(day) <= at), default=-5)
                if snapshots and snapshots[-1][:2] == (server, key) and snapshots[-1][3] != _day(epoch):
                    counts = [0, 0]
                elif random.random() < 0.1:
                    counts = [0, 0]  # set back without a restart
                counts = [n + random.randrange(5) for n in counts]
                snapshots.append((server, key, at, _day(epoch), *counts))
    for since, until in ((_day(5), _day(25)), (_day(-1), _day(40)), (_day(12), _day(13))):
        for bucket in ("1 day", "10 days"):
            assert rows(_usage(spark, snapshots, since, until, bucket)) == _plain(snapshots, since, until)


def test_an_index_without_any_use_stays_in_the_result(spark):
    snapshots = [("a", 1, _day(1), _day(0), 5, 5), ("a", 1, _day(9), _day(0), 5, 5)]
    assert rows(_usage(spark, snapshots, _day(2), _day(20))) == [("a", 1, 0, 0, _day(2), 0)]
    # Seen before the period only: nothing was counted since.
    assert rows(_usage(spark, snapshots[:1], _day(2), _day(20))) == [("a", 1, 0, 0, _day(2), 0)]


def test_a_short_history_says_where_it_begins(spark):
    snapshots = [("a", 1, _day(5), _day(0), 50, 5), ("a", 1, _day(6), _day(0), 53, 5)]
    assert rows(_usage(spark, snapshots, _day(2), _day(20))) == [("a", 1, 3, 0, _day(5), 0)]
    assert rows(_usage(spark, [], _day(2), _day(20))) == []


def test_a_key_is_sorted_in_buckets_only(spark):
    plan = executed(_usage(spark, [("a", 1, _day(1), _day(0), 5, 5)], _day(0), _day(20)))
    assert "Python" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_task_holds_a_table_of_buckets(spark):
    plan = executed(_usage(spark, [("a", 1, _day(1), _day(0), 5, 5), ("a", 1, _day(2), _day(0), 6, 6)], _day(0), _day(20)))
    assert "bucket" in plan and not re.search(r"Aggregate\(keys=\[[^\]]*bucket", plan)
