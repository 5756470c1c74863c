"""The stored status of units: scans, marks and runs that go on where the last one stopped."""

from __future__ import annotations

import glob
import os
from datetime import datetime

from pyspark.sql import functions as F

from opsgauge.operators import UNIT
from opsgauge.operators import maintenance as m
from opsgauge.session import working_path
from opsgauge.sources import status as store
from tests.helpers import rows

SCAN = (
    "server string, database_id int, object_id long, index_id int, partition_number long, range_scan_count long, "
    "fragmentation double, page_count long, exclusionMask int, defragDate timestamp_ntz, printStatus boolean"
)
AT = datetime(2024, 1, 7, 1)


def _scan(spark, units):
    data = [(server, base, unit, 1, 1, 5, 50.0, 20, 0, None, False) for server, base, unit in units]
    return spark.createDataFrame(data, SCAN)


def _events(spark, events):
    data = [(server, base, unit, 1, 1, event, at) for server, base, unit, event, at in events]
    return spark.createDataFrame(
        data, "server string, database_id int, object_id long, index_id int, partition_number long, event string, event_ts timestamp_ntz"
    )


def _state(spark, path):
    return rows(store.current_status(spark, path), "server", "database_id", "object_id", "defragDate", "printStatus")


UNITS = [("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 4)]


def test_marks_reach_their_units_and_can_be_repeated(spark):
    path = working_path(spark, "status")
    assert store.last_scan(spark, path) is None and store.current_status(spark, path) is None
    store.store_scan(_scan(spark, UNITS), path, AT)
    assert store.last_scan(spark, path) == AT
    done, later = datetime(2024, 1, 7, 2), datetime(2024, 1, 7, 3)
    events = _events(
        spark,
        [
            ("a", 1, 1, "finished", done),
            ("a", 1, 1, "started", later),
            ("a", 1, 2, "printed", done),
            ("b", 1, 4, "failed", done),
            ("b", 1, 4, "finished", later),
            ("b", 1, 9, "finished", later),
        ],
    )
    files = {f for f in glob.glob(f"{path}/units/**/*.parquet", recursive=True) if "/server=a/database_id=2/" in f}
    times = {f: os.path.getmtime(f) for f in files}
    for _ in range(2):
        store.mark_units(events, path)
        assert _state(spark, path) == sorted(
            [("a", 1, 1, done, True), ("a", 1, 2, None, True), ("a", 2, 3, None, False), ("b", 1, 4, later, True)], key=repr
        )
    # A database without events was not written again.
    assert files and times == {f: os.path.getmtime(f) for f in files}


def test_a_new_scan_replaces_the_status_and_old_events_do_not_reach_it(spark):
    path = working_path(spark, "status")
    store.store_scan(_scan(spark, UNITS), path, AT)
    later = datetime(2024, 1, 8)
    store.store_scan(_scan(spark, UNITS[:1]), path, later)
    store.mark_units(_events(spark, [("a", 1, 1, "finished", datetime(2024, 1, 7, 9))]), path)
    assert _state(spark, path) == [("a", 1, 1, None, False)]
    # A scan that finds nothing leaves nothing to do.
    store.store_scan(_scan(spark, []), path, datetime(2024, 1, 9))
    assert store.current_status(spark, path).count() == 0
    assert m.needs_rescan(store.current_status(spark, path))


def test_a_scan_that_failed_midway_is_not_read(spark):
    path = working_path(spark, "status")
    store.store_scan(_scan(spark, UNITS), path, AT)
    units = _scan(spark, UNITS[:2]).withColumns(
        {"scan": F.lit("20240109000000000000"), "scanDate": F.lit(None).cast("timestamp_ntz")}
    )
    store._write(units, path)
    assert len(_state(spark, path)) == 4
    # Repeating it completes it.
    store.store_scan(_scan(spark, UNITS[:2]), path, datetime(2024, 1, 9))
    assert len(_state(spark, path)) == 2


def test_marks_without_a_scan_change_nothing(spark):
    path = working_path(spark, "status")
    store.mark_units(_events(spark, [("a", 1, 1, "finished", AT)]), path)
    assert store.current_status(spark, path) is None


def test_unknown_events_give_no_status(spark):
    log = _events(spark, [("a", 1, 1, "queued", AT), ("a", 1, 2, "started", AT), ("a", 1, 2, "failed", AT)])
    log = log.withColumns({"run_id": F.lit("r"), "error_message": F.lit("e")})
    got = m.maintenance_state(log)
    assert rows(got, "object_id", "status", "durationSeconds", "errorMessage") == sorted(
        [(1, None, None, None), (2, "FAILED", -1, "e")], key=repr
    )
    assert rows(m.to_retry(log, UNIT), "object_id") == [(2,)]
