"""Latency by subscription, numbered and summed up, in batch and stream."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsgauge.operators import latency
from opsgauge.session import working_path
from opsgauge.streaming.latency import ProbeParams, stream_latency, stream_session
from opsgauge.streaming.numbering import numbered_latency
from tests.helpers import rows

START = datetime(2024, 1, 1)
POSTS = "server string, publication string, tracer_id long, post_ts {0}"
RECEIPTS = (
    "server string, publication string, tracer_id long, subscriber string, subscriber_db string, "
    "distributor_ts {0}, subscriber_ts {0}"
)
SUBSCRIPTIONS = "server string, publication string, subscriber string, subscriber_db string"


def _at(seconds):
    return START + timedelta(seconds=seconds)


def _inputs(spark, kind):
    """Ten tokens a minute apart; ``a`` receives all, ``b`` stops after four, ``x`` is not listed."""
    posts = [("e", "p", at, _at(60 * at)) for at in range(10)] + [("e", "q", 1, _at(30)), ("w", "p", 7, _at(90))]
    receipts = [("e", "p", at, "a", None, _at(60 * at), _at(60 * at + 1)) for at in range(10)]
    receipts += [("e", "p", at, "b", "d", _at(60 * at), _at(60 * at + 2)) for at in range(4)]
    receipts += [("e", "p", 5, "x", "d", _at(301), _at(302)), ("e", "q", 1, "y", "d", _at(31), _at(33))]
    subscriptions = [("e", "p", "a", None), ("e", "p", "b", "d"), ("e", "p", "b", "d"), ("w", "p", "a", "d")]
    return (
        spark.createDataFrame(posts, POSTS.format(kind)),
        spark.createDataFrame(receipts, RECEIPTS.format(kind)),
        spark.createDataFrame(subscriptions, SUBSCRIPTIONS),
    )


EXPECTED = sorted(
    [("e", "p", at, "a", None, 1) for at in range(10)]
    + [("e", "p", at, "b", "d", 2 if at < 4 else None) for at in range(10)]
    + [("e", "q", 1, "y", "d", 3), ("w", "p", 7, "a", "d", None)],
    key=repr,
)
SHOWN = ("server", "publication", "tracer_id", "subscriber", "subscriber_db", "overall_latency")


def test_a_subscriber_that_stops_is_seen_among_others(spark):
    got = latency.token_latency(*_inputs(spark, "timestamp_ntz"))
    assert rows(got, *SHOWN) == EXPECTED
    assert {row.iteration for row in got.where("publication = 'p' AND server = 'e'").collect()} == set(range(1, 11))


def test_without_a_list_the_seen_subscriptions_can_be_taken(spark):
    posts, receipts, _ = _inputs(spark, "timestamp_ntz")
    seen = latency.subscriptions_seen(receipts)
    assert rows(seen) == sorted([("e", "p", "a", None), ("e", "p", "b", "d"), ("e", "p", "x", "d"), ("e", "q", "y", "d")], key=repr)
    got = latency.token_latency(posts, receipts, seen)
    assert got.where("subscriber = 'x' AND overall_latency IS NULL").count() == 9


def _write(folder, name, df, files):
    """Rows in files that are read one by one."""
    listed = df.collect()
    for at in range(files):
        part = df.sparkSession.createDataFrame(listed[at::files], df.schema).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/{name}")


def _run(session, folder, transform, subscriptions, params, per_trigger):
    streams = {}
    for name in ("posts", "receipts"):
        schema = session.read.parquet(f"{folder}/{name}").schema
        reader = session.readStream.schema(schema)
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        streams[name] = reader.parquet(f"{folder}/{name}")
    query = (
        transform(stream_latency(**streams, params=params, subscriptions=subscriptions))
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    query.awaitTermination()


def _stream_inputs(spark):
    posts, receipts, subscriptions = _inputs(spark, "timestamp")
    end = spark.createDataFrame([("", "", -1, _at(36000)), ("", "", -2, _at(72000))], posts.schema)
    return posts.union(end), receipts.withColumn("seen_ts", F.col("subscriber_ts")), subscriptions


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_streamed_subscriptions_and_numbers_equal_the_batch(spark, per_trigger):
    """Whatever the batches: ``lateness`` covers how far files are out of order."""
    folder = working_path(spark, "numbered")
    params = ProbeParams(lateness="2 hours", bounded=True, state_partitions=2)
    session = stream_session(spark, params)
    posts, receipts, subscriptions = _stream_inputs(spark)
    listed = posts.where("server <> ''")
    _write(folder, "posts", listed, 3)
    _write(folder, "receipts", receipts, 2)
    _run(session, folder, numbered_latency, subscriptions, params, per_trigger)
    # A restart: what waited goes on with the state of the first run.
    _write(folder, "posts", posts.where("server = ''"), 2)
    _run(session, folder, numbered_latency, subscriptions, params, per_trigger)
    got = spark.read.parquet(f"{folder}/out").where("server <> ''")
    expected = latency.token_latency(*_inputs(spark, "timestamp_ntz"))
    names = ["server", "publication", "iteration", *SHOWN[2:]]
    assert rows(got, *names) == rows(expected, *names)
    assert rows(got, "tracer_id", "post_ts") == rows(
        expected.join(_inputs(spark, "timestamp")[0], list(latency.TOKEN)), "tracer_id", "post_ts"
    )


def test_windows_over_the_stream_equal_the_batch(spark):
    folder = working_path(spark, "windows")
    params = ProbeParams(bounded=True, state_partitions=2)
    session = stream_session(spark, params)
    posts, receipts, subscriptions = _stream_inputs(spark)
    _write(folder, "posts", posts, 1)
    _write(folder, "receipts", receipts, 1)
    report = lambda rows: latency.latency_report(rows, "4 minutes", "2 minutes")
    _run(session, folder, report, subscriptions, params, None)
    got = spark.read.parquet(f"{folder}/out").where("server <> ''")
    batch = latency.token_latency(*_inputs(spark, "timestamp")).join(posts, list(latency.TOKEN))
    assert rows(got) == rows(report(batch))
    # Tokens that b never received: each lies in two windows.
    assert got.where("subscriber = 'b'").agg(F.sum("undelivered")).first()[0] == 12


def test_sessions_end_with_a_gap(spark):
    posts, receipts, subscriptions = _inputs(spark, "timestamp")
    dated = latency.token_latency(posts, receipts, subscriptions).join(posts, list(latency.TOKEN))
    early = dated.where("server = 'e' AND publication = 'p' AND subscriber = 'a' AND tracer_id IN (0, 1, 4)")
    report = latency.latency_report(early, gap="90 seconds").orderBy("from_ts").collect()
    assert [(row.from_ts, row.to_ts, row.tokens, row.total_latency) for row in report] == [
        (_at(0), _at(150), 2, 2),
        (_at(240), _at(330), 1, 1),
    ]


def test_no_tokens(spark):
    posts, receipts, subscriptions = _inputs(spark, "timestamp_ntz")
    assert latency.token_latency(posts.where("false"), receipts, subscriptions).count() == 0
    assert latency.token_latency(posts, receipts.where("false"), subscriptions.where("false")).count() == 12
