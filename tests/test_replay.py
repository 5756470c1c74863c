"""Stored tables as streams in the order of their time."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from opsgauge.operators import latency
from opsgauge.session import working_path
from opsgauge.streaming.latency import ProbeParams, stream_latency, stream_session
from opsgauge.streaming import numbering
from opsgauge.streaming.numbering import numbered_latency
from opsgauge.streaming.replay import replay
from tests.helpers import rows

START = datetime(2024, 1, 1)


def _tables(spark):
    """Tokens ten seconds apart, out of order; ``a`` receives each in a second, ``b`` only the first and the last ones."""
    at = lambda seconds: START + timedelta(seconds=seconds)
    numbers = [number * 37 % 600 for number in range(600)]
    posts = [("e", "p", number, at(10 * number)) for number in numbers] + [("", "", -1, at(86400))]
    receipts = [("e", "p", number, "a", None, at(10 * number), at(10 * number + 1)) for number in numbers]
    receipts += [("e", "p", number, "b", "d", at(10 * number), at(10 * number + 20)) for number in numbers if not 100 < number < 500]
    named = "server string, publication string, tracer_id long, "
    received = spark.createDataFrame(receipts, named + "subscriber string, subscriber_db string, distributor_ts timestamp, subscriber_ts timestamp")
    listed = spark.createDataFrame([("e", "p", "a", None), ("e", "p", "b", "d")], "server string, publication string, subscriber string, subscriber_db string")
    return spark.createDataFrame(posts, named + "post_ts timestamp"), received.withColumn("seen_ts", F.col("subscriber_ts")), listed


def _run(spark, rows_per_batch, lists=True):
    folder, params = working_path(spark, "replay"), ProbeParams(bounded=True, state_partitions=2)
    posts, receipts, listed = _tables(spark)
    tables = {"posts": (posts, "post_ts"), "receipts": (receipts, "seen_ts")}
    streams = replay(stream_session(spark, params), tables, f"{folder}/in", rows_per_batch)
    query = (
        stream_latency(**streams, params=params, subscriptions=listed if lists else None)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/out").where("server <> ''")
    return got, [json.loads(progress.json) for progress in query.recentProgress]


def test_batches_are_bounded_and_lose_no_row(spark):
    got, progress = _run(spark, 100)
    posts, receipts, listed = _tables(spark)
    expected = latency.token_latency(posts, receipts, listed).where("server <> ''")
    names = ["tracer_id", "subscriber", "subscriber_db", "distributor_latency", "subscriber_latency", "overall_latency"]
    assert rows(got, *names) == rows(expected, *names)
    assert got.count() == 1200
    # 601 posts and 1,000 receipts; none of them was late.
    read = [batch["numInputRows"] for batch in progress if batch["numInputRows"]]
    assert len(read) == 7 and max(read) < 400
    assert sum(operator["numRowsDroppedByWatermark"] for batch in progress for operator in batch["stateOperators"]) == 0


def test_a_period_without_receipts_keeps_the_tables_together(spark):
    posts, receipts, _ = _tables(spark)
    quiet = receipts.where("NOT tracer_id BETWEEN 150 AND 450")
    session = stream_session(spark, ProbeParams())
    folder = working_path(spark, "quiet")
    replay(session, {"posts": (posts, "post_ts"), "receipts": (quiet, "seen_ts")}, folder, 100)
    for name, at in (("posts", "post_ts"), ("receipts", "seen_ts")):
        files = spark.read.parquet(f"{folder}/{name}").groupBy("_period", F.col("_metadata.file_modification_time").alias("written"))
        found = files.agg(F.count(at).alias("rows"), F.count(F.lit(1)).alias("all")).orderBy("written").collect()
        assert [row["_period"] for row in found] == list(range(7))
        assert len({row.written for row in found}) == 7


def test_rows_meet_those_of_their_own_subscriber_only(spark):
    posts, receipts, listed = _tables(spark)
    streams = replay(
        stream_session(spark, ProbeParams()), {"posts": (posts, "post_ts"), "receipts": (receipts, "seen_ts")}, working_path(spark, "keys"), 1000
    )
    plan = stream_latency(**streams, subscriptions=listed)._jdf.queryExecution().analyzed().toString()
    assert "(_for#" in plan and " OR " not in plan


def test_a_subscription_without_a_name_waits_for_any(spark):
    """Also beside one that has a name: the batch and the stream agree."""
    posts, receipts, _ = _tables(spark)
    listed = spark.createDataFrame([("e", "p", None, None), ("e", "p", "b", "d")], "server string, publication string, subscriber string, subscriber_db string")
    folder, params = working_path(spark, "unnamed"), ProbeParams(bounded=True, state_partitions=2)
    streams = replay(stream_session(spark, params), {"posts": (posts, "post_ts"), "receipts": (receipts, "seen_ts")}, folder + "/in", 1000)
    query = stream_latency(**streams, params=params, subscriptions=listed).writeStream.format("parquet")
    query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    names = ["tracer_id", "subscriber", "subscriber_db", "overall_latency"]
    expected = latency.token_latency(posts, receipts, listed).where("server <> ''")
    assert rows(spark.read.parquet(f"{folder}/out").where("server <> ''"), *names) == rows(expected, *names)


def test_numbers_go_on_over_bounded_batches(spark):
    """Waiting rows are kept as columns, many in one value of the state; a batch cuts through such a value."""
    posts, receipts, listed = _tables(spark)
    folder, params = working_path(spark, "numbers"), ProbeParams(bounded=True, state_partitions=2)
    streams = replay(stream_session(spark, params), {"posts": (posts, "post_ts"), "receipts": (receipts, "seen_ts")}, folder + "/in", 100)
    numbered = numbered_latency(stream_latency(**streams, params=params, subscriptions=listed))
    query = numbered.writeStream.format("parquet")
    query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    names = ["iteration", "tracer_id", "subscriber", "subscriber_db", "overall_latency"]
    expected = latency.token_latency(posts, receipts, listed).where("server <> ''")
    assert rows(spark.read.parquet(f"{folder}/out").where("server <> ''"), *names) == rows(expected, *names)


def test_a_value_of_the_state_holds_many_rows():
    waiting = pd.DataFrame({"tracer_id": [2**60 + 1, 7], "post_us": [5, 9], "subscriber": ["a", None], "overall_latency": [None, 3.0]})
    first, last, packed = numbering._packed(waiting)
    assert (first, last) == (5, 9) and isinstance(packed, bytes)
    back = numbering._unpacked(packed)
    assert back["tracer_id"].tolist() == [2**60 + 1, 7] and back["overall_latency"].isna().tolist() == [True, False]
