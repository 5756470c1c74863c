from __future__ import annotations

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsgauge.checks.adapters import adapter
from opsgauge import session
from opsgauge.operators import compaction as compaction_module
from opsgauge.operators import latency
from opsgauge.operators.compaction import compact
from opsgauge.operators.maintenance import MaintenanceSettings, maintenance_state
from opsgauge.plans.compaction import compaction_plan
from opsgauge.session import working_path
from opsgauge.sources import versioned
from opsgauge.sources.layout import data_files, layout_stats
from opsgauge.sources.logs import COMPACTION_LOG, read_log
from opsgauge.streaming.latency import ProbeParams, run_probe, start_monitor, stream_latency, stream_session
from tests.helpers import executed, rows


def _table(spark, count=4000):
    """Keys with characters that paths escape; one partition holds most rows."""
    key = F.when(F.col("id") % 10 < 8, "hot/one").when(F.col("id") % 10 == 8, "4-NOT SPECIFIED: a=b+c%é").otherwise(None)
    return spark.range(count).select("id", (F.col("id") * 3).alias("v"), key.alias("k"), (F.col("id") % 2).alias("n"))


def _root(spark, files=5, count=4000):
    root = working_path(spark, "table")
    versioned.create(_table(spark, count).repartition(files), root, ["k", "n"])
    return root


def test_layout_equals_a_directory_walk(spark):
    root = _root(spark)
    walked = {}
    for folder, _, names in os.walk(f"{root}/version=1"):
        sizes = [os.path.getsize(f"{folder}/{name}") for name in names if name.endswith(".parquet")]
        if sizes:
            walked[f"file:{folder}"] = (len(sizes), sum(sizes), 100.0 * sum(s < 3000 for s in sizes) / len(sizes))
    got = layout_stats(versioned.current_files(spark, root), 3000, ["k", "n"])
    assert {row.directory: (row.page_count, row.total_bytes, row.fragmentation) for row in got.collect()} == walked
    assert {row.k for row in got.collect()} == {"hot/one", "4-NOT SPECIFIED: a=b+c%é", None}


def test_files_are_listed_and_not_read(spark):
    plan = executed(data_files(spark, _root(spark)))
    assert "content" not in plan[plan.index("ReadSchema") :]


def test_single_files_have_nothing_to_merge(spark):
    root = _root(spark, files=1)
    assert {row.fragmentation for row in layout_stats(versioned.current_files(spark, root), 1 << 30).collect()} == {0.0}


def test_compaction_keeps_rows_and_merges_files(spark):
    root = _root(spark)
    before = rows(versioned.read_current(spark, root), "id", "v", "k", "n")
    stats = layout_stats(versioned.current_files(spark, root), 1 << 30, ["k", "n"])
    assert compact(spark, stats, root, ["k", "n"], 1 << 30, ["id"]) == 2
    assert rows(versioned.read_current(spark, root), "id", "v", "k", "n") == before
    after = layout_stats(versioned.current_files(spark, root), 1 << 30, ["k", "n"])
    assert {row.page_count for row in after.collect()} == {1}
    # The old folders stay for running readers, and for going back.
    assert rows(spark.read.parquet(*versioned.directories(versioned.manifest(spark, root, 1))), "id") == [(r[0],) for r in before]


def test_compaction_splits_a_large_partition(spark, monkeypatch):
    monkeypatch.setattr(compaction_module, "BLOCK_ROWS", 50)
    root = _root(spark)
    stats = layout_stats(versioned.current_files(spark, root), 1 << 30, ["k", "n"])
    hot = stats.where("k = 'hot/one' AND n = 0")
    size = hot.first().total_bytes
    compact(spark, hot, root, ["k", "n"], size // 3)
    files = versioned.current_files(spark, root)
    assert 2 <= files.where("k = 'hot/one' AND n = 0").count() <= 4
    assert files.where("NOT (k = 'hot/one' AND n = 0)").count() == 3 * 5
    assert versioned.read_current(spark, root).count() == 4000


def test_compaction_touches_only_planned_partitions(spark):
    root = _root(spark)
    stats = layout_stats(versioned.current_files(spark, root), 1 << 30, ["k", "n"])
    planned = stats.withColumn("action", F.when(F.col("n") == 0, "REBUILD").otherwise("SKIP"))
    old = {d for d in versioned.directories(versioned.manifest(spark, root))}
    compact(spark, planned, root, ["k", "n"], 1 << 30)
    new = set(versioned.directories(versioned.manifest(spark, root)))
    assert len(new) == len(old) == 4
    assert all(d.endswith("n=1") for d in old & new) and len(old & new) == 2
    assert compact(spark, planned.where("action = 'SKIP'"), root, ["k", "n"], 1 << 30) == 2


def test_a_failed_compaction_is_not_published(spark, monkeypatch):
    root = _root(spark)
    stats = layout_stats(versioned.current_files(spark, root), 1 << 30, ["k", "n"])
    real = versioned.stage
    monkeypatch.setattr(versioned, "stage", lambda df, *rest: real(df.where("id % 7 <> 0"), *rest))
    log_path = working_path(spark, "log")
    with pytest.raises(RuntimeError, match="stays current"):
        compact(spark, stats, root, ["k", "n"], 1 << 30, log_path=log_path, run_id="r")
    state = maintenance_state(read_log(spark, log_path, COMPACTION_LOG), ("run_id", "directory"))
    assert {(row.status, row.durationSeconds) for row in state.collect()} == {("FAILED", -1)}
    assert all("stays current" in row.errorMessage for row in state.collect()) and state.count() == 4
    assert versioned.current_version(spark, root) == 1
    assert versioned.read_current(spark, root).count() == 4000
    monkeypatch.undo()
    assert compact(spark, stats, root, ["k", "n"], 1 << 30) == 2
    assert versioned.read_current(spark, root).count() == 4000


def test_partition_values_keep_their_spelling(spark):
    root = working_path(spark, "spelling")
    key = F.element_at(F.array(F.lit("001"), F.lit("1"), F.lit("1.50"), F.lit(None)), (F.col("id") % 4 + 1).cast("int"))
    table = spark.range(100).select("id", key.alias("p"), (F.col("id") % 2).alias("n"))
    versioned.create(table.repartition(3), root, ["p", "n"])
    before = rows(versioned.read_current(spark, root), "id", "p", "n")
    assert before == rows(table)
    stats = layout_stats(versioned.current_files(spark, root), 1 << 30, ["p", "n"])
    assert {row.p for row in stats.collect()} == {"001", "1", "1.50", None}
    assert compact(spark, stats, root, ["p", "n"], 1 << 30) == 2
    assert rows(versioned.read_current(spark, root), "id", "p", "n") == before
    assert versioned.manifest(spark, root).count() == 4
    assert versioned.remove_replaced(spark, root) == 4
    assert rows(versioned.read_current(spark, root), "id", "p", "n") == before


def test_compaction_in_batches(spark, monkeypatch):
    monkeypatch.setattr(compaction_module, "BATCH_FOLDERS", 3)
    root = _root(spark)
    before = rows(versioned.read_current(spark, root), "id")
    stats = layout_stats(versioned.current_files(spark, root), 1 << 30, ["k", "n"])
    assert compact(spark, stats, root, ["k", "n"], 1 << 30) == 3
    assert rows(versioned.read_current(spark, root), "id") == before
    assert versioned.manifest(spark, root).count() == stats.count()


def test_two_runs_of_one_version_do_not_mix(spark):
    root = _root(spark)
    stats = layout_stats(versioned.current_files(spark, root), 1 << 30, ["k", "n"])
    rival = versioned.stage(versioned.read_current(spark, root), root, versioned.staging_name(2), ["k", "n"])
    assert compact(spark, stats, root, ["k", "n"], 1 << 30) == 2
    with pytest.raises(Exception, match="(?i)exists"):
        versioned.publish_replacement(spark, root, 2, rival, stats)
    assert versioned.read_current(spark, root).count() == 4000


def test_compaction_plan(spark):
    root = _root(spark)
    files = versioned.current_files(spark, root)
    settings = MaintenanceSettings(min_size=1, order_by="range_scan_count")
    reads = files.select("directory", (F.col("n") * 10).alias("range_scan_count")).distinct()
    plan = compaction_plan(files, 1 << 30, ["k", "n"], settings, reads).orderBy("priority").collect()
    assert [row.n for row in plan] == [1, 1, 0, 0] and {row.fragmentation for row in plan} == {100.0}
    latest = compaction_plan(files, 1 << 30, ["k", "n"], latest_by="n")
    assert {row.n for row in latest.collect()} == {0}
    assert compaction_plan(files, 1, ["k", "n"]).count() == 0
    small = MaintenanceSettings(min_size=1, order_by="page_count", minutes=1)
    hurried = compaction_plan(files, 1 << 30, ["k", "n"], small, bytes_per_second=1)
    assert [row.priority for row in hurried.collect()] == [1]


def test_the_working_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Conf:
        value = None

        def get(self, key, default=None):
            return self.value or default

    class Cluster:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster())
    Conf.value = "hdfs://shared/work"
    assert working_path(Cluster(), "x").startswith("hdfs://shared/work/x-")


# Latency


def _tokens(spark):
    start = datetime(2024, 1, 1, 0, 0, 0)
    posts = spark.createDataFrame(
        [
            ("e", "p", 30, start),
            ("e", "p", 10, start + timedelta(seconds=5)),
            ("e", "q", 30, start),
            ("e", "p", 40, start),
            ("w", "p", 30, start + timedelta(hours=1)),
        ],
        "server string, publication string, tracer_id long, post_ts timestamp_ntz",
    )
    receipts = spark.createDataFrame(
        [
            ("e", "p", 30, "s1", "d1", start + timedelta(seconds=2), start + timedelta(seconds=5)),
            ("e", "p", 30, "s2", "d2", start + timedelta(seconds=2), None),
            ("e", "q", 30, "s1", "d1", start + timedelta(seconds=1, milliseconds=900), start + timedelta(seconds=2)),
        ],
        "server string, publication string, tracer_id long, subscriber string, subscriber_db string, "
        "distributor_ts timestamp_ntz, subscriber_ts timestamp_ntz",
    )
    return posts, receipts


def test_token_latency(spark):
    assert rows(latency.token_latency(*_tokens(spark)).drop("subscriber_db")) == sorted(
        [
            ("e", "p", 1, 30, 2, "s1", 3, 5),
            ("e", "p", 1, 30, 2, "s2", None, None),
            ("e", "p", 2, 40, None, None, None, None),
            ("e", "p", 3, 10, None, None, None, None),
            ("e", "q", 1, 30, 1, "s1", 1, 2),
            ("w", "p", 1, 30, None, None, None, None),
        ],
        key=repr,
    )


def test_normalize_golden(spark):
    cases = [(1, 2, 3, None), (2, 2, None, None), (3, None, None, None), (4, 2, 3, 6)]
    df = spark.createDataFrame(cases, "at int, distributor_latency long, subscriber_latency long, overall_latency long")
    got = latency.normalize_latency(df).orderBy("at").collect()
    assert [row.overall_latency for row in got] == [5, 2, 0, 6]
    assert [row.subscriber_latency for row in got] == [3, 0, 0, 3]


def test_history_is_idempotent_and_purged_by_run(spark):
    path = working_path(spark, "history")
    measured = latency.token_latency(*_tokens(spark))
    runs = [datetime(2024, 1, 1, 6), datetime(2024, 1, 2, 6), datetime(2024, 1, 2, 18), datetime(2024, 1, 3, 6)]
    for run in [*runs, runs[1]]:
        latency.append_monitor(measured, path, run, "pub", "pubdb")
    history = spark.read.parquet(path)
    assert history.count() == 6 * 4
    assert rows(history.select("publicationName", "publicationDB").distinct()) == [("pub", "pubdb")]
    cutoff = datetime(2024, 1, 2, 12)
    kept = latency.purge_history(history, cutoff)
    expected = rows(kept)
    assert {row.monitorDate for row in kept.collect()} == set(runs[2:])
    latency.purge_history_table(spark, path, cutoff)
    assert rows(spark.read.parquet(path), *kept.columns) == expected
    assert not os.path.exists(f"{path}/monitorDay=2024-01-01")
    assert len(os.listdir(f"{path}/monitorDay=2024-01-02")) == 1
    latency.purge_history_table(spark, path, cutoff)
    assert spark.read.parquet(path).count() == len(expected)


def test_an_empty_history(spark):
    path = working_path(spark, "history")
    latency.append_monitor(latency.token_latency(*_tokens(spark)).where("false"), path, datetime(2024, 1, 1), "p", "d")
    assert latency.read_history(spark, path).count() == 0
    latency.purge_history_table(spark, path, datetime(2024, 1, 2))


def test_purge_reads_no_older_day(spark):
    path = working_path(spark, "history")
    measured = latency.token_latency(*_tokens(spark))
    for day in (1, 2, 3):
        latency.append_monitor(measured, path, datetime(2024, 1, day), "pub", "db")
    plan = executed(latency.purge_history(spark.read.parquet(path), datetime(2024, 1, 2)))
    assert "(monitorDay#" in plan and "PartitionFilters: [isnotnull(monitorDay" in plan


def _streams(spark, sf, folder):
    made, session = {}, stream_session(spark)
    for name in ("posts", "receipts"):
        df = adapter(spark, sf, name)
        if name == "receipts":
            df = df.withColumn("seen_ts", F.coalesce("subscriber_ts", "distributor_ts"))
        typed = df.select(
            *[F.col(f.name).cast("timestamp") if f.name.endswith("_ts") else F.col(f.name) for f in df.schema.fields]
        )
        typed.write.parquet(f"{folder}/{name}")
        made[name] = session.readStream.schema(typed.schema).parquet(f"{folder}/{name}")
    return made


def test_stream_of_late_and_missing_receipts(spark):
    """A receipt after the delay does not count: the token is reported undelivered."""
    folder = working_path(spark, "late")
    start = datetime(2024, 1, 1)
    posts = [(at, start + timedelta(minutes=at)) for at in range(4)] + [(99, start + timedelta(hours=2))]
    receipts = [(0, 10), (1, 31), (3, 30), (99, 0)]
    sent = spark.createDataFrame(
        [("e", "p", t, ts) for t, ts in posts], "server string, publication string, tracer_id long, post_ts timestamp"
    )
    times = dict(posts)
    seen = spark.createDataFrame(
        [("e", "p", t, "s", "d", times[t] + timedelta(seconds=gap), times[t] + timedelta(seconds=gap)) for t, gap in receipts],
        "server string, publication string, tracer_id long, subscriber string, subscriber_db string, distributor_ts timestamp, subscriber_ts timestamp",
    ).withColumn("seen_ts", F.col("subscriber_ts"))
    sent.write.parquet(f"{folder}/posts")
    seen.write.parquet(f"{folder}/receipts")
    streams = {n: spark.readStream.schema(df.schema).parquet(f"{folder}/{n}") for n, df in (("posts", sent), ("receipts", seen))}
    query = (
        stream_latency(**streams, params=ProbeParams("30 seconds"))
        .writeStream.format("memory").queryName("late").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows(spark.table("late"), "tracer_id", "overall_latency") == [(0, 10), (1, None), (2, None), (3, 30), (99, 0)]


def test_monitor_stream_keeps_a_history_once(spark, sf):
    folder = working_path(spark, "monitor")
    streams = _streams(spark, sf, folder)
    params = ProbeParams(bounded=True)
    for _ in range(2):
        query = start_monitor(
            stream_latency(**streams, params=params), f"{folder}/history", f"{folder}/state", "db", params
        )
        query.awaitTermination()
    history = spark.read.parquet(f"{folder}/history")
    delivered = latency.normalize_latency(latency.token_latency(adapter(spark, sf, "posts"), adapter(spark, sf, "receipts")))
    keys = ["server", "publicationName", "tracer_id", "subscriber"]
    assert history.select(*keys).distinct().count() == history.count()
    delivered = delivered.withColumnRenamed("publication", "publicationName")
    same = ["server", "publicationName", "tracer_id", "subscriber", "distributor_latency", "subscriber_latency", "overall_latency"]
    missing = delivered.where("subscriber IS NOT NULL").select(*same).exceptAll(history.select(*same))
    assert missing.count() == 0
    # Rows are dated by their tokens, and a purge keeps the newer ones.
    posted = adapter(spark, sf, "posts").withColumnRenamed("publication", "publicationName")
    dated = history.join(posted, ["server", "publicationName", "tracer_id"])
    assert dated.where("monitorDate <> post_ts OR monitorDay <> date(post_ts)").count() == 0
    cutoff = datetime(2024, 1, 15, 12)
    expected = rows(latency.purge_history(history, cutoff), "server", "publicationName", "tracer_id", "subscriber")
    assert 0 < len(expected) < history.count()
    latency.purge_history_table(spark, f"{folder}/history", cutoff)
    left = spark.read.parquet(f"{folder}/history")
    assert rows(latency.purge_history(left, cutoff), "server", "publicationName", "tracer_id", "subscriber") == expected
    assert left.where("monitorDate < TIMESTAMP_NTZ '2024-01-15 12:00:00'").count() == 0


def test_a_dead_subscriber_is_reported(spark):
    """Receipts stop after five tokens: the later ones come out undelivered."""
    folder, start = working_path(spark, "dead"), datetime(2024, 1, 1)
    posts = [("e", "p", at, start + timedelta(minutes=at)) for at in range(100)]
    receipts = [("e", "p", at, "s", "d", start + timedelta(minutes=at), start + timedelta(minutes=at)) for at in range(5)]
    sent = spark.createDataFrame(posts, "server string, publication string, tracer_id long, post_ts timestamp")
    seen = spark.createDataFrame(
        receipts,
        "server string, publication string, tracer_id long, subscriber string, subscriber_db string, "
        "distributor_ts timestamp, subscriber_ts timestamp",
    ).withColumn("seen_ts", F.col("subscriber_ts"))
    sent.write.parquet(f"{folder}/posts")
    seen.write.parquet(f"{folder}/receipts")
    params, session = ProbeParams(bounded=True), stream_session(spark)
    streams = {n: session.readStream.schema(df.schema).parquet(f"{folder}/{n}") for n, df in (("posts", sent), ("receipts", seen))}
    query = start_monitor(stream_latency(**streams, params=params), f"{folder}/history", f"{folder}/state", "db", params)
    query.awaitTermination()
    history = latency.read_history(spark, f"{folder}/history")
    assert history.where("subscriber IS NOT NULL").count() == 5
    assert history.where("subscriber IS NULL").count() >= 90


def test_probe_triggers():
    assert ProbeParams(bounded=True).trigger() == {"availableNow": True}
    assert ProbeParams(iteration_seconds=5).trigger() == {"processingTime": "5 seconds"}


def test_probe_of_some_rounds(spark, sf):
    folder = working_path(spark, "rounds")
    params = ProbeParams(iterations=2, iteration_seconds=1)
    latencies = stream_latency(**_streams(spark, sf, folder), params=params)
    query = start_monitor(latencies, f"{folder}/history", f"{folder}/state", "db", params)
    run_probe(query, params)
    assert not query.isActive and query.exception() is None
    assert latency.read_history(spark, f"{folder}/history").where("subscriber IS NOT NULL").count() > 0
