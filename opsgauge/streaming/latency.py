"""Delivery latency as a stream.

Posting a token, waiting and reading what arrived becomes a left outer join of
two streams: a token whose receipt is not seen within the delay is reported
undelivered once the watermark has passed it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsgauge.operators.latency import (
    TOKEN,
    expected_subscriptions,
    latency_columns,
    same_token,
    stamped,
    write_streamed_history,
)
from opsgauge.session import RECOMMENDED_CONF


@dataclass(frozen=True)
class ProbeParams:
    """Cadence of a probe: the wait for a token, the time between rounds and their number.

    ``lateness`` is how far a side may lag behind the other one; it should cover the delay, since
    the watermark follows the side that is ahead.  ``bounded`` makes one pass over what is there instead of rounds.  The state is
    kept in ``state_partitions`` parts, one per core by default; a checkpoint
    keeps their number for good.
    """

    replication_delay: str = "30 seconds"
    lateness: str = "60 seconds"
    iterations: int = 5
    iteration_seconds: int = 30
    bounded: bool = False
    state_partitions: int | None = None

    def trigger(self) -> dict:
        return {"availableNow": True} if self.bounded else {"processingTime": f"{self.iteration_seconds} seconds"}


def stream_session(spark: SparkSession, params: ProbeParams = ProbeParams()) -> SparkSession:
    """A session of the same application whose settings suit the stream."""
    session = spark.newSession()
    partitions = params.state_partitions or spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.shuffle.partitions", partitions)
    for key in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.session.timeZone"):
        session.conf.set(key, RECOMMENDED_CONF[key])
    # Counting the rows of the state costs a lookup for each one that is written.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    # A batch stores its changes; whole copies of the state follow in the background.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # When a subscriber dies its receipts stop: time goes on with the posts.
    session.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    return session


def stream_latency(
    posts: DataFrame,
    receipts: DataFrame,
    params: ProbeParams = ProbeParams(),
    subscriptions: DataFrame | None = None,
) -> DataFrame:
    """Latencies of streamed tokens; unmatched ones come out with NULLs.

    Both sides have a watermark and the join a time bound, so a token leaves the
    state when its delay is over.  ``seen_ts`` of a receipt is its last known hop.  Run it in a
    ``stream_session``: there the watermark follows the side that is ahead, so tokens are reported
    undelivered also when no receipts come any more.  ``subscriptions``, a table, says which subscribers each
    token is waited for from, as in ``token_latency``: each has a row of its own.
    """
    sent = posts.withWatermark("post_ts", params.lateness)
    seen = receipts.withColumnsRenamed({name: f"_seen_{name}" for name in TOKEN}).withWatermark("seen_ts", params.lateness)
    conditions = [*same_token(), f"seen_ts >= post_ts AND seen_ts <= post_ts + INTERVAL {params.replication_delay}"]
    if subscriptions is not None:
        sent, seen = _by_subscription(sent, seen, expected_subscriptions(subscriptions))
        conditions += ["_for = _seen_for", "_for_db = _seen_for_db"]
    joined = sent.join(seen, F.expr(" AND ".join(conditions)), "leftOuter")
    return joined.select(*TOKEN, "post_ts", *latency_columns(expected=subscriptions is not None))


def _by_subscription(sent: DataFrame, seen: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the subscription as part of their key, so that a row meets only those of its own subscriber.

    The streams are joined with tables before any state.  A token has one waiting row for each subscription; where
    none is listed its key is empty, and so is that of the publication's receipts.
    """
    named = F.col("_subscriber").isNotNull()
    waiting = sent.join(expected, ["server", "publication"], "left").withColumns(
        {
            "_for": F.when(named, F.concat(F.lit("="), "_subscriber")).otherwise(F.lit("")),
            "_for_db": F.when(named, F.col("_subscriber_db")).otherwise(F.lit("")),
        }
    )
    # A publication listed with and without a subscriber has both kinds of keys.
    kinds = expected.select(F.col("server").alias("_seen_server"), F.col("publication").alias("_seen_publication"), named.alias("_named"))
    keyed = seen.join(kinds.distinct(), ["_seen_server", "_seen_publication"], "left").withColumns(
        {
            "_seen_for": F.when(F.col("_named"), F.concat(F.lit("="), "subscriber")).otherwise(F.lit("")),
            "_seen_for_db": F.when(F.col("_named"), F.coalesce("subscriber_db", F.lit(""))).otherwise(F.lit("")),
        }
    )
    return waiting, keyed.drop("_named")


def run_probe(query: StreamingQuery, params: ProbeParams) -> None:
    """Let a query run for its rounds, or to its end if bounded, and stop it."""
    if params.bounded:
        query.awaitTermination()
    elif not query.awaitTermination(params.iterations * params.iteration_seconds):
        query.processAllAvailable()
        query.stop()


def start_monitor(
    latencies: DataFrame, path: str, checkpoint: str, publication_db: str, params: ProbeParams = ProbeParams()
) -> StreamingQuery:
    """Keep the history at ``path`` up to date from a latency stream.

    Rows are dated by the time their token was posted.  A replayed micro-batch replaces its own
    folders, which are named by the checkpoint and the batch, so none is counted twice.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = stamped(batch, F.col("post_ts").cast("timestamp_ntz"), None, publication_db)
        write_streamed_history(rows, path, stream, batch_id)

    return (
        latencies.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**params.trigger())
        .start()
    )
