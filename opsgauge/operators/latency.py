"""Delivery latency of tokens, as a batch and as a kept history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.functions.calendar import moment
from opsgauge.operators.maintenance import whole_seconds
from opsgauge.plans.ordering import ranked
from opsgauge.sources.layout import data_files, remove_folders

# A token is known by the server and the publication it was posted to, and its number there.
TOKEN = ("server", "publication", "tracer_id")

HISTORY = (
    "monitorDate timestamp_ntz, server string, publicationName string, publicationDB string, iteration bigint, tracer_id bigint, "
    "distributor_latency bigint, subscriber string, subscriber_db string, subscriber_latency bigint, "
    "overall_latency bigint, monitorDay date, runKey string"
)

# Sorts as text the way the moments do.
RUN_FORMAT, HOUR_FORMAT = "yyyyMMddHHmmssSSSSSS", "yyyyMMddHH"

RESULT = (
    "iteration",
    "tracer_id",
    "distributor_latency",
    "subscriber",
    "subscriber_db",
    "subscriber_latency",
    "overall_latency",
)


# A subscription is known by where it subscribes and by who subscribes.
SUBSCRIPTION = ("server", "publication", "subscriber", "subscriber_db")


def token_latency(posts: DataFrame, receipts: DataFrame, subscriptions: DataFrame | None = None) -> DataFrame:
    """One row per token and subscriber, latencies in whole seconds, NULL where not delivered.

    Tokens are numbered from 1 within their publication in the order they were posted.  Both inputs
    have the columns of ``TOKEN``; a token can have a receipt of every subscriber.  With ``subscriptions``
    (``SUBSCRIPTION``) every token has a row for each one of its publication, received or not, so that a subscriber
    that stopped is seen among others that go on; who is not listed is left out then.  Tokens of a publication
    without any listed subscription have the rows they have without ``subscriptions``.
    """
    tokens = posts.select(*TOKEN, "post_ts")
    order = [F.asc("post_ts"), F.asc("tracer_id")]
    numbered = ranked(tokens, order, ["server", "publication"], "iteration")
    if subscriptions is None:
        joined = numbered.join(receipts, list(TOKEN), "left")
        return joined.select("server", "publication", "iteration", "tracer_id", *latency_columns())
    expected = numbered.join(expected_subscriptions(subscriptions), ["server", "publication"], "left")
    received = receipts.select(*TOKEN, "subscriber", "subscriber_db", "distributor_ts", "subscriber_ts")
    received = received.withColumnsRenamed({name: f"_seen_{name}" for name in TOKEN})
    joined = expected.join(received, F.expr(" AND ".join([*same_token(), same_subscription()])), "left")
    return joined.select("server", "publication", "iteration", "tracer_id", *latency_columns(expected=True))


def expected_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Each subscription once, its subscriber under names that receipts do not have."""
    return subscriptions.select(
        "server",
        "publication",
        F.col("subscriber").alias("_subscriber"),
        F.coalesce("subscriber_db", F.lit("")).alias("_subscriber_db"),
    ).distinct()


def subscriptions_seen(receipts: DataFrame) -> DataFrame:
    """The subscriptions that ever received a token, where no list of them exists."""
    return receipts.where(F.col("subscriber").isNotNull()).select(*SUBSCRIPTION).distinct()


def same_token() -> list[str]:
    """Conditions that a receipt (``_seen_``) is of a token."""
    return [f"{name} = _seen_{name}" for name in TOKEN]


def same_subscription() -> str:
    """The condition that a receipt is of an expected subscription, or that none is expected."""
    return (
        "(_subscriber IS NULL OR (_subscriber = subscriber AND _subscriber_db = coalesce(subscriber_db, '')))"
    )


def latency_columns(expected: bool = False) -> list[Column]:
    """The two hops and the whole way of a joined token and receipt.

    With ``expected`` the subscriber is the one that was waited for, if any.
    """
    subscriber, database = F.col("subscriber"), F.col("subscriber_db")
    if expected:
        subscriber = F.coalesce("_subscriber", subscriber)
        database = F.when(F.col("_subscriber").isNull(), database).otherwise(F.nullif("_subscriber_db", F.lit("")))
    return [
        whole_seconds(F.col("post_ts"), F.col("distributor_ts")).alias("distributor_latency"),
        subscriber.alias("subscriber"),
        database.alias("subscriber_db"),
        whole_seconds(F.col("distributor_ts"), F.col("subscriber_ts")).alias("subscriber_latency"),
        whole_seconds(F.col("post_ts"), F.col("subscriber_ts")).alias("overall_latency"),
    ]


def latency_report(
    latencies: DataFrame, width: str = "1 hour", slide: str | None = None, gap: str | None = None
) -> DataFrame:
    """Tokens, undelivered ones and latencies by publication, subscriber and time of ``post_ts``.

    Windows are ``width`` long and begin every ``slide`` (default: ``width``); with ``gap`` they are sessions
    instead, which end when no token was posted for so long.  Works on a batch and on the stream of
    ``stream_latency``, where a window is reported once, when no row of it can come any more.
    """
    span = F.session_window("post_ts", gap) if gap is not None else F.window("post_ts", width, slide or width)
    overall = F.col("overall_latency")
    return (
        latencies.groupBy(span.alias("span"), "server", "publication", "subscriber", "subscriber_db")
        .agg(
            F.count(F.lit(1)).alias("tokens"),
            F.count_if(overall.isNull()).alias("undelivered"),
            F.sum(overall).alias("total_latency"),
            F.max(overall).alias("max_latency"),
        )
        .select(F.col("span.start").alias("from_ts"), F.col("span.end").alias("to_ts"), "*")
        .drop("span")
    )


def normalize_latency(latencies: DataFrame) -> DataFrame:
    """A missing hop counts as 0 and a missing whole as the sum of the hops."""
    zero = F.lit(0).cast("bigint")
    first = F.coalesce("distributor_latency", zero)
    second = F.coalesce("subscriber_latency", zero)
    return latencies.withColumns(
        {
            "distributor_latency": first,
            "subscriber_latency": second,
            "overall_latency": F.coalesce("overall_latency", first + second),
        }
    )


def append_monitor(
    latencies: DataFrame, path: str, run_ts: datetime, publication: str | None, publication_db: str, batch_id: int = 0
) -> None:
    """Stamp normalised latencies with the run and add them to the history at ``path``.

    Each run and batch has a folder of its own which a repeated run replaces, so
    nothing is stored twice.  Without ``publication`` the column of that name is kept.
    """
    at = F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")
    write_history(stamped(latencies, at, publication, publication_db), path, batch_id)


def stamped(latencies: DataFrame, at: Column, publication: str | None, publication_db: str) -> DataFrame:
    """Normalised latencies as rows of the history, dated by ``at``."""
    name = F.col("publication") if publication is None else F.lit(publication)
    iteration = F.col("iteration") if "iteration" in latencies.columns else F.lit(None)
    return normalize_latency(latencies).select(
        at.alias("monitorDate"),
        "server",
        name.alias("publicationName"),
        F.lit(publication_db).alias("publicationDB"),
        iteration.cast("bigint").alias("iteration"),
        *RESULT[1:],
    )


def write_history(rows: DataFrame, path: str, batch_id: int = 0) -> None:
    """Write stamped rows below the day and the run they belong to."""
    _write(rows, path, F.concat(F.lit("run"), F.date_format("monitorDate", RUN_FORMAT), F.lit(f"-{batch_id}")))


def write_streamed_history(rows: DataFrame, path: str, stream: str, batch_id: int) -> None:
    """Write a batch of a stream below the day and the hour its tokens were posted.

    The folder is named by the stream and the batch too: a replayed batch replaces its own rows.
    """
    hour = F.date_format("monitorDate", HOUR_FORMAT)
    _write(rows, path, F.concat(F.lit("hour"), hour, F.lit(f"-{stream}-{batch_id}")))


def _write(rows: DataFrame, path: str, run: Column) -> None:
    keyed = rows.withColumns({"monitorDay": F.to_date("monitorDate"), "runKey": run})
    (
        keyed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("monitorDay", "runKey")
        .parquet(path)
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The kept history, also one that has no rows yet."""
    return spark.read.schema(HISTORY).parquet(path)


def purge_history(history: DataFrame, cutoff: datetime) -> DataFrame:
    """The history without tokens older than ``cutoff``; older days are not read."""
    return history.where(
        (F.col("monitorDay") >= F.lit(cutoff.date()))
        & (F.col("monitorDate") >= moment(cutoff, history, "monitorDate"))
    )


def purge_history_table(spark: SparkSession, path: str, cutoff: datetime) -> None:
    """Remove the tokens before ``cutoff``: the table then holds what ``purge_history`` returns.

    A run has one date, so its folder is kept or removed as a whole, and days before the cutoff go at
    once; no row of these is read.  Of streamed tokens only the folders of the cutoff's own hour are rewritten, by one
    job that replaces them when it is complete; other folders and their files stay as they are.  A purge
    that is interrupted has removed older tokens at most and can be repeated.
    """
    folders = data_files(spark, path)
    if "runKey" not in folders.columns:
        return  # nothing has been kept yet
    day = F.substring_index("directory", "/", -2)
    day_folder = F.concat(F.lit(path.rstrip("/") + "/"), F.substring_index(day, "/", 1))
    boundary = F.col("monitorDay") == F.lit(cutoff.date())
    old_run = F.col("runKey").startswith("run") & (F.col("runKey") < f"run{cutoff:%Y%m%d%H%M%S%f}")
    old_hour = F.col("runKey").startswith("hour") & (F.col("runKey") < f"hour{cutoff:%Y%m%d%H}")
    expired_run = boundary & (old_run | old_hour)
    expired = folders.where((F.col("monitorDay") < F.lit(cutoff.date())) | expired_run).select(
        F.when(boundary, F.col("directory")).otherwise(day_folder).alias("directory")
    )
    emptied = _purge_hour(spark, path, cutoff)
    if emptied:
        gone = folders.where(boundary & F.col("runKey").isin(emptied)).select("directory")
        expired = expired.union(gone)
    remove_folders(spark, expired)


def _purge_hour(spark: SparkSession, path: str, cutoff: datetime) -> list[str]:
    """Rewrite the folders of the cutoff's hour without older tokens; returns those that have no others."""
    in_hour = (F.col("monitorDay") == F.lit(cutoff.date())) & F.col("runKey").startswith(f"hour{cutoff:%Y%m%d%H}-")
    hour = read_history(spark, path).where(in_hour)
    newer = F.col("monitorDate") >= moment(cutoff, hour, "monitorDate")
    # One row for each folder of an hour: one for each batch of the stream in it.
    counted = hour.groupBy("runKey").agg(F.count_if(newer).alias("kept"), F.count_if(~newer).alias("old")).collect()
    mixed = [row.runKey for row in counted if row.kept and row.old]
    if mixed:
        kept = hour.where(newer & F.col("runKey").isin(mixed))
        _write(kept, path, F.col("runKey"))
    return [row.runKey for row in counted if not row.kept]
