"""The stored status of the units of a fleet: found by a scan, then marked by what each run did.

``units`` is laid out by scan, server and database.  A mark rewrites only the databases that a run touched, by
one job with dynamic partition overwrite, and depends on the events alone: repeating it changes nothing.  ``scans`` has
one row for each completed scan, written last, so a scan that failed midway is never read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.functions.calendar import moment
from opsgauge.operators import SCOPE, UNIT
from opsgauge.operators.maintenance import FAILED, FINISHED, PRINTED, SKIPPED

UNITS = (
    "object_id bigint, index_id int, partition_number bigint, range_scan_count bigint, fragmentation double, "
    "page_count bigint, exclusionMask int, scanDate timestamp_ntz, defragDate timestamp_ntz, printStatus boolean, "
    "scan string, server string, database_id int"
)
SCANS = "scan string, scanDate timestamp_ntz"
# A database with a third of all units is written by several tasks.
FILES_PER_DATABASE = 4


def _scan_name(at: datetime) -> str:
    return f"{at:%Y%m%d%H%M%S%f}"


def _write(units: DataFrame, path: str) -> None:
    names = [field.split()[0] for field in UNITS.split(", ")]
    kinds = dict(field.split() for field in UNITS.split(", "))
    typed = units.select(*[F.col(name).cast(kinds[name]).alias(name) for name in names])
    salt = F.pmod(F.xxhash64(*[F.col(name) for name in UNIT]), F.lit(FILES_PER_DATABASE))
    (
        typed.repartition(*SCOPE, salt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scan", *SCOPE)
        .parquet(f"{path}/units")
    )


def store_scan(status: DataFrame, path: str, at: datetime) -> None:
    """Make ``status`` (``scan_status``) the current one; earlier scans stay until they are removed."""
    stamp = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    _write(status.withColumns({"scan": F.lit(_scan_name(at)), "scanDate": stamp}), path)
    done = status.sparkSession.range(1).select(F.lit(_scan_name(at)).alias("scan"), stamp.alias("scanDate"))
    # A folder for each scan: a repeated one replaces its row.
    done.write.mode("overwrite").parquet(f"{path}/scans/of={_scan_name(at)}")


def last_scan(spark: SparkSession, path: str) -> datetime | None:
    """When the units were scanned last; None if they never were."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scans")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(SCANS).parquet(f"{path}/scans").agg(F.max("scanDate")).first()[0]


def current_status(spark: SparkSession, path: str) -> DataFrame | None:
    """The units of the last scan as they stand now; None if they were never scanned.  Older scans are not read."""
    at = last_scan(spark, path)
    if at is None:
        return None
    return spark.read.schema(UNITS).parquet(f"{path}/units").where(F.col("scan") == _scan_name(at))


def mark_units(events: DataFrame, path: str) -> None:
    """Take over what a run did from its events (``UNIT``, ``event``, ``event_ts``).

    A unit whose work ended, well or not, or that nothing can be done about, is done; whatever was done or printed
    is not printed again.  Events from before the last scan are of units that were replaced and change nothing.
    """
    spark = events.sparkSession
    status = current_status(spark, path)
    if status is None:
        return
    recent = events.where(F.col("event_ts") >= moment(last_scan(spark, path), events, "event_ts"))
    ended = F.when(F.col("event").isin(FINISHED, FAILED, SKIPPED), F.col("event_ts").cast("timestamp_ntz"))
    seen = F.col("event").isin(FINISHED, FAILED, SKIPPED, PRINTED)
    changes = recent.where(seen).groupBy(*UNIT).agg(F.max(ended).alias("_done"))
    touched = changes.select(*SCOPE).distinct()
    marked = status.join(touched, list(SCOPE), "left_semi").join(
        changes.withColumn("_seen", F.lit(True)), list(UNIT), "left"
    )
    _write(
        marked.withColumns(
            {
                "defragDate": F.greatest("defragDate", "_done"),
                "printStatus": F.col("printStatus") | F.coalesce("_seen", F.lit(False)),
            }
        ),
        path,
    )
