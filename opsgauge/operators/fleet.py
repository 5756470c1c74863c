"""The same analysis over every database of a fleet, as one job."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.operators import SCOPE
from opsgauge.operators.splitting import filter_by_list

# Databases that belong to the server itself.
MAINTENANCE_EXCLUDED = ("master", "tempdb")
REPORT_EXCLUDED = ("tempdb", "master", "msdb", "model")

ONLINE = 0


def user_databases(
    databases: DataFrame,
    exclude: Iterable[str] = MAINTENANCE_EXCLUDED,
    names: str | None = None,
) -> DataFrame:
    """Databases that are online, writable and not excluded, optionally of a comma list."""
    kept = databases.where(
        (F.col("state") == ONLINE) & ~F.col("is_read_only") & ~F.col("name").isin(*exclude)
    )
    return filter_by_list(kept, "name", names)


def for_each_database(
    operator: Callable[..., DataFrame],
    snapshots: Mapping[str, DataFrame],
    databases: DataFrame | None = None,
    **parameters,
) -> DataFrame:
    """Run ``operator`` over the snapshots of all, or of the given, databases.

    Server and database are part of every key, so one plan covers the fleet and
    no loop is needed.  Snapshots without these columns are passed unchanged.
    """
    if databases is not None:
        chosen = databases.select(*SCOPE)
        snapshots = {
            name: frame.join(chosen, list(SCOPE), "left_semi") if set(SCOPE) <= set(frame.columns) else frame
            for name, frame in snapshots.items()
        }
    return operator(**snapshots, **parameters)
