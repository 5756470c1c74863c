"""Numbers of streamed tokens within their publication, in the order they were posted.

Rows arrive in any order and in batches of any size.  Each publication keeps those that an earlier token
could still precede; once the watermark has passed a token it is numbered after the last one.
The numbers are those of the batch, whatever the batches and restarts were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_WAITING = (
    "tracer_id bigint, post_us bigint, distributor_latency bigint, subscriber string, subscriber_db string, "
    "subscriber_latency bigint, overall_latency bigint"
)
_NUMBERED = "server string, publication string, iteration bigint, " + _WAITING
_NAMES = [field.split()[0] for field in _WAITING.split(", ")]
# Rows of one publication that leave the state together.
_ROWS_AT_ONCE = 100_000


def _ripe_at(post_us: int) -> int:
    """The watermark, in milliseconds, that no row of an earlier or equal time can follow."""
    return -(-post_us // 1000)


def _packed(rows: pd.DataFrame) -> tuple[int, int, bytes]:
    """Waiting rows as one value of the state, with their first and last time."""
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return int(rows["post_us"].min()), int(rows["post_us"].max()), sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()


class _Numbering(StatefulProcessor):
    """State of one publication: the number of its last token and the rows that wait for theirs.

    Waiting rows are bounded by what is posted during the lateness of the stream and what one batch brings.  They are
    kept and numbered many at a time, as columns.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "iteration bigint")
        self._waiting = handle.getListState("waiting", "first_us bigint, last_us bigint, packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [_packed(part[_NAMES]) for part in rows if len(part)]
        if fresh:
            self._waiting.appendList(fresh)
            self._handle.registerTimer(_ripe_at(min(first for first, _, _ in fresh)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000  # what is posted up to here is ripe
        ripe, rest = [], []
        for first, last, packed in self._waiting.get():
            if first > until:
                rest.append((first, last, packed))
                continue
            rows = _unpacked(packed)
            if last > until:
                rest.append(_packed(rows[rows["post_us"] > until]))
                rows = rows[rows["post_us"] <= until]
            ripe.append(rows)
        if not ripe:
            return
        if rest:
            self._waiting.put(rest)
            self._handle.registerTimer(_ripe_at(min(first for first, _, _ in rest)))
        else:
            self._waiting.clear()
        rows = pd.concat(ripe, ignore_index=True).sort_values(["post_us", "tracer_id"], ignore_index=True)
        token = rows[["post_us", "tracer_id"]]
        number = self._last.get()[0] if self._last.exists() else 0
        rows.insert(0, "iteration", number + (token != token.shift()).any(axis=1).cumsum())
        rows.insert(0, "publication", key[1])
        rows.insert(0, "server", key[0])
        for start in range(0, len(rows), _ROWS_AT_ONCE):
            yield rows.iloc[start : start + _ROWS_AT_ONCE]
        self._last.update((int(rows["iteration"].iloc[-1]),))

    def close(self) -> None:
        pass


def numbered_latency(latencies: DataFrame) -> DataFrame:
    """``iteration`` added to the rows of ``stream_latency``: a token's number within its publication.

    All rows of a token have its number.  A token is reported once the watermark has passed it; one that comes
    later than the lateness of the stream is left out, as by every operator with a watermark.  Needs the RocksDB
    state store (``stream_session`` sets it).
    """
    timed = latencies.withColumn("post_us", F.unix_micros("post_ts"))
    numbered = timed.groupBy("server", "publication").transformWithStateInPandas(
        statefulProcessor=_Numbering(), outputStructType=_NUMBERED, outputMode="Append", timeMode="EventTime"
    )
    return numbered.withColumn("post_ts", F.timestamp_micros("post_us")).drop("post_us")
