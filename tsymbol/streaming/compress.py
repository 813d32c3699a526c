"""Compression of streams: one pass with a few numbers of state for each series; the pieces equal those of the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsymbol.functions.kernels import EPSILON
from tsymbol.sources.shared import shared_path

STATE = "x0 double, prev double, a double, b double, m long, inc double, err double, idx long, last long"
OUT = "series_id long, idx long, len long, inc double, err double, end_value double"


def _advance(state: tuple | None, rows: Iterator[tuple[int, float]], tol: float, max_len: float) -> tuple[tuple | None, list[tuple]]:
    """The state after some (t, value) in order, and the pieces that they closed. A null value closes the series."""
    out: list[tuple] = []
    for t, x in rows:
        if x is None or x != x:
            if state and state[4]:
                out.append((state[7], state[4], state[5], state[6], state[0] + state[5]))
            state = None
            continue
        if state is None:
            state = (x, x, 0.0, 0.0, 0, 0.0, 0.0, 0, t)
            continue
        x0, prev, a, b, m, inc, err, idx, last = state
        if t <= last:
            continue  # too late: its piece may be closed
        y, m1 = x - x0, m + 1
        a1, b1, slope = a + y * y, b + m1 * y, y / m1
        e = max(a1 - 2 * slope * b1 + slope * slope * m1 * (m1 + 1) * (2 * m1 + 1) / 6, 0.0)
        if m1 == 1 or (e <= tol * (m1 - 1) + EPSILON and m1 - 1 < max_len):
            state = (x0, x, a1, b1, m1, y, 0.0 if m1 == 1 else e, idx, t)
        else:
            out.append((idx, m, inc, err, x0 + inc))
            y = x - prev
            state = (prev, x, y * y, y, 1, y, 0.0, idx + 1, t)
    return state, out


def stream_pieces(points: DataFrame, tol: float, max_len: float = float("inf"), *, quiet: str | None = None) -> DataFrame:
    """Closed pieces of points(series_id long, t long, value double), batch or stream. A row with a null value ends its series and
    closes its last piece; with `quiet` (a duration in ms, on processing time) so does silence. Rows within a micro-batch are ordered by t; a row
    that is not after the last one of its series is dropped, so order what arrives out of order by a watermarked buffer before."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        if state.hasTimedOut:
            now, out = _advance(now, iter([(0, None)]), tol, max_len)
        else:
            rows = pd.concat(list(frames)).sort_values("t", kind="stable")
            values = [None if pd.isna(v) else float(v) for v in rows["value"]]
            now, out = _advance(now, zip(rows["t"].tolist(), values, strict=True), tol, max_len)
        if now is None:
            state.remove()
        else:
            state.update(now)
            if quiet:
                state.setTimeoutDuration(int(quiet))
        if out:
            idx, m, inc, err, end = zip(*out, strict=True)
            yield pd.DataFrame({"series_id": key[0], "idx": idx, "len": m, "inc": inc, "err": err, "end_value": end})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout
    return points.groupBy("series_id").applyInPandasWithState(update, OUT, STATE, "append", timeout)


def stream_symbols(pieces: DataFrame, codebook: DataFrame) -> DataFrame:
    """Streamed pieces with label and symbol of the nearest centre of a fixed codebook."""
    from tsymbol.operators.digitize import nearest

    labelled = nearest(pieces, codebook)
    return labelled.join(codebook.select("label", "symbol"), "label")


def session_chunks(points: DataFrame, gap: str, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(series_id, session window, n, mean): series cut at gaps, with a watermark. Timestamps without a zone are read in the session's."""
    from pyspark.sql import functions as F

    rows = points.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return rows.groupBy("series_id", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def drain(rows: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A streaming operator over all of a bounded input: rows are written, streamed until none is left, and read back."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "stream")
    rows.write.parquet(f"{path}/in")
    stream = operator(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
