"""Streaming forms of the recipes that fold: sums, means, counts, drawdown, quantiles, eras."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.evaluate import evaluate


def folds(events: DataFrame, key: str, value: str, ts: str = "ts", window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """column_sum, column_mean and row_count of each key and event-time window."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    return timed.groupBy(F.window("__ts", window), F.col(key).alias("g")).agg(F.sum(value).alias("column_sum"), F.avg(value).alias("column_mean"), F.count(F.lit(1)).alias("row_count"))


def rates(events: DataFrame, key: str, ts: str = "ts", window: str = "1 minute", watermark: str = "5 minutes") -> DataFrame:
    """Requests of each key in tumbling windows, for admission limits."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    return timed.groupBy(F.window("__ts", window), F.col(key).alias("g")).agg(F.count(F.lit(1)).alias("requests"))


def _drawdown(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    equity, peak, worst, last = state.get if state.exists else (1.0, 1.0, 0.0, -(1 << 62))
    rows = pd.concat(list(batches)).sort_values("pos")
    for pos, r in zip(rows["pos"], rows["r"], strict=True):
        equity *= 1 + r
        peak = max(peak, equity)
        worst = min(worst, equity / peak - 1)
        last = max(last, int(pos))
    state.update((equity, peak, worst, last))
    yield pd.DataFrame({"g": [key[0]], "max_drawdown": [worst], "pos": [last]})


def max_drawdown(returns: DataFrame, key: str = "g") -> DataFrame:
    """Running worst drawdown of each series of (key, pos, r); rows of a series arrive in order.

    The state is four numbers per series.
    """
    kind = dict(returns.dtypes)[key]
    return (
        returns.select(F.col(key).alias("g"), F.col("pos").cast("long").alias("pos"), F.col("r").cast("double").alias("r"))
        .groupBy("g")
        .applyInPandasWithState(_drawdown, f"g {kind}, max_drawdown double, pos long", "equity double, peak double, worst double, last long", "update", GroupStateTimeout.NoTimeout)
    )


#: What a series keeps between batches: its curve, the end of its last closed window, and the rows of open ones.
_CURVE = "equity double, peak double, worst double, n long, closed long, waiting binary"
#: A waiting row, packed: a key may have many.
_WAITING = np.dtype([("at", "i8"), ("pos", "i8"), ("r", "f8")])
_CLOSED = "window_end timestamp, max_drawdown double, equity double, n long"


def _closing(every: int):
    """Buffers rows until the watermark has passed their window; then folds them in order of time and place, one result a window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        equity, peak, worst, n, closed, waiting = state.get if state.exists else (1.0, 1.0, 0.0, 0, 0, b"")
        parts = [np.frombuffer(waiting, _WAITING)]
        if not state.hasTimedOut:
            for b in batches:
                rows = np.empty(len(b), _WAITING)
                # to microseconds, whatever pandas keeps
                rows["at"], rows["pos"], rows["r"] = b["ts"].astype("datetime64[us]").astype("int64"), b["pos"], b["r"]
                parts.append(rows)
        rows = np.concatenate(parts)
        del parts, waiting
        until = state.getCurrentWatermarkMs() * 1000 // every * every
        rows = rows[np.lexsort((rows["r"], rows["pos"], rows["at"]))]
        ready, rows = np.split(rows, [np.searchsorted(rows["at"], until)])
        ends = ready["at"] // every * every + every
        curve = np.multiply.accumulate(np.append(equity, 1 + ready["r"]))
        peaks = np.fmax.accumulate(np.append(peak, curve[1:]))
        depths = np.fmin.accumulate(np.append(worst, curve[1:] / peaks[1:] - 1))
        last = np.flatnonzero(np.append(ends[1:] != ends[:-1], True)) if len(ends) else np.array([], np.int64)
        out = {"g": [key[0]] * len(last), "window_end": pd.to_datetime(ends[last], unit="us"), "max_drawdown": depths[last + 1], "equity": curve[last + 1], "n": n + last + 1}
        closed = int(ends[-1]) if len(ends) else closed
        state.update((float(curve[-1]), float(peaks[-1]), float(depths[-1]), n + len(ready), closed, rows.tobytes()))
        if len(rows):
            state.setTimeoutTimestamp(max(int(rows["at"][0]) // every * every + every, until + 1000) // 1000)
        yield pd.DataFrame(out)

    return run


def drawdown_by_window(returns: DataFrame, key: str = "g", ts: str = "ts", pos: str = "pos", value: str = "r", every: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Worst drawdown of each series up to the end of each window that is closed: rows (g, window_end, max_drawdown, equity, n).

    Rows may come in any order within the watermark: they wait in the state until it has
    passed their window, a timer sees to that where no more rows come, and are folded
    in order of (ts, pos). Results are final, so that file sinks can take them; the state is
    the curve's four numbers and the rows of open windows.
    """
    kind = dict(returns.dtypes)[key]
    micros = int(pd.Timedelta(every).total_seconds() * 1_000_000)
    rows = returns.select(F.col(key).alias("g"), F.col(ts).cast("timestamp").alias("ts"), F.col(pos).cast("long").alias("pos"), F.col(value).cast("double").alias("r"))
    return rows.withWatermark("ts", watermark).groupBy("g").applyInPandasWithState(_closing(micros), f"g {kind}, {_CLOSED}", _CURVE, "append", GroupStateTimeout.EventTimeTimeout)


def exact_on_batches(stream: DataFrame, store: str, ids: list[str], sink: Callable[[DataFrame, int], None], key: str = "g"):
    """Recipes that need all rows (quantiles, eras): each batch joins a store, touched keys are computed anew.

    Batches are written to a folder of their own, so a repeated batch replaces itself, and
    a key sees the batches up to its own only.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={epoch}")
        touched = batch.select(key).distinct()
        everything = spark.read.option("basePath", store).schema(batch.schema.add("batch", "long")).parquet(store).where(F.col("batch") <= epoch).drop("batch")
        sink(evaluate(everything.join(touched, key, "left_semi"), ids, key=key), epoch)

    return stream.writeStream.foreachBatch(run)


def results_by_batch(results: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``exact_on_batches``: results of each batch in a folder of its own, written over if the batch is repeated."""

    def sink(found: DataFrame, epoch: int) -> None:
        found.write.mode("overwrite").parquet(f"{results}/batch={epoch}")

    return sink


def latest(spark: SparkSession, results: str) -> DataFrame:
    """The last result of each key and recipe of what ``results_by_batch`` wrote."""
    every = spark.read.option("basePath", results).parquet(results)
    last = every.groupBy("g", "recipe").agg(F.max_by(F.struct("value", "degenerate"), "batch").alias("last"))
    return last.select("g", "recipe", "last.*")
