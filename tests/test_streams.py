"""Streams that are stopped and started again, rows out of order, repeated batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.streaming import reducers

SCHEMA = "g string, ts timestamp, pos long, r double"
START = datetime(2024, 1, 1)


def rows_of(seed, begin_minute, minutes, n):
    rng = random.Random(seed)
    return [(rng.choice("ab"), START + timedelta(minutes=begin_minute + rng.random() * minutes), rng.randrange(10**6), rng.choice([-1.5, -1.0, -0.2, 0.1, 0.3]) if rng.random() < 0.02 else rng.gauss(0, 0.02)) for _ in range(n)]


def folded(rows, until):
    """Worst drawdown, equity and rows at the end of each hour with rows that ends by ``until``."""
    out = {}
    for g in {r[0] for r in rows}:
        equity = peak = 1.0
        worst, n = 0.0, 0
        for _, ts, _, r in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            end = ts.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
            if end > until:
                break
            equity *= 1 + r
            peak = max(peak, equity)
            worst, n = min(worst, equity / peak - 1), n + 1
            out[g, end] = (worst, equity, n)
    return out


def test_drawdown_restarted_half_way(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    # the second part begins before the first one ends, within the watermark
    parts = [rows_of(1, 0, 300, 400), rows_of(2, 285, 400, 500)]

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        found = reducers.drawdown_by_window(stream, watermark="30 minutes")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return {(r.g, r.window_end): (r.max_drawdown, r.equity, r.n) for r in spark.read.parquet(out).collect()}

    spark.createDataFrame(parts[0], SCHEMA).repartition(3).write.parquet(source)
    first = run()
    assert first and all(end <= START + timedelta(minutes=270) for _, end in first)
    late = [("a", START + timedelta(minutes=1), 5, -0.9)]  # long after its window is closed
    spark.createDataFrame(parts[1] + late, SCHEMA).write.mode("append").parquet(source)
    both = run()
    assert first.items() <= both.items()
    rows = parts[0] + parts[1]
    want = folded(rows, max(r[1] for r in rows) - timedelta(minutes=30))
    assert both.keys() == want.keys()
    for k, v in want.items():
        assert both[k] == pytest.approx(v, rel=1e-9, abs=1e-12)
    assert spark.read.parquet(out).count() == len(want)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    sink = reducers.results_by_batch(out)
    batches = [[("a", 1.0), ("a", 5.0), ("b", 2.0)], [("a", 9.0)], [("b", 4.0), ("c", 7.0)]]
    seen = []

    class Stream:
        """Hands the function of foreachBatch out."""

        def foreachBatch(self, f):
            seen.append(f)
            return self

        writeStream = property(lambda self: self)

    reducers.exact_on_batches(Stream(), store, ["column_median", "row_count"], sink)
    (run,) = seen
    for epoch in (0, 1, 1, 2, 1, 2):  # as after failures
        run(spark.createDataFrame(batches[epoch], "g string, x double"), epoch)
    got = {(r.g, r.recipe): r.value for r in reducers.latest(spark, out).collect()}
    assert got == {("a", "column_median"): 5, ("a", "row_count"): 3, ("b", "column_median"): 3, ("b", "row_count"): 2, ("c", "column_median"): 7, ("c", "row_count"): 1}
    assert spark.read.parquet(store).agg(F.count(F.lit(1))).first()[0] == 6


def test_waiting_rows_are_packed():
    import tracemalloc

    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, kept):
            self.kept = kept

        def setTimeoutTimestamp(self, at):
            self.at = at

    n, state = 200_000, State()
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="s"), "pos": range(n), "r": 0.01})
    tracemalloc.start()
    (out,) = reducers._closing(3_600_000_000)(("a",), iter([rows]), state)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.empty and len(state.kept[-1]) == 24 * n
    assert peak < 150 * n
