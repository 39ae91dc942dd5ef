"""Streams: items are scored as files arrive, each result is written once, and a restart resumes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenqc.operators import sinks
from lumenqc.operators.shared import shared_path

#: The name of the observation that counts what comes in.
COUNTER = "rows_in"


def arriving(spark: SparkSession, folder: str, schema, files: str = "*.parquet", at_once: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, so many a trigger."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", at_once).parquet(folder)


def started(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, state: str, key: str) -> StreamingQuery:
    """Processes what has arrived and then stops.  A batch that is repeated after a loss adds nothing, as keys are written once."""
    own = hashlib.sha256(state.encode()).hexdigest()[:12]  # another state is another stream, whose batches count anew

    def put(rows: DataFrame, batch: int) -> None:
        sinks.append_once(step(rows), out, key, f"{own}-{batch}")

    counted = stream.observe(COUNTER, F.count(F.lit(1)).alias("n"))
    return counted.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def run_once(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, state: str, key: str, stop: Callable[[int], bool] | None = None) -> int:
    """Runs the stream to its end and returns how many rows came in.

    ``stop`` is asked between batches with the rows so far; once it says so the stream ends, and what hasn't been taken up stays for the
    next run from the same ``state``.
    """
    query = started(stream, step, out, state, key)
    if stop is None:
        query.awaitTermination()
    else:
        while not query.awaitTermination(1):
            if stop(rows_in(query)):
                query.stop()
    return rows_in(query)


def rows_in(query: StreamingQuery) -> int:
    """Rows of the query's completed batches, as far as its progress reaches back."""
    return sum(p.observedMetrics[COUNTER]["n"] for p in query.recentProgress if COUNTER in p.observedMetrics)


def watch_alarms(stream: DataFrame, at: str, review: F.Column, passed: F.Column, width: str = "1 hour", late: str = "1 hour", least: int = 8) -> DataFrame:
    """Event-time windows whose review rate is too high; late rows count up to ``late``."""
    rates = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.avg(review.cast("double")).alias("review_rate"), F.avg(passed.cast("double")).alias("pass_rate"))
    return rates.where((F.col("n") >= least) & (F.col("review_rate") > 0.90) & (F.col("pass_rate") < 0.05))


def rolling_means(stream: DataFrame, key: str, seconds: str, size: int = 40) -> DataFrame:
    """The mean of the last ``size`` positive seconds of each key; the state is those values alone."""

    def step(name: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        n = state.get[1] if state.exists else 0
        for part in parts:
            found = part[seconds][part[seconds] > 0].tolist()
            n += len(found)
            last = (last + found)[-size:]
        state.update((last, n))
        yield pd.DataFrame({"key": [str(name[0])], "n": [n], "mean": [sum(last) / len(last) if last else None]})

    return stream.select(key, seconds).groupBy(key).applyInPandasWithState(step, "key string, n long, mean double", "last array<double>, n long", "update", GroupStateTimeout.NoTimeout)
