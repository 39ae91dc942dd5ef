"""Counters of streams that outlive their queries, and rolling state held by key."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Totals:
    """Cumulative counts in files, one a batch, in the folder ``counted`` of a stream's state.  The last two are kept."""

    def __init__(self, spark: SparkSession, state: str) -> None:
        self.jvm, self.folder = spark._jvm, f"{state}/counted"
        self.store = self.place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def place(self, name: object):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def batches(self) -> list[int]:
        folder = self.place("")
        if not self.store.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self.store.listStatus(folder) if f.getPath().getName().isdigit())

    def read(self, batch: int) -> dict[str, float]:
        stream = self.store.open(self.place(batch))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def upto(self, batch: int | None = None) -> dict[str, float]:
        """The totals up to a batch, or of all."""
        known = [b for b in self.batches() if batch is None or b <= batch]
        return self.read(known[-1]) if known else {}

    def add(self, batch: int, counts: dict[str, float]) -> None:
        """Adds a batch's counts to those before it.  The same batch once more replaces itself."""
        old = self.upto(batch - 1)
        new = {k: old.get(k, 0) + counts.get(k, 0) for k in old.keys() | counts.keys()}
        out = self.store.create(self.place(f"_{batch}"), True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self.store.delete(self.place(batch), False)
        self.store.rename(self.place(f"_{batch}"), self.place(batch))
        for b in self.batches()[:-2]:
            self.store.delete(self.place(b), False)


class Progress(StreamingQueryListener):
    """Adds up what a query's batches observe: input rows, seconds and the named observation's numbers.

    Batches count once over restarts, as totals belong to a batch's number in the stream's state, not to a run.
    """

    def __init__(self, spark: SparkSession, name: str, state: str, observation: str) -> None:
        self.totals, self.name, self.observation, self.last = Totals(spark, state), name, observation, -1

    def onQueryStarted(self, event) -> None:  # noqa: N802  names are Spark's
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name and self.observation in p.observedMetrics:
            seen = p.observedMetrics[self.observation].asDict()
            self.totals.add(p.batchId, {"batches": 1, "seconds": p.batchDuration / 1000} | {k: v or 0 for k, v in seen.items()})
            self.last = max(self.last, p.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def followed(query: StreamingQuery, progress: Progress, seconds: float = 30.0) -> dict[str, float]:
    """The totals once the listener has seen the last batch of a query that has ended."""
    seen = [p.batchId for p in query.recentProgress if progress.observation in p.observedMetrics]
    until = time.time() + seconds
    while seen and progress.last < max(seen) and time.time() < until:
        time.sleep(0.05)
    return progress.totals.upto()


class Rolling(StatefulProcessor):
    """The mean of the last positive seconds of a key, and how many there were."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", StructType([StructField("seconds", DoubleType())]))
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = [r[0] for r in self.last.get()] if self.last.exists() else []
        n = int(self.seen.get()[0]) if self.seen.exists() else 0
        for part in rows:
            found = part["seconds"][part["seconds"] > 0].tolist()
            n += len(found)
            last = (last + found)[-self.size :]
        if last:
            self.last.put([(float(x),) for x in last])
        self.seen.update((n,))
        yield pd.DataFrame({"key": [str(key[0])], "n": [n], "mean": [sum(last) / len(last) if last else None]})

    def close(self) -> None:
        pass


def rolling_state(stream: DataFrame, key: str, seconds: str, size: int = 40) -> DataFrame:
    """(key, n, mean) after each batch, with list and value state.  The session must keep its state in RocksDB (``ROCKS``).

    A key's state is ``size`` numbers and stays; expiry would need processing time, with which a stream that takes what is there never ends.
    """
    rows = stream.selectExpr(f"`{key}` as key", f"cast(`{seconds}` as double) as seconds").groupBy("key")
    return rows.transformWithStateInPandas(Rolling(size), "key string, n long, mean double", "Update", "None")
