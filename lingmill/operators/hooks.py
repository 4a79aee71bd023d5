"""Places where a caller's own functions run: row sinks, callbacks of enumerations, measures, groups, plug-ins, sources.

A hook that a column expression can state takes one and stays in the JVM. Python functions get
Arrow batches, never single rows, but for sinks on the driver, whose rows come in bounded parts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQueryListener

from ..session import ship_package

Batches = Iterator[pa.RecordBatch]


# rows out


def each_row(rows: DataFrame, sink: Callable[[dict], None]) -> int:
    """Calls sink on the driver with every row, partition by partition; gives their number."""
    n = 0
    for row in rows.toLocalIterator(prefetchPartitions=False):
        sink(row.asDict(recursive=True))
        n += 1
    return n


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that hands every batch to sink, once per batch id, and stops when its input is used up."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notified(spark: SparkSession, call: Callable[[str, dict], None]) -> StreamingQueryListener:
    """Calls call(event, facts) when a stream starts, gets on or ends; give the result to spark.streams.removeListener()."""

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:  # noqa: N802
            call("started", {"id": str(event.id), "name": event.name})

        def onQueryProgress(self, event) -> None:  # noqa: N802
            call("progress", {"id": str(event.progress.id), "batch": event.progress.batchId, "rows": event.progress.numInputRows})

        def onQueryIdle(self, event) -> None:  # noqa: N802
            call("idle", {"id": str(event.id)})

        def onQueryTerminated(self, event) -> None:  # noqa: N802
            call("ended", {"id": str(event.id), "error": event.exception})

    out = Listener()
    spark.streams.addListener(out)
    return out


def received(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines that a server sends, as a stream."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


# enumerations


def enumerated(keys: DataFrame, call: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What call makes of batches of keys, in the order of the first column inside partitions that are ranges of it."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = call(batch)
            if out is not None:
                yield out

    ship_package(keys.sparkSession)
    first = keys.columns[0]
    return keys.repartitionByRange(first).sortWithinPartitions(first).mapInArrow(run, schema)


def matched(keys: DataFrame, pattern: str, call: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """enumerated() over the keys whose first column matches the pattern as a whole."""
    return enumerated(keys.filter(F.col(keys.columns[0]).rlike(f"^(?:{pattern})$")), call, schema)


def worked(rows: DataFrame, work: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """A task's rows through work, which gets and gives Arrow batches."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(work, schema)


# measures, weights and groups


def measured(pairs: DataFrame, one: str, two: str, measure: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """pairs with sim, a measure of two vectors of equal length; null where one is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(measure(np.asarray(x, float), np.asarray(y, float))) for x, y in zip(a, b, strict=True)], dtype="float64")

    ship_package(pairs.sparkSession)
    return pairs.withColumn("sim", run(one, two))


def reweighted(vector: Column, weight: Callable[[Column, Column], Column], unit: bool = False) -> Column:
    """A map from term to value under weight(term, value), brought to length 1 where asked for."""
    out = F.transform_values(vector, weight)
    if not unit:
        return out
    length = F.sqrt(F.aggregate(F.map_values(out), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform_values(out, lambda _, x: x / length)).otherwise(out)


def grouped(rows: DataFrame, keys: list[str], value: str, call: Callable[[pd.Series], float]) -> DataFrame:
    """keys and result: call on all values of a group, which one task holds; built-in aggregates need no call."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> float:
        return float(call(v))

    ship_package(rows.sparkSession)
    return rows.groupBy(*keys).agg(run(value).alias("result"))


def conflict_free(assigned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters without those that hold both of a pair (one, two) that may not meet."""
    both = pairs.join(assigned.select(F.col("vec_id").alias("one"), "cluster"), "one").join(assigned.select(F.col("vec_id").alias("two"), F.col("cluster").alias("c2")), "two")
    bad = both.filter(F.col("cluster") == F.col("c2")).select("cluster").distinct()
    return assigned.join(bad, "cluster", "left_anti")


def inherited_with(frames: DataFrame, closure: DataFrame, rank: Column) -> DataFrame:
    """Fillers of every facet from the holder that rank puts first: an expression over frame, dst and depth (0: the frame's own)."""
    from pyspark.sql import Window

    own = frames.withColumn("dst", F.col("frame")).withColumn("depth", F.lit(0))
    up = closure.join(frames.withColumnRenamed("frame", "dst"), "dst").select(F.col("src").alias("frame"), "slot", "facet", "pos", "filler", "dst", "depth")
    every = own.unionByName(up).withColumn("rank", rank)
    return every.withColumn("first", F.min("rank").over(Window.partitionBy("frame", "slot", "facet"))).filter(F.col("rank") == F.col("first")).drop("first", "rank")


# plug-ins


class Scanner:
    """A plug-in in phases: start once, begin per partition, scan per batch, shut down once.

    Subclasses override what they need; begin and scan run on the workers.
    """

    schema = "path string, found string"

    def start(self, spark: SparkSession) -> None: ...

    def begin(self) -> None: ...

    def scan(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        raise NotImplementedError

    def shutdown(self) -> None: ...


def scanned(rows: DataFrame, scanners: Iterable[Scanner]) -> dict[str, DataFrame]:
    """The results of scanners over the same rows, by class name; shutdown() is the caller's, after the results are used."""
    out = {}
    for s in scanners:
        s.start(rows.sparkSession)

        def run(batches: Batches, s: Scanner = s) -> Batches:
            s.begin()
            for batch in batches:
                yield s.scan(batch)

        ship_package(rows.sparkSession)
        out[type(s).__name__] = rows.mapInArrow(run, s.schema)
    return out


# sources


class InputStream:
    """A source of bytes: read(n) gives at most n, and none at the end."""

    def read(self, n: int) -> bytes:
        raise NotImplementedError


class Noise(InputStream):
    """Bytes that a seed fixes, so many of them."""

    def __init__(self, seed: int, size: int) -> None:
        self.draw, self.left = np.random.default_rng(seed), size

    def read(self, n: int) -> bytes:
        n = min(n, self.left)
        self.left -= n
        return self.draw.bytes(n) if n else b""


class _Part(InputPartition):
    def __init__(self, seed: int, size: int) -> None:
        self.seed, self.size = seed, size


class _NoiseReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.parts, self.size, self.buffer = int(options.get("parts", 4)), int(options.get("size", 1 << 20)), int(options.get("buffer", 8192))

    def partitions(self) -> list[InputPartition]:
        return [_Part(k, self.size) for k in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        source, at = Noise(partition.seed, partition.size), 0
        while data := source.read(self.buffer):
            yield f"noise-{partition.seed}", at, bytes(data)
            at += len(data)


class _NoiseStream(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.buffer, self.most = int(options.get("buffer", 8192)), int(options.get("buffers", 4))

    def initialOffset(self) -> dict:  # noqa: N802  (names of the interface)
        return {"at": 0}

    def _rows(self, first: int, last: int) -> Iterator[tuple]:
        return iter([("noise", k * self.buffer, np.random.default_rng(k).bytes(self.buffer)) for k in range(first, last)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max(start["at"], self.most)  # what is there when it is asked
        return self._rows(start["at"], end), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._rows(start["at"], end["at"])


class NoiseSource(DataSource):
    """spark.read.format("noise"): buffers (path, offset, content) of a custom input stream; as a stream the buffers that are there."""

    @classmethod
    def name(cls) -> str:
        return "noise"

    def schema(self) -> str:
        return "path string, offset long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _NoiseReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _NoiseStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known. Its classes travel by value, as the process that plans a stream has no shipped package."""
    from pyspark import cloudpickle

    ship_package(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(NoiseSource)
