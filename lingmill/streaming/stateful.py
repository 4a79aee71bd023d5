"""Streams: windows with watermarks, deduplication, count windows and the smoothed language prior.

Every function takes and gives a streaming DataFrame; the caller starts the query. The stateful ones
go through in_order(): rows of a key carry seq, 0, 1, 2 ... without gaps, and the last of them says
so. They may come in any order and in any batches; a row that is ahead waits as state until those
before it have come, one that comes again is left out. So results are those of one ordered pass.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ngrams import GUESS, UNSURE
from ..session import ship_package


def tumbling(events: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """Counts and sums per window; rows later than the watermark are dropped by definition."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str, *by: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, late: str, *by: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, late: str, *key: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


#: Groups that the keys of in_order() are dealt to.
BUCKETS = 2048


def in_order(rows: DataFrame, key: str, columns: list[str], begin, step, end, schema: str, wait_ms: int = 0) -> DataFrame:
    """What step() gives for the rows (key, seq, last, columns) of each key, taken by seq.

    step(key, carried, row) gives what is carried on (plain values, as JSON knows them) and rows of
    schema; end(key, carried) gives rows behind the last one. The keys of a bucket share a state row and a
    call. Where wait_ms is given, a key without news for so long is taken to its end as well, over
    whatever is missing; keys then have states of their own.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: [*rest] for k, *rest in json.loads(state.get[0])} if state.exists else {}
        out: list[tuple] = []
        over = bool(wait_ms) and state.hasTimedOut
        news = dict.fromkeys(held) if over else {}
        for batch in () if over else batches:
            for told, seq, last, *row in batch[["__key", "seq", "last", *columns]].itertuples(index=False, name=None):
                news[told] = None
                nxt, _, waiting = held.setdefault(told, [0, begin, {}])
                if nxt >= 0 and seq >= nxt:
                    waiting[str(seq)] = [bool(last), row]
        for told in news:
            nxt, carried, waiting = held[told]
            name = json.loads(told).get("k")
            while nxt >= 0 and (str(nxt) in waiting or over and waiting):
                nxt = nxt if str(nxt) in waiting else min(map(int, waiting))
                last, row = waiting.pop(str(nxt))
                carried, got = step(name, carried, row)
                out += got
                nxt += 1
                if last or over and not waiting:
                    out += end(name, carried)
                    nxt, carried, waiting = -1, None, {}
            if over and nxt >= 0:
                out += end(name, carried)
                nxt, carried = -1, None
            held[told] = [nxt, carried, waiting]
        state.update((json.dumps([[k, *rest] for k, rest in held.items()]),))
        if wait_ms and any(nxt >= 0 for nxt, *_ in held.values()):
            state.setTimeoutDuration(wait_ms)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    ship_package(rows.sparkSession)
    told = F.to_json(F.struct(F.col(key).alias("k")))
    group = told if wait_ms else F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout
    own = rows.select(group.alias("__group"), told.alias("__key"), "seq", "last", *columns)
    return own.groupBy("__group").applyInPandasWithState(run, schema, "state string", "append", timeout)


def count_windows(chunks: DataFrame, size: int = 4096) -> DataFrame:
    """path, block_start, block of an endless text: blocks of size, a quarter of it apart.

    Chunks are (path, seq, last, text); what does not fill a block waits as state of its path.
    """
    quarter = size // 4

    def step(path: str, carried: list, row: list) -> tuple[list, list[tuple]]:
        at, text = carried[0], carried[1] + row[0]
        starts = range(0, len(text) - size + 1, quarter)
        done = len(starts) * quarter
        return [at + done, text[done:]], [(path, at + k, text[k : k + size]) for k in starts]

    return in_order(chunks, "path", ["text"], [0, ""], step, lambda *_: [], "path string, block_start long, block string")


def carry_over(chunks: DataFrame, wait_ms: int = 0) -> DataFrame:
    """path, line: the lines of chunks (path, seq, last, text); the open last line comes with the last chunk."""

    def step(path: str, carried: str, row: list) -> tuple[str, list[tuple]]:
        *lines, rest = (carried + row[0]).split("\n")
        return rest, [(path, x) for x in lines]

    return in_order(chunks, "path", ["text"], "", step, lambda path, rest: [(path, rest)], "path string, line string", wait_ms)


def mixed(own: dict[str, float], prior: dict[str, float] | None, size: int, unsure: float = UNSURE) -> tuple[dict[str, float], dict[str, float]]:
    """A string's scores with the prior mixed in, and the prior after it: one step of smoothed()."""
    size = max(float(size), 1.0)
    if prior is None:
        return own, {g: s * math.log(size) for g, s in own.items() if s > GUESS}
    prior = {g: 0.25 * s for g, s in prior.items()}
    w = max(0.0, 0.5 * size ** (1 / 3) + 0.3 * (max(own.values(), default=0.0) / unsure) ** 1.33)
    share, every = w / (1 + w), {*own, *prior}
    out = {g: share * own.get(g, 0.0) + (1 - share) * prior.get(g, 0.0) / (2 + 0.25 * math.log(size)) for g in every}
    return out, {g: prior.get(g, 0.0) + own.get(g, 0.0) for g in every}


def language_prior(scored: DataFrame) -> DataFrame:
    """doc_id, line_no, guess, score: the best guess of each line, mixed with its document's decaying prior.

    Rows are (doc_id, seq, last, line_no, size, scores map); the prior is the state of a document.
    """

    def step(doc: int, prior: dict | None, row: list) -> tuple[dict, list[tuple]]:
        line, size, scores = row
        got, prior = mixed(scores, prior, size)
        best = max(sorted(got), key=got.get)
        return prior, [(doc, line, best, got[best])]

    told = scored.withColumn("scores", F.to_json("scores"))
    read = lambda doc, prior, row: step(doc, prior, [row[0], row[1], json.loads(row[2])])
    return in_order(told, "doc_id", ["line_no", "size", "scores"], None, read, lambda *_: [], "doc_id long, line_no int, guess string, score double")


def redetections(strings: DataFrame, gap: int = 20, after: int = 2, least: int = 96) -> DataFrame:
    """path, offset of the strings (path, seq, last, offset, size) before which charsets are detected anew.

    That is over a gap of more bytes than given, once so many strings and bytes have been seen.
    """

    def step(path: str, carried: list, row: list) -> tuple[list, list[tuple]]:
        (end, seen, taken), (offset, size) = carried, map(int, row)
        again = offset - end > gap and seen >= after and taken >= least
        return [offset + size, seen + 1, taken + size], [(path, offset)] if again else []

    return in_order(strings, "path", ["offset", "size"], [0, 0, 0], step, lambda *_: [], "path string, offset long")


def reminders(events: DataFrame, key: str, every_ms: int) -> DataFrame:
    """key, n: how many rows a key had, told each time none came for so many milliseconds of processing time."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.setTimeoutDuration(every_ms)
            yield pd.DataFrame({key: [group[0]], "n": [n]})
            return
        state.update((n + sum(len(b) for b in batches),))
        state.setTimeoutDuration(every_ms)
        yield pd.DataFrame({key: [], "n": []})

    ship_package(events.sparkSession)
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {dict(events.dtypes)[key]}, n long", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def settled(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives once its input is used up, as a table at path.

    Each batch is a folder that a repeated batch overwrites; a complete result is its last batch.
    """
    last = []

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        last.append(batch)

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if not last:
        return spark.createDataFrame([], stream.schema)
    where = f"{path}/batch={last[-1]}" if mode == "complete" else path
    return spark.read.parquet(where).select(*stream.columns)
