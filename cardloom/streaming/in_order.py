"""Folds over streams in event order: rows wait in state until the watermark has passed them, whatever order they arrive in.

A key's rows wait until the watermark has passed them and are then folded in the order of their times, to the microsecond. The
result is that of one sorted pass, however the rows are dealt to batches, as long as none comes more than `delay` behind the newest.
A row that comes when later ones of its key have been folded is not lost: it comes out marked `late`, unfolded, for a side output.

Each call of the state store from Python is a round trip, so the keys are dealt to BUCKETS groups whose states and waiting rows are one
value: a batch reads and writes it once a group, however many keys and rows the group has. What is rewritten in a batch
is therefore the states of all keys in the groups it meets.

Spark itself drops rows behind a watermark before an operator sees them, so the watermark that it is given lies HORIZON further back.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

#: How far behind the newest row a row may come and still reach the side output.
HORIZON_DAYS = 365
#: Groups that keys are dealt to by their hash. A stream's checkpoint depends on it.
BUCKETS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Rows (at_us: time in microseconds, row_id, values) of the keys of a group, each key's folded behind the watermark.

    fold(state, values) gives (state, output); state is a tuple, None at first. The output of every row comes out with its key and id.
    """

    def __init__(self, values: list[str], outputs: list[str], fold):
        self.values, self.outputs, self.fold = values, outputs, fold
        self.horizon = HORIZON_DAYS * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held binary")

    def close(self) -> None:
        pass

    def load(self) -> dict[str, list]:
        """[state, time of the last folded row, rows that wait] by key."""
        found = self.held.get()
        return pickle.loads(zlib.decompress(found[0])) if found else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, made, new = self.load(), [], False
        for pdf in rows:
            for name, beat, at, id_, *values in pdf[["row_key", "beat", "at_us", "row_id", *self.values]].itertuples(index=False, name=None):
                if beat:
                    continue  # it only moves the watermark
                own = held.get(name)
                if own is None:
                    own = held[name] = [None, None, []]
                if own[1] is not None and at < own[1]:
                    made.append((name, id_, True, *[None] * len(self.outputs)))
                else:
                    own[2].append((at, id_, *(None if v != v else v for v in values)))
                    new = True
        yield from self.advance(held, made, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(self.load(), [], False, timerValues)

    def advance(self, held: dict[str, list], made: list[tuple], new: bool, timerValues) -> Iterator[pd.DataFrame]:
        """Folds what lies behind the watermark, and asks to be called when it passes the earliest of the rest.

        Where nothing is new and nothing folded, the state and the timer of the call before stand.
        """
        until, first = (timerValues.getCurrentWatermarkInMs() + self.horizon) * 1000, None
        for name, own in held.items():
            state, _, waiting = own
            if not waiting:
                continue
            waiting.sort(key=itemgetter(0, 1))
            ready = bisect_left(waiting, until, key=itemgetter(0))
            for row in waiting[:ready]:
                state, output = self.fold(state, row[2:])
                made.append((name, row[1], False, *output))
            if ready:
                own[:] = state, waiting[ready - 1][0], waiting[ready:]
                new = True
            if own[2]:
                first = own[2][0][0] if first is None else min(first, own[2][0][0])
        if new:
            self.held.update((zlib.compress(pickle.dumps(held, pickle.HIGHEST_PROTOCOL), 1),))
        if new and first is not None:
            self.handle.registerTimer(first // 1000 - self.horizon + 1)
        if made:
            yield pd.DataFrame(made, columns=["row_key", "event_id", "late", *self.outputs]).astype({c: object for c in self.outputs})


def fold_in_order(rows: DataFrame, keys: list[str], values: list[str], fold, outputs: str, delay: str = "1 hour", time: str = "ts", id_: str = "event_id") -> DataFrame:
    """keys, event_id, late, and the outputs (a DDL list) of every row of a stream, folded by time and then id.

    The query must run with the state store PROVIDER (see started()). A row without an id is a heartbeat. Late rows have null outputs.
    """
    at, own = F.col(time).cast("timestamp"), F.col(id_).cast("long")
    # no column of whole numbers has nulls, as pandas would make them doubles
    named = {"row_key": F.to_json(F.struct(*keys)), "beat": own.isNull(), "at_us": F.unix_micros(at), "row_id": F.coalesce(own, F.lit(0))}
    timed = rows.withColumns({"event_time": at, "bucket": F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"), **named}).withWatermark("event_time", f"{delay} {HORIZON_DAYS} days")
    made = StructType.fromDDL(outputs)
    schema = StructType(StructType.fromDDL("row_key string, event_id long, late boolean").fields + made.fields)
    folded = timed.select("bucket", "event_time", *named, *values).groupBy("bucket").transformWithStateInPandas(OrderedFold(values, made.names, fold), schema, "Append", "EventTime")
    key = F.from_json("row_key", StructType([StructField(k, rows.schema[k].dataType) for k in keys]))
    return folded.withColumn("row_key", key).select("row_key.*", "event_id", "late", *made.names)


def started(writer, spark):
    """Starts a stream's writer with the RocksDB state store, whose checkpoints are change logs; the session's own settings are as before afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
