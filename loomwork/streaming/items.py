"""Items that arrive in parts, as a stream: each is emitted once, when its last part has come, or as far as it came when the watermark has passed it."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUTPUT = "key string, text string, parts int, complete boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Joined(StatefulProcessor):
    """State of a key: its parts so far. A part that comes again counts once; the state goes when the item is emitted and its time is over."""

    def __init__(self, wait_ms):
        self.wait_ms = wait_ms

    def init(self, handle):
        self.handle = handle
        self.parts = handle.getListState("parts", "part int, text string")
        self.emitted = handle.getValueState("emitted", "emitted boolean")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        if self.emitted.exists():
            return
        known = {p: t for p, t in self.parts.get()}
        fresh = {int(p): t for p, t in zip(new["part"], new["text"], strict=True) if int(p) not in known}
        if not known:  # one timer for each item, whatever becomes of it
            self.handle.registerTimer(int(new["ts"].max().timestamp() * 1000) + self.wait_ms)
        if len(known) + len(fresh) == int(new["of"].iloc[0]):
            self.emitted.update((True,))
            self.parts.clear()
            yield self._row(key, {**known, **fresh}, True)
        else:
            self.parts.appendList(list(fresh.items()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = {} if self.emitted.exists() else {p: t for p, t in self.parts.get()}
        self.parts.clear()
        self.emitted.clear()
        if known:
            yield self._row(key, known, False)

    def close(self):
        pass

    @staticmethod
    def _row(key, parts, complete):
        return pd.DataFrame({"key": [key[0]], "text": ["".join(parts[p] or "" for p in sorted(parts))], "parts": [len(parts)], "complete": [complete]}).astype({"parts": "int32"})


def join_parts(parts, wait="1 hour"):
    """Items of the stream ``parts(key, part, of, text, ts)``: key, text, parts, complete. ``of`` is an item's number of parts.

    Parts may come in any order and batch. Null keys are left out. The session's state store must be RocksDB (``with_rocksdb``).
    """
    seconds = pd.Timedelta(wait).total_seconds()
    rows = parts.where("key is not null").withWatermark("ts", wait)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Joined(int(seconds * 1000)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def with_rocksdb(spark):
    """Sets the state store that lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run(items, out, checkpoint):
    """Appends the items to ``out``, a folder for each batch, until the input is read."""

    def write(batch, number):
        batch.select("key", "text", "parts", "complete").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return items.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slices(text, of):
    """A text cut into ``of`` parts of about one length: structs part, text."""
    step = F.ceil(F.length(text) / F.lit(float(of))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(of - 1)), lambda k: F.struct(k.alias("part"), F.substring(text, k * step + 1, step).alias("text")))
