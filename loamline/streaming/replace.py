"""Replacements across micro-batches: each kind's queue with its cursor and usage counts in the state store."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cursor(StatefulProcessor):
    """A kind's items in their order, where its queue stands, and how often it has begun again: an item's uses follow from these."""

    def __init__(self, kind: str, columns: list[str], pos: str):
        self.kind, self.columns, self.pos = kind, columns, pos

    def init(self, handle) -> None:
        self.at = handle.getValueState("at", "size long, cursor long, rounds long")
        self.line = handle.getMapState("line", "nth long", "item string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        items = initialState.sort_values(["_o", "item"])["item"].tolist()
        for i, item in enumerate(items):
            self.line.updateValue((i,), (item,))
        self.at.update((len(items), 0, 0))

    def handleInputRows(self, key, rows, timerValues):
        asked = pd.concat(list(rows)).sort_values(self.pos)
        if not self.at.exists():  # a kind without a queue
            return
        size, cursor, rounds = self.at.get()
        items, used, seen = [], [], {}
        for _ in range(len(asked)):
            if cursor not in seen:
                seen[cursor] = self.line.getValue((cursor,))[0]
            items.append(seen[cursor])
            used.append(rounds + 1)
            cursor += 1
            if cursor == size:
                cursor, rounds = 0, rounds + 1
        self.at.update((size, cursor, rounds))
        yield asked[self.columns].assign(item=items, used=used)

    def close(self) -> None:
        pass


def replaced(requests: DataFrame, kind: str, pos: str, queue: DataFrame, item: str, order: str) -> DataFrame:
    """A stream of requests, each with its replacement: what training.replacements() gives for all of them at once, whatever the micro-batches, and also after a restart.

    The k-th request of a kind gets the k-th distinct item of its queue (kind, item, order), which starts again at its end; adds the item as a string and used, how often it has
    been given so far. Requests of one batch are taken by pos, batches as they come; requests of a kind without a queue have none. The queue is the state that the first
    batch begins with, and a restart goes on from the checkpoint. A kind's state is its items, one row each, and one row for its cursor.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if {item, "used"} & set(requests.columns):
        raise ValueError("requests have a column of the result's name")
    first = queue.groupBy(kind, F.col(item).cast("string").alias("item")).agg(F.min(order).alias("_o"))
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in requests.columns) + "item string, used long"
    out = requests.groupBy(kind).transformWithStateInPandas(Cursor(kind, requests.columns, pos), schema, "append", "none", first.groupBy(kind))
    return out.withColumnRenamed("item", item)
