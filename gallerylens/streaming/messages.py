"""Conversations that grow: each one's messages as list state of a stream.

New messages are put behind those that are there, in the order of their place; one whose id a conversation already has
takes the old one's place.  State lies in the list itself: a batch of new messages is appended and nothing else is
rewritten, unless one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "id long, role string, text string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def list_state(spark: SparkSession):
    """Streams that are started inside keep their state where lists can be appended to; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Conversation(StatefulProcessor):
    """One conversation: its messages, in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("messages", MESSAGE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["place", "id"], kind="stable")
        held = [tuple(m) for m in self.held.get()] if self.held.exists() else []
        at, fresh, changed = {m[0]: i for i, m in enumerate(held)}, [], False
        for m in new[["id", "role", "text"]].itertuples(index=False, name=None):
            m = (int(m[0]), *(None if pd.isna(x) else x for x in m[1:]))
            if m[0] in at and at[m[0]] < len(held):
                held[at[m[0]]], changed = m, True
            elif m[0] in at:
                fresh[at[m[0]] - len(held)] = m
            else:
                at[m[0]] = len(held) + len(fresh)
                fresh.append(m)
        if changed:
            self.held.put(held + fresh)
        elif fresh:
            self.held.appendList(fresh)
        whole = held + fresh
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(whole)], "messages": [[dict(zip(("id", "role", "text"), m, strict=True)) for m in whole]]})

    def close(self) -> None:
        pass


def accumulated(stream: DataFrame) -> DataFrame:
    """(conv_id, n, messages) of a stream (conv_id, id, place, role, text): a row with all messages so far for each conversation that a batch changes.

    Start it inside `list_state`, in update mode.  A message without an id or conversation is left out.
    """
    rows = stream.where("conv_id IS NOT NULL AND id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("id").cast("long").alias("id"), F.col("place").cast("long").alias("place"), "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversation(), f"conv_id long, n long, messages array<struct<{', '.join(f.replace(' ', ':', 1) for f in MESSAGE.split(', '))}>>", "Update", "None")


def batch_list(messages: DataFrame) -> DataFrame:
    """The same of a whole table: of messages of one id the last by place counts, at the place of the first."""
    own = messages.where("conv_id IS NOT NULL AND id IS NOT NULL").groupBy("conv_id", "id").agg(F.min("place").alias("first"), F.max_by(F.struct("role", "text"), "place").alias("m"))
    listed = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("first", "id", "m"))).alias("xs"))
    return listed.select("conv_id", "n", F.transform("xs", lambda x: F.struct(x["id"].alias("id"), x["m"]["role"].alias("role"), x["m"]["text"].alias("text"))).alias("messages"))
