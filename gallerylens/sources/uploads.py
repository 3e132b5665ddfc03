"""Uploading rows to a store as a data source: batches are staged by tasks, and become visible all at once.

A task sends its rows in batches under names of the run, its partition and its attempt; nobody sees them.  Once all
tasks are done the run is published: one message names the batches of those attempts that Spark took.  What a failed
or doubled attempt has staged is never named; a run that fails is dropped, and one that was published before changes
nothing.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class Store(Protocol):
    """What rows are sent to; all of it may be called again with the same arguments."""

    def stage(self, run: str, batch: str, rows: list[dict]) -> None: ...

    def publish(self, run: str, batches: list[str]) -> None: ...

    def published(self, run: str) -> bool: ...

    def drop(self, run: str) -> None: ...


@dataclass
class Sent(WriterCommitMessage):
    batches: list[str]
    rows: int


class FolderStore:
    """Batches as files below a folder that all machines share; a run's list of batches, put there in one step, is what makes them visible."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _put(self, name: str, value: object) -> None:
        target = f"{self.path}/{name}.json"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        made = f"{target}.{os.getpid()}.{time.monotonic_ns()}"
        with open(made, "w", encoding="utf-8") as file:
            json.dump(value, file)
        os.replace(made, target)

    def stage(self, run: str, batch: str, rows: list[dict]) -> None:
        self._put(f"staged/{run}/{batch}", rows)

    def publish(self, run: str, batches: list[str]) -> None:
        self._put(f"runs/{run}", sorted(batches))
        named = {f"{b}.json" for b in batches}
        for file in os.listdir(f"{self.path}/staged/{run}") if batches else ():
            if file not in named:
                os.unlink(f"{self.path}/staged/{run}/{file}")

    def published(self, run: str) -> bool:
        return os.path.exists(f"{self.path}/runs/{run}.json")

    def drop(self, run: str) -> None:
        folder = f"{self.path}/staged/{run}"
        for file in os.listdir(folder) if os.path.isdir(folder) and not self.published(run) else ():
            os.unlink(f"{folder}/{file}")

    def rows(self) -> list[dict]:
        """All that is visible; for small stores."""
        out = []
        runs = f"{self.path}/runs"
        for name in sorted(os.listdir(runs)) if os.path.isdir(runs) else ():
            with open(f"{runs}/{name}", encoding="utf-8") as file:
                for batch in json.load(file):
                    with open(f"{self.path}/staged/{name.removesuffix('.json')}/{batch}.json", encoding="utf-8") as held:
                        out += json.load(held)
        return out


def _again(what: Callable[[], None], attempts: int, delay: float) -> None:
    for n in range(attempts):
        try:
            return what()
        except Exception:
            if n == attempts - 1:
                raise
            time.sleep(delay * 2**n)


class Writer(DataSourceWriter):
    def __init__(self, store: Store, run: str, batch: int, attempts: int, delay: float) -> None:
        self.store, self.run, self.batch, self.attempts, self.delay = store, run, batch, attempts, delay
        self.skip = store.published(run)

    def write(self, iterator) -> Sent:
        task = TaskContext.get()
        sent, held, count = [], [], 0

        def flush() -> None:
            name = f"{task.partitionId()}-{task.taskAttemptId()}-{len(sent)}"
            _again(lambda: self.store.stage(self.run, name, held), self.attempts, self.delay)
            sent.append(name)

        for row in () if self.skip else iterator:
            held.append(row.asDict(recursive=True))
            count += 1
            if len(held) == self.batch:
                flush()
                held = []
        if held:
            flush()
        return Sent(sent, count)

    def commit(self, messages: list[Sent]) -> None:
        if not self.skip:
            _again(lambda: self.store.publish(self.run, [b for m in messages if m for b in m.batches]), self.attempts, self.delay)

    def abort(self, messages: list[Sent]) -> None:
        if not self.skip:
            self.store.drop(self.run)


def upload(df: DataFrame, store: Store, run: str, batch: int = 512, attempts: int = 5, delay: float = 0.5) -> None:
    """Sends df to the store as one run: after a failure nothing of it is visible, and after a rerun nothing twice.

    A batch, and the run's publication, is tried again up to attempts times, each after twice the delay.
    """

    class Uploads(DataSource):
        @classmethod
        def name(cls) -> str:
            return "uploads"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer(store, run, batch, attempts, delay)

    df.sparkSession.dataSource.register(Uploads)
    df.write.format("uploads").mode("append").save()
