"""Delivery of alerts to a user's function: a data source with a streaming writer that calls it once for each alert, however often a batch is repeated.

Nothing is posted by itself: without a function rows are only counted. A delivered alert leaves a mark under its key in the ledger's folder (any store that pyarrow reaches), and a marked one is not
delivered again. A worker that dies between a call and its mark is the one case in which an alert comes twice; the key is handed to the function, so that a receiver can tell.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

PAYLOAD = ("alert_id", "org_id", "alert_type", "severity", "title", "description")
URGENT = ("high", "critical")


@dataclass
class Delivered(WriterCommitMessage):
    called: int
    known: int
    failed: int


class Writer(DataSourceStreamWriter):
    def __init__(self, deliver: Callable[[str, dict], None] | None, ledger: str):
        self.deliver, self.ledger = deliver, ledger

    def write(self, rows: Iterator) -> Delivered:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.ledger if "://" in self.ledger else f"file://{self.ledger}")
        store.create_dir(f"{root}/delivered", recursive=True)
        called = known = failed = 0
        for row in rows:
            payload = {c: row[c] for c in PAYLOAD}
            key = hashlib.sha256(json.dumps(payload["alert_id"]).encode()).hexdigest()
            mark = f"{root}/delivered/{key}"
            if store.get_file_info(mark).type != fs.FileType.NotFound:
                known += 1
                continue
            try:
                if self.deliver is not None:
                    self.deliver(key, payload)
            except Exception:  # a receiver that fails is asked again with the next batch that holds the alert
                failed += 1
                continue
            called += 1
            with store.open_output_stream(mark) as file:
                file.write(json.dumps(payload, default=str).encode())
        return Delivered(called, known, failed)

    def commit(self, messages: list, batch_id: int) -> None:
        self._note("commit", messages, batch_id)

    def abort(self, messages: list, batch_id: int) -> None:
        """What was delivered stays delivered: its marks keep the repeated batch from calling again."""
        self._note("abort", messages, batch_id)

    def _note(self, what: str, messages: list, batch_id: int) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.ledger if "://" in self.ledger else f"file://{self.ledger}")
        store.create_dir(f"{root}/batches", recursive=True)
        done = [m for m in messages if m is not None]
        with store.open_output_stream(f"{root}/batches/{batch_id}-{what}.json") as file:
            file.write(json.dumps({c: sum(getattr(m, c) for m in done) for c in ("called", "known", "failed")}).encode())


def alert_hook(deliver: Callable[[str, dict], None] | None = None, name: str = "alert_hook") -> type[DataSource]:
    """A data source to register; its option `ledger` names the folder of marks. deliver gets a key and the alert's payload."""

    class AlertHook(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema, overwrite: bool) -> Writer:
            return Writer(deliver, dict(self.options)["ledger"])

    return AlertHook


def urgent(alerts: DataFrame) -> DataFrame:
    """The alerts that are delivered, with the columns of the payload."""
    return alerts.where(F.col("severity").isin(*URGENT)).select(*PAYLOAD)
