"""Continuous screening of requests, with alerts and a user callback."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from promptledger.operators.scans import alerts, analyze, pii_events, scan_rows
from promptledger.streaming.sinks import write_batch

log = logging.getLogger(__name__)


def screen(
    requests: DataFrame, path: str, on_alerts: Callable[[DataFrame, int], None] | None = None
) -> DataStreamWriter:
    """Writer that stores scans, alerts and PII events of each micro-batch under ``path``.

    ``on_alerts`` gets the stored alerts of the batch; its failure is logged and stops nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        analyzed = analyze(batch).persist()
        try:
            write_batch(scan_rows(analyzed), f"{path}/scans", batch_id)
            write_batch(alerts(analyzed), f"{path}/alerts", batch_id)
        finally:
            analyzed.unpersist()
        write_batch(pii_events(batch), f"{path}/pii_events", batch_id)
        if on_alerts is not None:
            fan_out(spark.read.parquet(f"{path}/alerts/batch_id={batch_id}"), batch_id, on_alerts)

    return requests.writeStream.foreachBatch(handle)


def fan_out(stored_alerts: DataFrame, batch_id: int, callback: Callable[[DataFrame, int], None]) -> bool:
    """Hand stored alerts to a callback; true when it did not fail."""
    try:
        callback(stored_alerts, batch_id)
        return True
    except Exception:  # noqa: BLE001 - a callback must not stop the stream
        log.exception("alert callback failed for batch %s", batch_id)
        return False
