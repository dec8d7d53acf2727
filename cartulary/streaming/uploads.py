"""Uploads put together from a stream of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the largest upload unless told.
MOST_BYTES = 134_217_728

UPLOAD = "upload_id string, status string, reason string, metadata string, content binary, size long"


class Uploads(StatefulProcessor):
    """Keyed by upload: messages (upload_id, seq, kind, metadata, data). The first (seq 0) is of the kind metadata, and
    no other is; chunks follow; the last is of the kind end. Messages may come in any order and more than once.

    An upload whose messages are all there is done, with its chunks in order. One that breaks these rules, or grows
    beyond ``most_bytes``, is rejected at once with the reason, and what it held is let go; one that is not finished
    after ``timeout_ms`` is rejected too. What comes for an ended upload later is passed over until then.
    """

    def __init__(self, most_bytes: int = MOST_BYTES, timeout_ms: int = 3_600_000):
        self.most_bytes, self.timeout_ms = most_bytes, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "metadata string, size long, messages long, last long, ended boolean")
        self.chunks = handle.getMapState("chunks", "seq long", "data binary")

    def _end(self, key: tuple, status: str, reason: str | None, metadata: str | None, content: bytes | None, size: int) -> pd.DataFrame:
        self.chunks.clear()
        self.head.update((None, 0, 0, -1, True))
        return pd.DataFrame([(key[0], status, reason, metadata, content, size)], columns=["upload_id", "status", "reason", "metadata", "content", "size"])

    def _fault(self, r) -> str | None:
        if (r.kind == "metadata") != (r.seq == 0):
            return "metadata must appear exactly once as the first message" if r.kind == "metadata" else "first message must contain metadata"
        return None if r.kind in ("metadata", "chunk", "end") else f"unknown message {r.kind}"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.head.exists():
            self.head.update((None, 0, 0, -1, False))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        metadata, size, messages, last, ended = self.head.get()
        for batch in rows:
            for r in batch.itertuples():
                if ended:
                    continue
                if reason := self._fault(r):
                    yield self._end(key, "rejected", reason, None, None, size)
                    ended = True
                elif not self.chunks.containsKey((int(r.seq),)):
                    data = bytes(r.data) if r.kind == "chunk" and r.data is not None else b""
                    self.chunks.updateValue((int(r.seq),), (data,))
                    messages, size = messages + 1, size + len(data)
                    metadata = (r.metadata or "") if r.kind == "metadata" else metadata
                    last = int(r.seq) if r.kind == "end" else last
                    if size > self.most_bytes:
                        yield self._end(key, "rejected", f"upload exceeds maximum size of {self.most_bytes} bytes", None, None, size)
                        ended = True
        if not ended and last >= 0 and messages > last:
            parts = sorted((seq, data) for (seq,), (data,) in self.chunks.iterator() if seq <= last)  # none behind the end
            if len(parts) == last + 1:
                content = b"".join(bytes(d) for _, d in parts)
                yield self._end(key, "done", None, metadata, content, len(content))
                ended = True
        if not ended:
            self.head.update((metadata, size, messages, last, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, size, _, _, ended = self.head.get()
        if not ended:
            yield self._end(key, "rejected", "timeout", None, None, size)
        self.head.clear()

    def close(self) -> None:
        pass


def uploads(messages: DataFrame, most_bytes: int = MOST_BYTES, timeout_ms: int = 3_600_000) -> DataFrame:
    """A row for each upload of a stream of messages that ended: done with its content, or rejected with the reason."""
    own = messages.select("upload_id", "seq", "kind", "metadata", "data")
    return own.groupBy("upload_id").transformWithStateInPandas(Uploads(most_bytes, timeout_ms), UPLOAD, "Append", "ProcessingTime")
