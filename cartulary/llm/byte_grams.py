"""Hashed byte trigrams of whole texts, an Arrow batch at a time.

A batch's texts lie end to end in one buffer, so a trigram's bucket is found for all of them at once; sums over a
document or a passage are sums over a stretch of the buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_FOLD[48:58] = 48


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and the last ends; null is empty."""
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of rows with at most ``most`` bytes of text each (a longer text is a run of its own), so that
    arrays of numbers for every byte stay small."""
    starts = buffer(batch.column(column))[1]
    a = 0
    while a < batch.num_rows:
        b = max(int(np.searchsorted(starts, starts[a] + most, side="right")) - 1, a + 1)
        yield batch.slice(a, b - a)
        a = b


def buckets(raw: np.ndarray, starts: np.ndarray, n_buckets: int, fold: bool = True) -> np.ndarray:
    """The bucket of the trigram that starts at each byte; a blank stands before and behind every text.

    ``starts`` are the texts' starts and the last one's end. Folding makes A-Z small, white space blank, digits one.
    """
    b = (_FOLD[raw] if fold else raw).astype(np.uint32)
    one, two = np.full(len(b), 32, np.uint32), np.full(len(b), 32, np.uint32)
    one[1:], two[:-1] = b[:-1], b[1:]
    lengths = np.diff(starts)
    full = lengths > 0
    one[starts[:-1][full]] = 32
    two[starts[1:][full] - 1] = 32
    h = one * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + two * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - int(n_buckets).bit_length() + 1)).astype(np.int64)


def stretches(raw: np.ndarray, starts: np.ndarray, n_buckets: int, most: int = 4 << 20):
    """(buckets, starts, first text) of runs of whole texts with at most ``most`` bytes; a longer text comes in several
    stretches, each with the buckets that the whole text has there."""
    a = 0
    while a < len(starts) - 1:
        b = max(int(np.searchsorted(starts, starts[a] + most, side="right")) - 1, a + 1)
        own = raw[starts[a] : starts[b]]
        if len(own) <= most:
            yield buckets(own, starts[a : b + 1] - starts[a], n_buckets), starts[a : b + 1] - starts[a], a
        else:
            for at in range(0, len(own), most):
                low, high, end = max(at - 1, 0), min(at + most + 1, len(own)), min(at + most, len(own))
                codes = buckets(own[low:high], np.array([0, high - low]), n_buckets)[at - low : end - low]
                yield codes, np.array([0, len(codes)]), a
        a = b


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum over each stretch between ``starts``; an empty one sums to 0."""
    out = np.zeros(len(starts) - 1, np.float64)
    full = np.diff(starts) > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], dtype=np.float64)
    return out


def histograms(codes: np.ndarray, starts: np.ndarray, n_buckets: int) -> np.ndarray:
    """Shares of each bucket within each stretch, a row each."""
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(row * n_buckets + codes, minlength=len(lengths) * n_buckets).reshape(-1, n_buckets)
    return (counts / np.maximum(lengths, 1)[:, None]).astype(np.float32)
