"""Calls to language models from tasks: completions and embeddings with retries.

A client is any callable; each partition makes its own and reuses it. Without a network, ``stub_completer`` and
``stub_embedder`` answer deterministically.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Completer = Callable[[str], str]
Embedder = Callable[[list[str]], list[list[float]]]


class Retryable(Exception):
    """A failure worth another attempt: status 429 or 5xx, or the network. retry_after is in seconds."""

    def __init__(self, message: str, retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


def with_retries(call: Callable, *args, attempts: int = 4, base: float = 0.5, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """Calls until it succeeds: waits base * 2^n, a quarter more or less, ``cap`` at most; a server's wish is honoured
    up to a minute."""
    for attempt in range(attempts):
        try:
            return call(*args)
        except Retryable as e:
            if attempt == attempts - 1:
                raise
            wait = min(base * 2**attempt * random.uniform(0.75, 1.25), cap)
            sleep(min(e.retry_after, 60.0) if e.retry_after is not None else wait)


def stub_completer() -> Completer:
    """Answers by the hash of the prompt."""
    kinds = ("EQUIVALENT", "SUPERSET_OF", "CONTRIBUTES_TO", "NO_RELATIONSHIP")
    return lambda prompt: f"RELATIONSHIP: {kinds[hashlib.sha256(prompt.encode()).digest()[0] % 4]}\nCONFIDENCE: HIGH"


def stub_embedder(size: int = 32) -> Embedder:
    """Unit vectors of hashed words: texts with words in common are near."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.sha256(w.encode()).digest()
                out[i, h[0] % size] += 1 if h[1] & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    return embed


def complete(prompts: DataFrame, make: Callable[[], Completer], prompt: str = "prompt", attempts: int = 4, in_flight: int = 1, most_requests: int | None = None) -> DataFrame:
    """Adds response, error, attempts, seconds and prompt_hash (what an audit needs); one prompt's failure is its own.

    A task has ``in_flight`` prompts under way at a time. ``most_requests`` bounds those of the whole job: the prompts
    are dealt over so many tasks that no more can be. A model behind a gateway that retries by itself has one attempt.
    """
    added = {"response": "string", "error": "string", "attempts": "int", "seconds": "double", "prompt_hash": "string"}
    kept = prompts.select(*[c for c in prompts.columns if c not in added])
    if most_requests is not None:
        kept = kept.repartition(max(1, most_requests // max(in_flight, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()

        def one(text: str | None) -> tuple:
            began, tried = time.monotonic(), 0

            def attempt(p: str) -> str:
                nonlocal tried
                tried += 1
                return client(p)

            text = text or ""
            try:
                answer = with_retries(attempt, text, attempts=max(attempts, 1)), None
            except Exception as e:
                answer = None, type(e).__name__
            return *answer, tried, time.monotonic() - began, hashlib.sha256(text.encode()).hexdigest()

        with ThreadPoolExecutor(max(in_flight, 1)) as pool:
            for batch in batches:
                answers = list(pool.map(one, batch[prompt]))
                yield batch.assign(**{name: [a[i] for a in answers] for i, name in enumerate(added)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{k} {v}" for k, v in added.items())])
    return kept.mapInPandas(run, schema)


def embed(texts: DataFrame, make: Callable[[], Embedder], text: str = "text", batch_size: int = 50) -> DataFrame:
    """Adds vector, ``batch_size`` texts a call."""
    names = [c for c in texts.columns if c != "vector"]
    kept = texts.select(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            values = batch[text].fillna("").tolist()
            vectors = [v for i in range(0, len(values), batch_size) for v in with_retries(client, values[i : i + batch_size])]
            yield batch.assign(vector=vectors)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "vector array<float>"])
    return kept.mapInPandas(run, schema)
