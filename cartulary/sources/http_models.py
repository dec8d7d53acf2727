"""Language models behind HTTP: chat completions and embeddings in the usual JSON form."""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from email.utils import parsedate_to_datetime

from cartulary.sources.models import Retryable

#: An answer of so many bytes or more is refused.
MOST_BYTES = 10 << 20
#: Where requests go.
COMPLETIONS, EMBEDDINGS = "/v1/chat/completions", "/v1/embeddings"


class ApiError(Exception):
    """An answer that another attempt would not change."""

    def __init__(self, status: int, message: str):
        super().__init__(f"status {status}: {message}")
        self.status = status


def retry_after(header: str | None, now: float) -> float | None:
    """The seconds that a server asks to wait, given as a number or as a date; none if it says nothing of use."""
    header = (header or "").strip()
    if header.isascii() and header.isdigit():
        return float(header) or None
    try:
        return max(parsedate_to_datetime(header).timestamp() - now, 0.0) or None
    except (TypeError, ValueError):
        return None


def _message(body: bytes) -> str:
    """What an answer says of its error."""
    try:
        told = json.loads(body)["error"]
        return str(told["message"] if isinstance(told, dict) else told)
    except (ValueError, KeyError, TypeError):
        return body[:200].decode("utf-8", "replace")


def post(url: str, body: dict, key: str | None = None, timeout: float = 60.0) -> dict:
    """The answer to a request. 429, 5xx and whatever goes wrong on the way are worth another attempt."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            data = answer.read(MOST_BYTES)
    except urllib.error.HTTPError as e:
        told = _message(e.read(MOST_BYTES))
        if e.code == 429:
            raise Retryable(told, retry_after(e.headers.get("Retry-After"), time.time())) from e
        if 500 <= e.code < 600:
            raise Retryable(f"status {e.code}: {told}") from e
        raise ApiError(e.code, told) from e
    except (OSError, http.client.HTTPException) as e:
        raise Retryable(str(e)) from e
    if len(data) >= MOST_BYTES:
        raise ApiError(200, f"an answer of {MOST_BYTES} bytes or more")
    return json.loads(data)


class HttpModel:
    """A model's completions when called with a prompt, and its embeddings; each call is one attempt."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 60.0, system: str | None = None, **options):
        if not url or not model:
            raise ValueError("a model has an address and a name")
        self.url, self.model, self.key, self.timeout, self.system, self.options = url.rstrip("/"), model, key, timeout, system, options

    def __call__(self, prompt: str) -> str:
        messages = [{"role": "system", "content": self.system}] if self.system else []
        body = {"model": self.model, "messages": [*messages, {"role": "user", "content": prompt}], **self.options}
        answer = post(self.url + COMPLETIONS, body, self.key, self.timeout)
        try:
            return answer["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ApiError(200, "an answer without a choice") from e

    def embed(self, texts: list[str]) -> list[list[float]]:
        answer = post(self.url + EMBEDDINGS, {"model": self.model, "input": texts}, self.key, self.timeout)
        try:
            by_place = sorted(answer["data"], key=lambda x: x["index"])
            vectors = [x["embedding"] for x in by_place]
        except (KeyError, TypeError) as e:
            raise ApiError(200, "an answer without vectors") from e
        if [x["index"] for x in by_place] != [*range(len(texts))]:
            raise ApiError(200, f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors
