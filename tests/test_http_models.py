"""Model calls against a server of this process that limits, fails and drops connections."""

import json
import threading
import time
from collections import Counter
from email.utils import formatdate
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cartulary.sources import models
from cartulary.sources.http_models import ApiError, HttpModel, post, retry_after
from cartulary.sources.models import Retryable


class Server(ThreadingHTTPServer):
    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.seen, self.bodies, self.lock, self.now, self.most = Counter(), [], threading.Lock(), 0, 0


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def _answer(self, status, body, **headers):
        data = json.dumps(body).encode() if not isinstance(body, bytes) else body
        self.send_response(status)
        for k, v in {"Content-Length": str(len(data)), **headers}.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(data)

    def do_POST(self):
        s, body = self.server, json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/v1/embeddings":
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            return self._answer(200, {"data": data[::-1] if "short" not in body["input"] else data[:-1]})
        prompt = body["messages"][-1]["content"]
        with s.lock:
            s.seen[prompt] += 1
            s.bodies.append((body, self.headers.get("Authorization")))
            n, s.now = s.seen[prompt], s.now + 1
            s.most = max(s.most, s.now)
        time.sleep(0.05)
        with s.lock:
            s.now -= 1
        if prompt == "limited" and n == 1:
            return self._answer(429, {"error": {"message": "slow down"}}, Retry_After="1")
        if prompt == "shaky" and n <= 2:
            return self._answer(503, b"oops")
        if prompt == "dropped" and n == 1:
            return self.connection.close()
        if prompt == "bad":
            return self._answer(400, {"error": {"message": "no such model"}})
        if prompt == "down":
            return self._answer(500, {})
        if prompt == "empty":
            return self._answer(200, {"choices": []})
        return self._answer(200, {"choices": [{"message": {"content": prompt.upper()}}]})


@pytest.fixture
def server():
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def _url(s):
    return f"http://127.0.0.1:{s.server_address[1]}/"


def test_answers_of_every_kind(spark, server):
    prompts = ["fine", "limited", "shaky", "dropped", "bad", "down", "empty", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "id int, prompt string").repartition(2)
    url = _url(server)
    got = {prompts[r.id]: r for r in models.complete(df, lambda: HttpModel(url, "m", "secret", system="be brief", temperature=0), attempts=3, in_flight=4).collect()}
    assert {p: (r.response, r.error, r.attempts) for p, r in got.items()} == {
        "fine": ("FINE", None, 1), "limited": ("LIMITED", None, 2), "shaky": ("SHAKY", None, 3), "dropped": ("DROPPED", None, 2), "bad": (None, "ApiError", 1), "down": (None, "Retryable", 3),
        "empty": (None, "ApiError", 1), None: ("", None, 1),
    }
    assert server.seen["bad"] == 1 and server.seen["down"] == 3 and got["limited"].seconds >= 1.0 and len(got["fine"].prompt_hash) == 64
    body, key = server.bodies[0]
    assert key == "Bearer secret" and body["model"] == "m" and body["temperature"] == 0 and body["messages"][0] == {"role": "system", "content": "be brief"}


def test_requests_under_way_are_bounded(spark, server):
    df = spark.range(40).selectExpr("cast(id as string) as prompt").repartition(8)
    url = _url(server)
    assert models.complete(df, lambda: HttpModel(url, "m"), in_flight=2, most_requests=4).where("response = prompt").count() == 40
    assert 2 <= server.most <= 4


def test_embeddings(spark, server):
    url = _url(server)
    df = spark.createDataFrame([("abc",), (None,), ("de",)], "text string").coalesce(1)
    got = {r.text: r.vector for r in models.embed(df, lambda: HttpModel(url, "m").embed, batch_size=2).collect()}
    assert got == {"abc": [3.0, 1.0], None: [0.0, 1.0], "de": [2.0, 1.0]}
    with pytest.raises(ApiError):
        HttpModel(url, "m").embed(["a", "short"])


def test_what_servers_ask_to_wait():
    assert retry_after("7", 0) == 7.0 and retry_after("0", 0) is None and retry_after("", 0) is None and retry_after(None, 0) is None and retry_after("soon", 0) is None
    assert retry_after(formatdate(100, usegmt=True), 40) == 60 and retry_after(formatdate(100, usegmt=True), 400) is None
    waits = []

    def fails():
        raise Retryable("x", 500.0)

    with pytest.raises(Retryable):
        models.with_retries(fails, attempts=3, sleep=waits.append)
    assert waits == [60.0, 60.0]
    with pytest.raises(Retryable):
        post("http://127.0.0.1:1/x", {}, timeout=2)  # nobody listens
    with pytest.raises(ValueError):
        HttpModel("", "m")
