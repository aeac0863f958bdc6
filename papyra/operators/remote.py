"""Embedding through a service: requests under its limits, halving what it refuses, retries, answers in order.

The service is an injected transport (payload -> answer), so nothing here opens a connection; a transport raises
ServiceError with the status and text it got. Embedders of this module satisfy embedding.Embedder, run inside
a partition (`embedding.embed`) and keep several requests in flight there.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

#: Limits of one request, of its windows and of a pointwise batch; what is tried again.
REQUEST_TOKENS, REQUEST_INPUTS, REQUEST_CHUNKS, WINDOW_TOKENS, POINTWISE = 120_000, 1000, 16_000, 32_000, 10
TRANSIENT = frozenset({429, 500, 502, 503, 504})
BATCH_TOO_LARGE, WINDOW_TOO_LONG, INPUT_TOO_LONG = "TOO_MANY_TOKENS_IN_BATCH", "context window", "context length"

Transport = Callable[[dict], dict]


class ServiceError(RuntimeError):
    """What a service answered instead of a result; status 0 is a broken connection."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"{status}: {text}")
        self.status, self.text = status, text


class Overflow(ServiceError):
    """An input longer than the model's context: never cut in silence."""


def with_retries(call: Transport, payload: dict, tries: int = 5, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """call(payload); a transient error is tried again after delay, which doubles; the last one is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            return call(payload)
        except ServiceError as e:
            if not left or (e.status not in TRANSIENT and e.status != 0):
                raise
            sleep(delay)
            delay *= 2
    raise ValueError("tries is 1 at least")


def estimated_tokens(text: str, per_token: float = 2.2) -> int:
    return max(1, int(len(text) / per_token))


def runs(sizes: list[tuple[int, ...]], limits: tuple[int, ...]) -> Iterator[slice]:
    """Consecutive items joined while the sums of all their sizes stay within the limits; one at least."""
    start, total = 0, [0] * len(limits)
    for k, item in enumerate(sizes):
        grown = [a + b for a, b in zip(total, item, strict=True)]
        if k > start and any(a > b for a, b in zip(grown, limits, strict=True)):
            yield slice(start, k)
            start, grown = k, list(item)
        total = grown
    if sizes:
        yield slice(start, len(sizes))


def in_flight(work: Callable, items: list, threads: int) -> list:
    """work over items by some threads; results in the items' order, whatever order they end in."""
    if threads <= 1 or len(items) <= 1:
        return [work(x) for x in items]
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(work, items))


def _by_index(rows: list[dict], value: str) -> list:
    return [r[value] for r in sorted(rows, key=lambda r: r["index"])]


@dataclass
class ContextualEmbedder:
    """Vectors of chunks that see the other chunks of their window.

    A window over WINDOW_TOKENS (by estimate) is split before it is sent; a request holds windows up to
    three limits. A request that the service finds too heavy is halved; if one window is still too long for
    the model, windows are halved down to single chunks, which raise. `narrowed` counts split windows.
    """

    transport: Transport
    model: str
    dim: int
    threads: int = 8
    tries: int = 5
    sleep: Callable[[float], None] = time.sleep
    narrowed: int = field(default=0)
    tokens: int = field(default=0)

    def _send(self, windows: list[list[str]], kind: str) -> list[list[float]]:
        """The vectors of all chunks of the windows, in order."""
        try:
            body = with_retries(self.transport, {"inputs": windows, "model": self.model, "input_type": kind, "output_dimension": self.dim}, self.tries, sleep=self.sleep)
        except ServiceError as e:
            half = (len(windows) + 1) // 2
            if BATCH_TOO_LARGE in e.text and len(windows) > 1:
                return self._send(windows[:half], kind) + self._send(windows[half:], kind)
            if WINDOW_TOO_LONG in e.text and any(len(w) > 1 for w in windows):
                self.narrowed += sum(len(w) > 1 for w in windows)
                return self._send([part for w in windows for part in (w[: len(w) // 2], w[len(w) // 2 :]) if part], kind)
            raise
        self.tokens += body.get("usage", {}).get("total_tokens", 0)
        return [v for w in _by_index(body["data"], "data") for v in _by_index(w, "embedding")]

    def _all(self, windows: list[list[str]], kind: str) -> list[list[float]]:
        parts = []
        for w in windows:
            cuts = [w[s] for s in runs([(estimated_tokens(t),) for t in w], (WINDOW_TOKENS,))]
            self.narrowed += len(cuts) > 1
            parts += cuts
        sizes = [(sum(map(estimated_tokens, w)), 1, len(w)) for w in parts]
        requests = [parts[s] for s in runs(sizes, (REQUEST_TOKENS, REQUEST_INPUTS, REQUEST_CHUNKS))]
        return [v for got in in_flight(lambda r: self._send(r, kind), requests, self.threads) for v in got]

    def embed_documents(self, windows: list[list[str]]) -> list[list[list[float]]]:
        flat = iter(self._all(windows, "document"))
        return [[next(flat) for _ in w] for w in windows]

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return self._all([[t] for t in texts], "query")


@dataclass
class PointwiseEmbedder:
    """Vectors of texts by themselves, `batch` a request."""

    transport: Transport
    model: str
    dim: int
    batch: int = POINTWISE
    threads: int = 8
    tries: int = 5
    sleep: Callable[[float], None] = time.sleep

    def _all(self, texts: list[str]) -> list[list[float]]:
        send = lambda part: _by_index(with_retries(self.transport, {"model": self.model, "input": part, "dimensions": self.dim}, self.tries, sleep=self.sleep)["data"], "embedding")
        parts = [texts[k : k + self.batch] for k in range(0, len(texts), self.batch)]
        return [v for got in in_flight(send, parts, self.threads) for v in got]

    def embed_documents(self, windows: list[list[str]]) -> list[list[list[float]]]:
        flat = iter(self._all([t for w in windows for t in w]))
        return [[next(flat) for _ in w] for w in windows]

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return self._all(texts)


@dataclass
class LocalEmbedder:
    """One text a request to a local server: its context is stated, cutting is off, queries get an instruction.

    A vector longer than dim is cut to its first dim numbers and scaled to length one again.
    """

    transport: Transport
    model: str
    dim: int | None = None
    context: int = 8192
    prefix: str = "Instruct: Given a search query, retrieve relevant passages\nQuery: "

    def one(self, text: str) -> tuple[list[float], int]:
        """The whole vector and how many tokens the server read."""
        try:
            body = self.transport({"model": self.model, "input": text, "truncate": False, "options": {"num_ctx": self.context}})
        except ServiceError as e:
            if e.status == 400 and INPUT_TOO_LONG in e.text:
                raise Overflow(e.status, e.text) from e
            raise
        return body["embeddings"][0], body.get("prompt_eval_count") or 0

    def _cut(self, v: list[float]) -> list[float]:
        if self.dim is None or self.dim >= len(v):
            return v
        v = v[: self.dim]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    def embed_documents(self, windows: list[list[str]]) -> list[list[list[float]]]:
        return [[self._cut(self.one(t)[0]) for t in w] for w in windows]

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return [self._cut(self.one(self.prefix + t)[0]) for t in texts]
